from hypothesis import given, settings
from hypothesis import strategies as st
from lexsieve.llm.token_counts import VOCABULARY, encoding, pieces, token_counts


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Z9 .\n\t'é🙂  s"), max_size=200), st.integers(1, 20))
def test_safe_cuts_keep_counts(text, size):
    enc = encoding(VOCABULARY)
    parts = pieces(text, size)
    assert "".join(parts) == text
    assert sum(len(enc.encode_ordinary(p)) for p in parts) == len(enc.encode_ordinary(text))


def test_odd_rows(odd, nothing):
    enc = encoding(VOCABULARY)
    got = {(r.doc_id, r.n_tokens) for r in token_counts(odd, batch_bytes=4096).collect()}
    want = {(r.doc_id, None if r.text is None else len(enc.encode_ordinary(r.text))) for r in odd.collect()}
    assert want == got and token_counts(odd).count() == odd.count()
    assert token_counts(nothing).count() == 0
