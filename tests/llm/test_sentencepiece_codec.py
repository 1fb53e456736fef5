import struct

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from lexsieve.llm import sentencepiece_codec as S

DATA = open(S.MODEL, "rb").read()
SP = sentencepiece.SentencePieceProcessor(model_proto=DATA)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab  ▁\nthe.é中🙂", max_size=120))
def test_parity(text):
    if "\x00" not in text and not any(0xD800 <= ord(c) < 0xE000 for c in text):
        S.verify(S.codec(S.MODEL), DATA, [text])


def test_parity_on_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    S.verify(S.codec(S.MODEL), DATA, [r.text for r in rows])


def model(pieces, kind, fallback):
    """The bytes of a model file."""
    num = lambda field, v: bytes([field << 3]) if field < 16 else bytes([(field << 3) & 0x7F | 0x80, field >> 4])
    field = lambda k, body: num(k, 0)[:-1] + bytes([num(k, 0)[-1] | 0]) + body

    def tag(k, wire):
        key = k << 3 | wire
        return bytes([key]) if key < 128 else bytes([key & 0x7F | 0x80, key >> 7])

    def nested(k, body):
        n = len(body)
        return tag(k, 2) + (bytes([n]) if n < 128 else bytes([n & 0x7F | 0x80, n >> 7])) + body

    del field
    out = b""
    for piece, score, t in pieces:
        out += nested(1, nested(1, piece.encode()) + tag(2, 5) + struct.pack("<f", score) + tag(3, 0) + bytes([t]))
    out += nested(2, tag(3, 0) + bytes([kind]) + tag(35, 0) + bytes([int(fallback)]))
    return out + nested(3, nested(1, b"identity") + tag(3, 0) + b"\x01" + tag(4, 0) + b"\x00" + tag(5, 0) + b"\x01")


def test_unigram_scores_and_bytes():
    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((f"<0x{k:02X}>", 0, 6) for k in range(256))]
    pieces += [("▁", -3.0, 1), ("▁he", -4.0, 1), ("llo", -4.5, 1), ("h", -6.0, 1), ("e", -5.5, 1), ("l", -5.0, 1), ("o", -5.2, 1), ("▁hello", -9.5, 1), ("lo", -6.1, 1), ("▁▁", -7.0, 1)]
    data = model(pieces, 1, True)
    S.verify(S.Codec(data), data, ["hello", "hello hello", "hell  o é", "ohello🙂", "", "   "])


def test_odd_rows(odd, nothing):
    got = S.encode(odd, batch_bytes=1 << 16)
    rows = {r.doc_id: r for r in got.where("doc_id is not null and doc_id not in (1)").collect()}
    texts = {r.doc_id: r.text for r in odd.where("doc_id is not null").collect()}
    assert got.count() == odd.count()
    for k, r in rows.items():
        assert r.ids == (None if texts[k] is None else SP.encode(texts[k])) and (r.round_trip is None) == (texts[k] is None)
    back = {r.doc_id: r.text for r in S.decode(got).where("doc_id is not null").collect()}
    assert back == texts
    assert S.encode(nothing).count() == 0 and S.decode(S.encode(nothing)).count() == 0
