"""Approximate nearest neighbours: an NN-descent graph built by Spark joins, and greedy search over it.

The graph starts from exact neighbours inside random-projection blocks. Then, round after round, each node's
neighbours and some of the nodes it is a neighbour of are introduced to one another: rows of neighbour lists are
joined with the vectors they name, block by block, so a vector travels once to each block that needs it; pairs nearer
than the worst neighbour either has are sent back and merged. Rounds end when fewer than STOP of all list entries
change. Where a node is in more lists than it meets in one round, an edge it didn't meet stays fresh and comes first in a
later one. Queries walk the graph greedily, hop by hop expanding the nearest nodes of a beam not yet expanded, until none
of the beam is left. Graph and vectors are broadcast for the walk while they are within BROADCAST_BYTES; beyond, the
same walk is done by joins, one hop of all queries at a time. ``neighbours`` measures recall on a sample of the nodes
against all vectors, and raises beam and degree until it holds.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexsieve.llm import _text as X
from lexsieve.llm._spark import ID_BYTES, cut, maybe_broadcast

K = 10
DEGREE = 40
BEAM = 96
BLOCK = 256
TREES = 2
ROUNDS, STOP = 10, 0.004
#: Nodes from which walks of vectors that aren't nodes begin.
ENTRIES = 64
#: Nodes of a beam, the nearest open ones, that one hop of a walk goes on from.
EXPAND = 8
BROADCAST_BYTES = 256 << 20
#: Recall that SAMPLE nodes must reach. Beam, then degree grow by GROW while they don't, to at most MOST times what they were.
TARGET, SAMPLE, GROW, MOST = 0.92, 256, 1.5, 4
_STATE = "id long, vec binary, block int, nbr binary, dist binary, fresh binary"
OUT = "vec_id long, rank int, neighbour_id long, distance double"


def _clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    return v.where("id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x))")


def _packed(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame | None, int]:
    """(id, vec) of the vectors of the commonest length, the least of each id, as a table read back; and the length."""
    v = _clean(vectors, id_col, vector_col)
    sizes = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return None, 0
    dim = int(sizes["n"])
    v = v.where(F.size("v") == dim)
    often = cut(v.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("gone")))
    if not often.isEmpty():
        # only the ids that repeat are sorted
        named = maybe_broadcast(often, ID_BYTES)
        least = v.join(named, F.col("id") == F.col("gone"), "left_semi").groupBy("id").agg(F.min("v").alias("v"))
        v = v.join(named, F.col("id") == F.col("gone"), "left_anti").unionByName(least)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.asarray(batch.column("v").flatten(), dtype=np.float32).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in flat], pa.binary())], names=["id", "vec"])

    return cut(v.mapInArrow(pack, "id long, vec binary")), dim


def _rows(column: pa.Array, dtype: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype) for x in column]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), np.float32) for x in column]) if len(column) else np.zeros((0, 1), np.float32)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, in double precision so that equal vectors are 0 apart."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T), 0)


def _far(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of rows that stand in step, one way for both walks, so that they agree to the last bit."""
    diff = x.astype(np.float64) - q
    return (diff * diff).sum(axis=-1)


def _top(ids: np.ndarray, dist: np.ndarray, fresh: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of a list, each id once (an entry that isn't fresh goes before a fresh one), ties by id."""
    order = np.lexsort((fresh, ids))
    ids, dist, fresh = ids[order], dist[order], fresh[order]
    one = X.run_starts(ids)
    ids, dist, fresh = ids[one], dist[one], fresh[one]
    order = np.lexsort((ids, dist))[:k]
    return ids[order], dist[order], fresh[order]


def _blocks(dim: int, bits: int, tree: int):
    planes = np.random.default_rng(1000 + tree).normal(size=(dim, max(1, bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"))
            code = ((x @ planes > 0) * (1 << np.arange(planes.shape[1]))).sum(axis=1) if bits and len(x) else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(code.astype(np.int32))], names=["id", "vec", "block"])

    return run


def _seed(degree: int):
    def run(table: pa.Table) -> pa.Table:
        ids, x = np.asarray(table.column("id").combine_chunks()), _matrix(table.column("vec"))
        nbr, dist = [], []
        for at in range(0, len(ids), 256):
            d = _distances(x[at : at + 256], x)
            d[np.arange(d.shape[0]), np.arange(at, at + d.shape[0])] = np.inf
            k = min(degree, len(ids) - 1)
            near = np.argpartition(d, k - 1, axis=1)[:, :k] if k else np.zeros((len(d), 0), np.int64)
            for row, cols in zip(d, near, strict=True):
                nbr.append(ids[cols].tobytes())
                dist.append(row[cols].astype(np.float32).tobytes())
        return pa.table({"id": pa.array(ids), "vec": table.column("vec"), "block": table.column("block"), "nbr": pa.array(nbr, pa.binary()), "dist": pa.array(dist, pa.binary())})

    return run


def _merge_seeds(degree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nbr, dist, fresh = [], [], []
            for own, ids, ds in zip(batch.column("id").to_pylist(), batch.column("nbrs"), batch.column("dists"), strict=True):
                i = np.concatenate(_rows(ids.values, np.int64))
                d = np.concatenate(_rows(ds.values, np.float32))
                i, d, f = _top(i[i != own], d[i != own], np.ones(int((i != own).sum()), np.uint8), degree)
                nbr.append(i.tobytes())
                dist.append(d.tobytes())
                fresh.append(f.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), batch.column("block"), *(pa.array(c, pa.binary()) for c in (nbr, dist, fresh))], names=["id", "vec", "block", "nbr", "dist", "fresh"])

    return run


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, id, other, fresh) of every list entry."""
    for batch in batches:
        n = _rows(batch.column("nbr"), np.int64)
        size = [len(x) for x in n]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.asarray(batch.column("id")), size)), pa.array(np.concatenate([np.zeros(0, np.int64), *n])), pa.array(np.concatenate([np.zeros(0, np.uint8), *_rows(batch.column("fresh"), np.uint8)]).astype(bool))],
            names=["id", "other", "fresh"],
        )


def _introduce(table: pa.Table) -> pa.Table:
    """Local join of a block: rows with a vector (what lists name) and rows without (list entries of its nodes)."""
    named = table.filter(table.column("vec").is_valid())
    ids = np.asarray(named.column("other").combine_chunks())
    order = np.argsort(ids)
    ids, x, worst = ids[order], _matrix(named.column("vec"))[order], np.asarray(named.column("worst").combine_chunks())[order]
    lists = table.filter(table.column("vec").is_null())
    node, other, fresh = (np.asarray(lists.column(c).combine_chunks()) for c in ("id", "other", "fresh"))
    at = np.searchsorted(ids, other)
    order = np.argsort(node, kind="stable")
    node, at, fresh = node[order], at[order], fresh[order].astype(bool)
    cuts = np.append(X.run_starts(node), len(node))
    u, w, d = [], [], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        i, f = at[a:b], fresh[a:b]
        if len(i) < 2 or not f.any():
            continue
        dist = _distances(x[i], x[i])
        ok = (f[:, None] | f[None]) & (dist < worst[i][:, None]) & (i[:, None] != i[None])
        p, q = np.nonzero(ok)
        u.append(i[p])
        w.append(i[q])
        d.append(dist[p, q].astype(np.float32))
    if not u:
        return pa.table({"id": pa.array([], pa.int64()), "nbr": pa.array([], pa.binary()), "dist": pa.array([], pa.binary())})
    uu, ww, dd = np.concatenate(u), np.concatenate(w), np.concatenate(d)
    order = np.lexsort((ww, uu))
    uu, ww, dd = uu[order], ww[order], dd[order]
    one = X.run_starts(uu, ww)
    uu, ww, dd = uu[one], ww[one], dd[one]
    first = X.run_starts(uu)
    bounds = np.append(first, len(uu))
    return pa.table(
        {
            "id": pa.array(ids[uu[first]]),
            "nbr": pa.array([ids[ww[a:b]].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
            "dist": pa.array([dd[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
        }
    )


def _merge(degree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nbr, dist, fresh, changed = [], [], [], []
            for own, n, d, ids, ds, wait in zip(batch.column("id").to_pylist(), *(batch.column(c) for c in ("nbr", "dist", "nbrs", "dists", "late")), strict=True):
                n, d = np.frombuffer(n.as_buffer(), np.int64), np.frombuffer(d.as_buffer(), np.float32)
                f = np.isin(n, np.array(wait.as_py() or [], np.int64)).astype(np.uint8)
                new = np.concatenate([np.zeros(0, np.int64), *(_rows(ids.values, np.int64) if ids.is_valid else [])])
                far = np.concatenate([np.zeros(0, np.float32), *(_rows(ds.values, np.float32) if ds.is_valid else [])])
                n, d, f = _top(np.concatenate((n, new[new != own])), np.concatenate((d, far[new != own])), np.concatenate((f, np.full(int((new != own).sum()), 2, np.uint8))), degree)
                nbr.append(n.tobytes())
                dist.append(d.tobytes())
                fresh.append((f > 0).astype(np.uint8).tobytes())
                changed.append(int((f == 2).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), batch.column("block"), *(pa.array(c, pa.binary()) for c in (nbr, dist, fresh)), pa.array(changed, pa.int32())], names=["id", "vec", "block", "nbr", "dist", "fresh", "changed"])

    return run


def _worst(degree: int):
    """(other, vec, worst): each vector with the distance a new neighbour must beat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            worst = [float(d[-1]) if len(d) == degree else np.inf for d in _rows(batch.column("dist"), np.float32)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(worst, pa.float64())], names=["known", "vec", "worst"])

    return run


def _salted(placed: DataFrame, block: int) -> DataFrame:
    """``placed`` with a salt that cuts a block of very many vectors, such as equal ones, into several of usual size."""
    large = cut(placed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 8 * block).select(F.col("block").alias("large"), F.ceil(F.col("n") / (4 * block)).alias("pieces")))
    out = placed.join(maybe_broadcast(large, 2 * ID_BYTES), F.col("block") == F.col("large"), "left")
    return out.select("id", "vec", "block", F.coalesce(F.pmod(F.xxhash64("id", F.lit("salt")), F.col("pieces")), F.lit(0).cast("long")).alias("salt"))


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", degree: int = DEGREE, block: int = BLOCK, trees: int = TREES, rounds: int = ROUNDS, stop: float = STOP) -> DataFrame:
    """The graph: (id, vec, block, nbr, dist, fresh), lists packed, nearest first, by Euclidean distance.

    Null ids and vectors, empty ones, and vectors with a null or NaN element are left out, and so are vectors whose
    length isn't the commonest one, the shorter of two as common. Of several vectors under one id the least stays, so
    repeated rows are one node. Of neighbours as far the lesser id comes first. An empty table gives an empty graph.
    Vectors of any length are taken whole, and other columns, whatever their names, are not looked at.

    ``rounds`` and ``stop`` end the descent, ``degree`` bounds each list and how many of the lists that name a node
    it meets in one round; what it doesn't meet stays fresh for the next.
    """
    spark = vectors.sparkSession
    v, dim = _packed(vectors, id_col, vector_col)
    if v is None:
        return spark.createDataFrame([], _STATE)
    bits = max(0, int(np.ceil(np.log2(max(1, v.count() / block)))))
    seeds = None
    for tree in range(trees):
        s = _salted(v.mapInArrow(_blocks(dim, bits, tree), "id long, vec binary, block int"), block).groupBy("block", "salt").applyInArrow(_seed(degree), "id long, vec binary, block int, nbr binary, dist binary")
        seeds = s if seeds is None else seeds.unionByName(s)
    lists = seeds.groupBy("id").agg(F.first("vec").alias("vec"), F.min("block").alias("block"), F.collect_list("nbr").alias("nbrs"), F.collect_list("dist").alias("dists"))
    state = cut(lists.mapInArrow(_merge_seeds(degree), _STATE))
    nodes = state.count()
    for turn in range(rounds):
        edges = state.mapInArrow(_edges, "id long, other long, fresh boolean")
        place = state.select(F.col("id").alias("at"), "block")
        back = edges.select(F.col("other").alias("id"), F.col("id").alias("other"), "fresh")
        back = back.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("fresh"), F.xxhash64("id", "other", F.lit(turn)), "other")))
        back = cut(back.where((F.col("n") <= degree) | F.col("fresh")))
        late = back.where(F.col("n") > degree).groupBy(F.col("other").alias("owner")).agg(F.collect_list("id").alias("late"))
        back = back.where(F.col("n") <= degree).drop("n")
        both = edges.unionByName(back).groupBy("id", "other").agg(F.max("fresh").alias("fresh"))
        both = cut(both.join(place, F.col("id") == F.col("at")).select("block", "id", "other", "fresh"))
        named = both.select("block", "other").distinct().join(state.mapInArrow(_worst(degree), "known long, vec binary, worst double"), F.col("other") == F.col("known"))
        rows = both.select("block", "id", "other", "fresh", F.lit(None).cast("binary").alias("vec"), F.lit(None).cast("double").alias("worst")).unionByName(named.select("block", F.lit(None).cast("long").alias("id"), "other", F.lit(None).cast("boolean").alias("fresh"), "vec", "worst"))
        met = rows.groupBy("block").applyInArrow(_introduce, "id long, nbr binary, dist binary")
        met = met.groupBy("id").agg(F.collect_list("nbr").alias("nbrs"), F.collect_list("dist").alias("dists")).withColumnRenamed("id", "to")
        merged = cut(state.join(met, F.col("id") == F.col("to"), "left").join(late, F.col("id") == F.col("owner"), "left").select("id", "vec", "block", "nbr", "dist", "nbrs", "dists", "late").mapInArrow(_merge(degree), _STATE + ", changed int"))
        state = merged.drop("changed")
        if (merged.agg(F.sum("changed")).first()[0] or 0) <= stop * nodes * degree:
            break
    return state


class Graph:
    """A graph in memory: sorted ``ids``, vectors ``x``, neighbours ``nbr`` as row numbers, -1 where there are fewer."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, lists: list[np.ndarray]):
        order = np.argsort(ids)
        self.ids, self.x = ids[order], x[order]
        width = max((len(n) for n in lists), default=0)
        self.nbr = np.full((len(ids), max(1, width)), -1, np.int32)
        for row, k in enumerate(order):
            self.nbr[row, : len(lists[k])] = np.searchsorted(self.ids, lists[k])

    def search(self, q: np.ndarray, start: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of the k nearest of each query found by greedy walks from ``start`` [query, entries]."""
        n, width = len(q), self.nbr.shape[1]
        rows = np.full((n, beam), -1, np.int64)
        dist = np.full((n, beam), np.inf)
        done = np.ones((n, beam), bool)

        def take(new: np.ndarray, live: np.ndarray) -> None:
            valid = new >= 0
            valid &= ~(new[:, :, None] == rows[live][:, None, :]).any(axis=2)
            d = np.where(valid, _far(q[live][:, None, :], self.x[np.maximum(new, 0)]), np.inf)
            all_rows = np.concatenate((rows[live], np.where(valid, new, -1)), axis=1)
            all_dist = np.concatenate((dist[live], d), axis=1)
            all_done = np.concatenate((done[live], ~valid), axis=1)
            order = np.lexsort((all_rows, all_dist), axis=1)[:, :beam]
            rows[live] = np.take_along_axis(all_rows, order, 1)
            dist[live] = np.take_along_axis(all_dist, order, 1)
            done[live] = np.take_along_axis(all_done, order, 1)

        def once(new: np.ndarray) -> np.ndarray:
            """Each row's nodes without repeats."""
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            return new

        live = np.arange(n)
        take(once(start.astype(np.int64)), live)
        while len(live):
            # the beam is in order, so the first open nodes are the nearest
            at = np.argsort(done[live], axis=1, kind="stable")[:, :EXPAND]
            go = ~np.take_along_axis(done[live], at, 1) & np.isfinite(np.take_along_axis(dist[live], at, 1))
            some = go.any(axis=1)
            live, at, go = live[some], at[some], go[some]
            if not len(live):
                break
            done[live[:, None], at] |= go
            new = self.nbr[np.where(go, rows[live[:, None], at], 0)].astype(np.int64)
            new[~go] = -1
            take(once(new.reshape(len(live), -1)), live)
        order = np.lexsort((rows, dist), axis=1)[:, :k] if n else np.zeros((0, k), np.int64)
        return np.take_along_axis(rows, order, 1), np.take_along_axis(dist, order, 1)


def _walk(shared, k: int, beam: int, own: bool, entries: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g: Graph = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, q = np.asarray(part.column("id")), _matrix(part.column("vec")).astype(np.float64)
                if own:
                    start = np.searchsorted(g.ids, ids)[:, None]
                else:
                    start = np.repeat(np.searchsorted(g.ids, entries)[None], len(q), axis=0)
                rows, dist = g.search(q, start, k + own, beam)
                keep = (rows >= 0) & ~(own & (g.ids[np.maximum(rows, 0)] == ids[:, None]))
                rank = np.cumsum(keep, axis=1)
                keep &= rank <= k
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, keep.sum(axis=1))), pa.array(rank[keep].astype(np.int32)), pa.array(g.ids[rows[keep]]), pa.array(np.sqrt(dist[keep]))],
                    names=["vec_id", "rank", "neighbour_id", "distance"],
                )

    return run


def _step(beam: int):
    """Merge the vectors met in one hop into the beams of queries (the walk by joins)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {"rows": [], "dist": [], "open": []}
            for vec, r, d, o, ids, vecs in zip(*(batch.column(c) for c in ("vec", "rows", "dist", "open", "ids", "vecs")), strict=True):
                q = np.frombuffer(vec.as_buffer(), np.float32).astype(np.float64)[None]
                r, d, o = np.frombuffer(r.as_buffer(), np.int64), np.frombuffer(d.as_buffer(), np.float64), np.frombuffer(o.as_buffer(), np.uint8).copy()
                o[np.flatnonzero(o)[:EXPAND]] = 0  # those were expanded in this hop
                new = np.array(ids.as_py() or [], np.int64)
                far = _far(q, _matrix(vecs.values)) if len(new) else np.zeros(0)
                i, far, o = _top(np.concatenate((r, new)), np.concatenate((d, far)), np.concatenate((o, np.ones(len(new), np.uint8))), beam)
                cols["rows"].append(i.tobytes())
                cols["dist"].append(far.tobytes())
                cols["open"].append(o.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), *(pa.array(c, pa.binary()) for c in cols.values())], names=["id", "vec", "rows", "dist", "open"])

    return run


def _next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(q, to): the nearest open nodes of each query's beam."""
    for batch in batches:
        q, to = [], []
        for own, r, o in zip(batch.column("id").to_pylist(), _rows(batch.column("rows"), np.int64), _rows(batch.column("open"), np.uint8), strict=True):
            k = r[np.flatnonzero(o)[:EXPAND]]
            q += [own] * len(k)
            to += k.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(to, pa.int64())], names=["q", "to"])


def _listed(k: int, own: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for q, r, d in zip(batch.column("id").to_pylist(), _rows(batch.column("rows"), np.int64), _rows(batch.column("dist"), np.float64), strict=True):
                keep = np.flatnonzero(~(own & (r == q)))[:k]
                out += [(q, n + 1, int(r[j]), float(np.sqrt(d[j]))) for n, j in enumerate(keep)]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["vec_id", "rank", "neighbour_id", "distance"])

    return run


def search(graph: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, beam: int = BEAM, broadcast_bytes: int = BROADCAST_BYTES, only: list[int] | None = None) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): the k nearest nodes found for each query, nearest first.

    Without ``queries`` every node of the graph is one (or those of ``only``), starts at itself and isn't its own
    neighbour. Queries with
    null ids or vectors, or vectors of another length than the graph's, have no rows; repeated ids count once, the
    least vector. Fewer than k rows where the graph has fewer nodes, none where either table is empty. Of nodes as far
    the lesser id comes first. Other columns are not looked at. The answers are the same whichever walk is taken.
    """
    spark = graph.sparkSession
    own = queries is None
    first = graph.select(F.octet_length("vec").alias("n")).first()
    if first is None:
        return spark.createDataFrame([], OUT)
    if own:
        q = graph.select("id", "vec") if only is None else graph.where(F.col("id").isin(only)).select("id", "vec")
    else:
        dim = first["n"] // 4

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat = np.asarray(batch.column("v").flatten(), dtype=np.float32).reshape(-1, dim)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in flat], pa.binary())], names=["id", "vec"])

        q = _clean(queries, id_col, vector_col).where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v")).mapInArrow(pack, "id long, vec binary")
    # where walks of other vectors begin: the nodes of the least hashes
    entries = np.array([] if own else [r["id"] for r in graph.select("id").orderBy(F.xxhash64("id"), "id").limit(ENTRIES).collect()], np.int64)
    size = graph.agg(F.sum(F.octet_length("vec") + F.octet_length("nbr") + 8)).first()[0]
    if size <= broadcast_bytes:
        got = graph.select("id", "vec", "nbr").toArrow()
        g = Graph(np.asarray(got.column("id").combine_chunks()), _matrix(got.column("vec")), [np.frombuffer(x.as_buffer(), np.int64) for x in got.column("nbr")])
        return q.mapInArrow(_walk(spark.sparkContext.broadcast(g), k, beam, own, entries), OUT)
    empty = F.lit(b"")
    state = q.select("id", "vec", empty.alias("rows"), empty.alias("dist"), empty.alias("open"))
    vectors = graph.select(F.col("id").alias("node"), F.col("vec").alias("near"))
    if own:
        met = q.select(F.col("id").alias("q"), F.col("id").alias("node"))
    else:
        met = q.select(F.col("id").alias("q"), F.explode(F.array(*[F.lit(int(x)) for x in entries])).alias("node"))
    while True:
        found = met.join(vectors, "node").groupBy("q").agg(F.collect_list("node").alias("ids"), F.collect_list("near").alias("vecs"))
        state = cut(state.join(found, F.col("id") == F.col("q"), "left").select("id", "vec", "rows", "dist", "open", "ids", "vecs").mapInArrow(_step(beam), "id long, vec binary, rows binary, dist binary, open binary"))
        ahead = state.mapInArrow(_next, "q long, to long")
        if ahead.isEmpty():
            break
        edges = graph.mapInArrow(_edges, "id long, other long, fresh boolean").select(F.col("id").alias("to"), F.col("other").alias("node"))
        met = ahead.join(edges, "to").select("q", "node").distinct()
    return state.mapInArrow(_listed(k, own), OUT)


def _nearest(ids: np.ndarray, x: np.ndarray, k: int):
    """(vec_id, distance) of the k nearest vectors of a partition for each of a few nodes, the node itself left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.full((len(ids), k), np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                d = _distances(x, _matrix(part.column("vec")))
                d[ids[:, None] == np.asarray(part.column("id"))[None]] = np.inf
                near = np.sort(np.concatenate((near, d), axis=1), axis=1)[:, :k]
        keep = np.isfinite(near)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, keep.sum(axis=1))), pa.array(np.sqrt(near[keep]))], names=["vec_id", "distance"])

    return run


def truth(graph: DataFrame, k: int = K, sample: int = SAMPLE) -> dict[int, list[float]]:
    """The exact distances of the k nearest neighbours of ``sample`` nodes, those of the least hashes."""
    rows = graph.select("id", "vec").orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(sample).collect()
    if not rows:
        return {}
    ids, x = np.array([r["id"] for r in rows], np.int64), np.stack([np.frombuffer(r["vec"], np.float32) for r in rows])
    found = graph.select("id", "vec").mapInArrow(_nearest(ids, x, k), "vec_id long, distance double")
    return {r["vec_id"]: r["d"] for r in found.groupBy("vec_id").agg(F.slice(F.sort_array(F.collect_list("distance")), 1, k).alias("d")).collect()}


def recall(graph: DataFrame, beam: int, exact: dict[int, list[float]], k: int = K) -> float:
    """The share of the exact neighbours' places that the walk fills as near; 1 where there is none to find."""
    places = sum(map(len, exact.values()))
    if not places:
        return 1.0
    got = search(graph, k=k, beam=beam, only=list(exact)).select("vec_id", "distance").collect()
    return sum(r["distance"] <= exact[r["vec_id"]][-1] + 1e-5 for r in got) / places


def neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, degree: int = DEGREE, beam: int = BEAM, target: float = TARGET) -> DataFrame:
    """``search`` of every node over a graph of a degree and with a beam at which sampled recall reaches ``target``.

    Says so in a warning where it is still less at MOST times the degree and the beam given.
    """
    wide, large, exact = beam * MOST, degree * MOST, None
    while True:
        graph = build(vectors, id_col, vector_col, degree=degree)
        exact = truth(graph, k) if exact is None else exact
        width = beam
        while (reached := recall(graph, width, exact, k)) < target and width < wide:
            width = min(wide, int(np.ceil(width * GROW)))
        if reached >= target or degree >= large:
            break
        degree = min(large, int(np.ceil(degree * GROW)))
    if reached < target:
        warnings.warn(f"recall {reached:.3f} of a sample at degree {degree} and beam {width}, under {target}", stacklevel=2)
    return search(graph, k=k, beam=width)
