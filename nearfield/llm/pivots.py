"""Exact top-k inner products by pivot-table elimination (operator 10).

The table holds each vector's Euclidean distances to some pivots. By the triangle inequality the largest difference of
two vectors' pivot distances is a lower bound of their distance, hence (|q|^2 + |c|^2 - bound^2) / 2 an upper bound of
their inner product. A query's candidates are evaluated in the order of these bounds until the next bound is below the
k-th best score found so far: the rest can't enter. Integers keep the scores exact.

The query set meets all rows in blocks of both; a task that meets several blocks carries its queries' best scores on.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.sources.scratch import written

PIVOTS = 16
#: Pivots are chosen far from each other among so many vectors (the ones of smallest hash).
PIVOT_SAMPLE = 1024
BLOCK_ROWS = 2048
QUERY_ROWS = 512
_TILE = 64
_CHUNK = 256
#: Query blocks whose best scores a task holds at a time.
_HELD = 32
_BLOCK = "name string, dim int, ids binary, vecs binary, far binary, large boolean"
#: Scores are held to what a long can hold.
_MOST = (1 << 63) - 1


def vectors(table: DataFrame, scale: int = 64) -> DataFrame:
    """(id, v): floor(scale * x) of each component, as doubles without fraction, exact whatever their size (a product
    beyond the largest double is held to it). One row for each row of ``table``, repeated ones included; rows with a null
    vec_id or vector, or a null or non-finite component, are left out."""
    largest = sys.float_info.max

    def floored(e: Column) -> Column:
        y = F.greatest(F.least(e.cast("double") * scale, F.lit(largest)), F.lit(-largest))
        return F.when(F.abs(y) >= 2.0**52, y).otherwise(F.floor(y).cast("double"))  # doubles that large have no fraction

    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    return table.where(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", floored).alias("v"))


def choose_pivots(table: DataFrame, count: int = PIVOTS) -> dict[int, np.ndarray]:
    """Per dimension, pivots far from each other, from a bounded sample."""
    out: dict[int, np.ndarray] = {}
    rows = sorted((r.id, r.v) for r in table.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).collect())
    for dim in sorted({len(v) for _, v in rows}):
        x = np.array([v for _, v in rows if len(v) == dim], np.float64)
        picked, near = [0], np.linalg.norm(x - x[0], axis=1)
        while len(picked) < min(count, len(x)):
            picked.append(int(near.argmax()))
            near = np.minimum(near, np.linalg.norm(x - x[picked[-1]], axis=1))
        out[dim] = x[picked]
    return out


def blocks(table: DataFrame, pivots: dict[int, np.ndarray], rows: int) -> DataFrame:
    """``table`` packed: ids, vectors and the pivot table, of one dimension and at most ``rows`` vectors a block. Vectors
    whose products doubles can't hold exactly are packed apart (``large``). A block's name is its own."""

    def pack(dim: int, large: bool, ids: list[int], vecs: list[np.ndarray]) -> tuple:
        x = np.array(vecs, np.float64).reshape(len(ids), dim)
        p = pivots.get(dim, np.zeros((0, dim)))
        far = np.sqrt(((x[:, None, :] - p[None]) ** 2).sum(axis=2)) if len(p) and not large else np.zeros((len(ids), 0))
        return uuid.uuid4().hex, dim, np.array(ids, "<i8").tobytes(), x.tobytes(), far.astype("<f8").tobytes(), large

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], tuple[list[int], list[np.ndarray]]] = {}

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], ["name", "dim", "ids", "vecs", "far", "large"])

        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v"), strict=True):
                own = np.asarray(v.values)
                kind = len(own), bool(np.abs(own).max(initial=0) >= 2.0 ** ((52 - np.ceil(np.log2(max(len(own), 1)))) // 2))
                ids, vecs = held.setdefault(kind, ([], []))
                ids.append(i)
                vecs.append(own)
                if len(ids) >= rows:
                    yield batch_of([pack(*kind, *held.pop(kind))])
        for kind, (ids, vecs) in held.items():
            yield batch_of([pack(*kind, ids, vecs)])

    return table.mapInArrow(run, _BLOCK)


class _Best:
    """The k best (score, id) of each query of a block so far; a larger score is better, then a smaller id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.found: list[list[tuple]] = [[] for _ in ids]

    def floor(self, i: int) -> float:
        """The score that a further candidate has to reach."""
        own = self.found[i]
        return float(own[-1][0]) if len(own) >= self.k else -np.inf

    def add(self, i: int, scores: Iterable, ids: Iterable) -> None:
        own = self.found[i]
        own += [(s, -j) for s, j in zip(scores, ids, strict=True)]
        own.sort(reverse=True)
        del own[self.k :]


def evaluate(best: _Best, q: np.ndarray, qfar: np.ndarray, c: np.ndarray, cfar: np.ndarray, cids: np.ndarray, counts: list[int] | None = None) -> None:
    """Let a block's queries meet a block of candidates. ``counts`` gathers pairs and evaluated pairs.

    Two blocks are first compared as wholes: the pivot distances' ranges bound how near any two of their vectors are.
    """
    q2, c2 = (q * q).sum(axis=1), (c * c).sum(axis=1)
    if not len(q) or not len(c):
        return
    apart = np.maximum(qfar.min(axis=0) - cfar.max(axis=0), cfar.min(axis=0) - qfar.max(axis=0)).max(initial=0)
    most = (q2.max() + c2.max()) * (0.5 + 1e-9) + 1e-6 - apart * apart / 2
    if most < min(best.floor(i) for i in range(len(q))):
        if counts is not None:
            counts[0] += len(q) * len(c)
        return
    for a in range(0, len(q), _TILE):
        part = slice(a, min(a + _TILE, len(q)))
        low = np.zeros((part.stop - a, len(c)))
        for p in range(qfar.shape[1]):
            np.maximum(low, np.abs(qfar[part, p, None] - cfar[None, :, p]), out=low)
        # distances carry rounding errors of some 1e-16 of their size: the slack is far beyond them
        upper = (q2[part, None] + c2[None] - low * low) / 2
        upper += 1e-9 * (q2[part, None] + c2[None]) + 1e-6
        order = np.argsort(-upper, axis=1, kind="stable")
        for i in range(a, part.stop):
            own, bound = order[i - a], upper[i - a]
            for b in range(0, len(own), _CHUNK):
                at = own[b : b + _CHUNK]
                floor = best.floor(i)
                if bound[at[0]] < floor:
                    break
                at = at[(bound[at] >= floor) & (cids[at] != best.ids[i])]
                scores = c[at] @ q[i]
                good = np.flatnonzero(scores >= floor)
                if len(good) > best.k:
                    good = good[np.lexsort((cids[at[good]], -scores[good]))[: best.k]]
                best.add(i, scores[good].tolist(), cids[at[good]].tolist())
                if counts is not None:
                    counts[1] += len(at)
            if counts is not None:
                counts[0] += len(own)


def evaluate_large(best: _Best, q: np.ndarray, c: np.ndarray, cids: np.ndarray) -> None:
    """The same for components that doubles can't multiply exactly. Products in doubles, with a bound of their rounding
    errors, leave few candidates a query, which Python's integers evaluate. Scores are held to 64 bits: ones beyond that tie."""
    with np.errstate(over="ignore", invalid="ignore"):
        approx = q @ c.T
        slack = (np.abs(q) @ np.abs(c).T) * ((q.shape[1] + 2) * 2.0**-52)
        low, high = approx - slack, approx + slack
    known = np.isfinite(low) & np.isfinite(high)
    limit = float(1 << 63)
    low, high = (np.clip(np.where(known, x, at), -limit, limit) for x, at in ((low, -limit), (high, limit)))
    for i in range(len(q)):
        at = np.flatnonzero(cids != best.ids[i])
        if len(at) > best.k:
            kth = np.partition(low[i, at], len(at) - best.k)[len(at) - best.k]
            at = at[high[i, at] >= kth]
        at = at[high[i, at] >= best.floor(i)]
        sure = low[i, at] >= limit
        over = np.sort(cids[at[sure]])[: best.k]
        row, rest = [int(v) for v in q[i].tolist()], at[~sure]
        exact = [max(-_MOST - 1, min(_MOST, sum(x * int(y) for x, y in zip(row, c[j].tolist(), strict=True)))) for j in rest]
        best.add(i, [_MOST] * len(over) + exact, [*over.tolist(), *cids[rest].tolist()])


def top_k(table: DataFrame, queries: DataFrame, k: int = 20, pivots: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of ``queries`` (id, v) the k rows of ``table`` (id, v) with the highest
    inner products, ties to the smaller id, the query's own id excluded; all if there are fewer. Vectors of different
    length don't meet. ``v`` holds integers as doubles. Rows count as often as they occur, as queries (whose answers share
    one ranking per id) and as candidates. Scores are held to 64 bits. An empty table or query set gives no rows."""
    if k < 1:
        raise ValueError("k must be at least 1")
    pivots = choose_pivots(table) if pivots is None else pivots
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = written(blocks(table, pivots, BLOCK_ROWS), "candidates").repartition(parts)
    q = written(blocks(queries, pivots, QUERY_ROWS), "queries").select(*[F.col(n).alias(f"q_{n}") for n in ("name", "dim", "ids", "vecs", "far", "large")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Best] = {}

        def out(all_best: Iterable[_Best]) -> pa.RecordBatch:
            rows = [(int(i), -j, int(s)) for b in all_best for i, own in zip(b.ids, b.found, strict=True) for s, j in own]
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], pa.int64()) for n in range(3)], ["query_id", "vec_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["dim"] != r["q_dim"]:
                    continue
                ids, cids = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                if r["q_name"] not in held and len(held) >= _HELD:
                    yield out(held.values())
                    held.clear()
                best = held.setdefault(r["q_name"], _Best(ids, k))
                qv, cv = (np.frombuffer(r[n], "<f8").reshape(m, r["dim"]) for n, m in (("q_vecs", len(ids)), ("vecs", len(cids))))
                if r["large"] or r["q_large"]:
                    evaluate_large(best, qv, cv, cids)
                else:
                    evaluate(best, qv, np.frombuffer(r["q_far"], "<f8").reshape(len(ids), -1), cv, np.frombuffer(r["far"], "<f8").reshape(len(cids), -1), cids)
        yield out(held.values())

    found = q.crossJoin(c).mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_pivot_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 best candidates of every twentieth vector, over all vectors."""
    table = written(vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
    return top_k(table, table.where("id % 20 = 0"))


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
