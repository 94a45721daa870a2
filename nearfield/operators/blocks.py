"""Exact k best by cosine between blocks of vectors, by matrix products.

A product of the normalized vectors is within a known bound of each score. What it leaves in reach of a query's k-th best
is scored as ``functions.vectors.cosine`` does, element after element, so scores and ties are those of the expression.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from nearfield.sources.scratch import small

#: About so many rows of the pool, and of the queries, meet in one group of a task.
POOL_ROWS = 1 << 14
QUERY_ROWS = 1 << 12
#: Scores held at a time, and pairs scored exactly at a time.
_CELLS = 1 << 21
_PAIRS = 1 << 15
#: Norms between these can neither overflow nor vanish in a score.
LEAST, MOST = 1e-100, 1e100


def norms(x: np.ndarray) -> np.ndarray:
    """Summed in order, as the expression does."""
    total = np.zeros(len(x))
    with np.errstate(all="ignore"):
        for j in range(x.shape[1]):
            total += x[:, j] * x[:, j]
        return np.sqrt(total)


def matrices(column: pa.ChunkedArray | pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, matrix, norms) of each dimension in a column of lists; vectors that are null, or with an element that is null
    or NaN, can't score and are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    size = pc.list_value_length(column.drop_null()).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    begin, out = np.cumsum(size) - size, []
    for d in np.unique(size):
        own = np.flatnonzero(size == d)
        x = flat.reshape(len(own), d) if len(own) == len(size) else flat[begin[own][:, None] + np.arange(d)]
        n = norms(x)
        fine = ~np.isnan(n)
        out.append((at[own], x, n) if fine.all() else (at[own][fine], x[fine], n[fine]))
    return out


def _scores(q: np.ndarray, qn: np.ndarray, p: np.ndarray, pn: np.ndarray, i: np.ndarray, j: np.ndarray, pool_first: bool) -> np.ndarray:
    """Of the pairs (i, j), as ``cosine`` does; NaN where it has none."""
    out = np.empty(len(i))
    with np.errstate(all="ignore"):
        for s in range(0, len(i), _PAIRS):
            a, b = q[i[s : s + _PAIRS]], p[j[s : s + _PAIRS]]
            total = np.zeros(len(a))
            for c in range(q.shape[1]):
                total += a[:, c] * b[:, c]
            na, nb = qn[i[s : s + _PAIRS]], pn[j[s : s + _PAIRS]]
            score = total / nb / na if pool_first else total / na / nb
            score[(na == 0) | (nb == 0)] = np.nan
            score[(na == 0) & (nb == 0)] = 0.0
            out[s : s + _PAIRS] = score
    return out


def _first_copies(p: np.ndarray, k: int) -> np.ndarray:
    """The rows of ``p`` without those that k equal ones precede."""
    if len(p) <= k:
        return np.arange(len(p))
    if not p.shape[1]:
        return np.arange(k)
    _, group = np.unique(np.ascontiguousarray(p).view(np.dtype((np.void, p.itemsize * p.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(group, kind="stable")
    own = group[order]
    turn = np.arange(len(own)) - np.searchsorted(own, own)
    return np.sort(order[turn < k])


def best(q: np.ndarray, qn: np.ndarray, k: np.ndarray, p: np.ndarray, pn: np.ndarray, largest: bool = True, pool_first: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the ``k`` best usable rows of ``p`` for each of ``q``, best first, ties to the earlier row."""
    most = int(k.max(initial=0))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if most <= 0 or not len(p):
        return found[0]
    kept = _first_copies(p, most)
    p, pn = p[kept], pn[kept]
    plain, odd = np.flatnonzero((pn > LEAST) & (pn < MOST)), np.flatnonzero(~((pn > LEAST) & (pn < MOST)))
    unit = (p[plain] / pn[plain, None]).T
    slack = 16 * (q.shape[1] + 8) * np.finfo(float).eps
    everything = np.arange(len(p))
    step = max(1, _CELLS // len(p))
    for s in range(0, len(q), step):
        rows = np.arange(s, min(s + step, len(q)))
        fit = (qn[rows] > LEAST) & (qn[rows] < MOST)
        own, strange = rows[fit], rows[~fit]
        near = (q[own] / qn[own, None]) @ unit
        near = near if largest else -near
        if len(plain) > most:
            near = np.flatnonzero(near >= np.partition(near, len(plain) - most, axis=1)[:, [len(plain) - most]] - slack)
        else:
            near = np.arange(near.size)
        i, j = np.divmod(near, max(1, len(plain)))
        i = np.concatenate([own[i], np.repeat(own, len(odd)), np.repeat(strange, len(p))])
        j = np.concatenate([plain[j], np.tile(odd, len(own)), np.tile(everything, len(strange))])
        score = _scores(q, qn, p, pn, i, j, pool_first)
        fine = np.isfinite(score)
        i, j, score = i[fine], j[fine], score[fine]
        order = np.lexsort((j, -score if largest else score, i))
        i, j, score = i[order], j[order], score[order]
        turn = np.arange(len(i)) - np.searchsorted(i, i)
        fine = turn < k[i]
        found.append((i[fine], kept[j[fine]], score[fine]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _meeting(names: list[str], kind: pa.Schema, largest: bool, pool_first: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def meet(queries: pa.Table, pool: pa.Table) -> pa.Table:
        pool = pool.take(pc.sort_indices(pool["id"], null_placement="at_start")) if pool.num_rows > 1 else pool
        k = queries["k"].to_numpy()
        vecs, out = {x.shape[1]: (at, x, n) for at, x, n in matrices(pool["vec"])}, []
        for at, q, qn in matrices(queries["vec"]):
            if q.shape[1] in vecs:
                rows, p, pn = vecs[q.shape[1]]
                i, j, score = best(q, qn, k[at], p, pn, largest, pool_first)
                a, b = queries.take(pa.array(at[i])), pool.take(pa.array(rows[j]))
                out.append(pa.table([*((a if c in a.column_names else b)[c] for c in names), pa.array(score)], schema=kind))
        return pa.concat_tables(out) if out else kind.empty_table()

    return meet


def block_best(queries: DataFrame, pool: DataFrame, on: list[str], largest: bool = True, pool_first: bool = False) -> DataFrame:
    """``queries`` (``on``, query_id, vec, k and others) and ``pool`` (``on``, id, vec and others) without vec, joined with
    ``score``: among the lines are each query's k best by cosine of the rows with the same ``on`` columns, ties to the
    smaller id; they are still to be ranked, as every block of the pool gives its own k best.

    Both sides are cut into blocks within each key, by hashes of whole rows, and every two blocks meet in one group: no
    task holds a whole hot key, and no row stands for a pair. ``queries`` are read twice.
    """
    keys = on or ["__all"]
    if not on:
        queries, pool = queries.withColumn("__all", F.lit(0)), pool.withColumn("__all", F.lit(0))

    def parts(df: DataFrame, rows: int, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))

    def block(df: DataFrame, name: str) -> Column:
        return F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys]), F.col(name)).cast("int")

    def every(name: str) -> Column:
        return F.explode(F.expr(f"sequence(0, {name} - 1)"))

    cut = small(parts(queries, QUERY_ROWS, "__q").join(parts(pool, POOL_ROWS, "__p"), keys), "blocks")
    asking = queries.join(cut, keys).select(*queries.columns, block(queries, "__q").alias("__qb"), every("__p").alias("__pb"))
    given = pool.join(cut, keys).select(*pool.columns, block(pool, "__p").alias("__pb"), every("__q").alias("__qb"))
    fields = [f for f in queries.schema.fields if f.name != "vec"] + [f for f in pool.schema.fields if f.name != "vec" and f.name not in keys]
    schema = StructType([*fields, StructField("score", DoubleType())])
    group = [*keys, "__qb", "__pb"]
    meet = _meeting([f.name for f in fields], to_arrow_schema(schema), largest, pool_first)
    return asking.groupBy(*group).cogroup(given.groupBy(*group)).applyInArrow(meet, schema).drop("__all")


def nearest_udf(receivers: pa.Table, k: int, largest: bool) -> Callable[..., Column]:
    """Of a vector and its group: the numbers (``at``) and scores of the group's ``k`` best ``receivers`` (__g, __at in
    order, vec), best first."""
    group, number = receivers["__g"].to_numpy(), receivers["__at"].to_numpy()
    ours = {}
    for at, x, n in matrices(receivers["vec"]):
        for g in np.unique(group[at]):
            own = group[at] == g
            ours[int(g), x.shape[1]] = number[at][own], x[own], n[own]

    @F.arrow_udf("array<struct<at: int, score: double>>")
    def nearest_of(vec: pa.Array, g: pa.Array) -> pa.Array:
        key = g.fill_null(0).to_numpy(zero_copy_only=False)
        i, at, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0)]
        for own, q, qn in matrices(vec):
            for one in np.unique(key[own]):
                mine = np.flatnonzero(key[own] == one)
                if (int(one), q.shape[1]) in ours:
                    names, p, pn = ours[int(one), q.shape[1]]
                    a, b, c = best(q[mine], qn[mine], np.full(len(mine), k), p, pn, largest)
                    i.append(own[mine[a]])
                    at.append(names[b])
                    score.append(c)
        i, at, score = np.concatenate(i), np.concatenate(at), np.concatenate(score)
        order = np.argsort(i, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(i, minlength=len(vec)))]).astype(np.int32)
        items = pa.StructArray.from_arrays([pa.array(at[order], pa.int32()), pa.array(score[order])], ["at", "score"])
        return pa.ListArray.from_arrays(pa.array(ends), items)

    return nearest_of
