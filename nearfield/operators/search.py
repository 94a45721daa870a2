"""Exact k-nearest and k-furthest search.

A search ranks by a metric; pairs without a score (unequal lengths, a single zero vector, NaN or infinite scores) are
never selected. Ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.vectors import Metric, cosine, l1_distance, norm
from nearfield.operators.blocks import block_best, nearest_udf
from nearfield.sources.scratch import BROADCAST_BYTES, measured, written

#: Rows of a block, where a side is too large to stand beside every row of the other.
BLOCK_ROWS = 1024


def usable(score: Column | str) -> Column:
    """Whether a score may enter a result."""
    s = F.col(score) if isinstance(score, str) else score
    return s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf"))


def _check_k(k: int) -> None:
    if k < 0:
        raise ValueError("k must not be negative")


def top_k(pool: DataFrame, target: Column, k: int, metric: Metric = cosine, largest: bool = True, id: str = "id", value: str = "vec") -> DataFrame:
    """(id, rank, score): the k rows of ``pool`` that score best against one target; a distributed top-k without a sort of all rows."""
    _check_k(k)
    scored = pool.select(F.col(id), metric(F.col(value), target).alias("score")).where(usable("score"))
    best = scored.orderBy(F.desc("score") if largest else F.asc("score"), id).limit(k)
    order = Window.orderBy(F.desc("score") if largest else F.asc("score"), id)  # over k rows only
    return best.select(id, F.row_number().over(order).alias("rank"), "score")


def knn_cos(pool: DataFrame, target: Column, k: int, **names: str) -> DataFrame:
    """Most similar by cosine."""
    return top_k(pool, target, k, cosine, True, **names)


def kfn_cos(pool: DataFrame, target: Column, k: int, **names: str) -> DataFrame:
    """Least similar by cosine."""
    return top_k(pool, target, k, cosine, False, **names)


def knn_l1(pool: DataFrame, target: Column, k: int, **names: str) -> DataFrame:
    """Smallest sum of absolute differences."""
    return top_k(pool, target, k, l1_distance, False, **names)


def kfn_l1(pool: DataFrame, target: Column, k: int, **names: str) -> DataFrame:
    """Largest sum of absolute differences."""
    return top_k(pool, target, k, l1_distance, True, **names)


def _scored(rows: DataFrame, k: int, value: str, metric: Metric | None, largest: bool) -> DataFrame:
    """``rows`` (with ``value``, its norm __n and receivers rs) with __best: the k best usable (s, id), smaller s first."""
    sign = -1.0 if largest else 1.0

    def score(r: Column) -> Column:
        return cosine(F.col(value), r["v"], F.col("__n"), r["n"]) if metric is None else metric(F.col(value), r["v"])

    good = F.filter(F.transform("rs", lambda r: F.struct((score(r) * sign).alias("s"), r["id"].alias("id"))), lambda e: usable(e["s"]))
    best = F.filter(F.array(F.array_min(good)), lambda e: e.isNotNull()) if k == 1 else F.slice(F.array_sort(good), 1, k)
    return rows.withColumn("__best", best).drop("rs", "__n")


def _nearest_cosine(points: DataFrame, table: DataFrame, k: int, on: list[str], receiver: str, value: str, largest: bool, keep: bool) -> DataFrame:
    """``nearest`` by cosine, of receivers ``table`` (``on``, id, v) that each task can hold; they are numbered by key and id."""
    group = F.dense_rank().over(Window.orderBy(*on)) if on else F.lit(1)  # over receivers alone
    turn = F.row_number().over(Window.orderBy(*on, "id"))
    numbered = written(table.select(*on, "id", "v", group.cast("int").alias("__g"), turn.alias("__at")), "receivers")
    dealt = points.join(F.broadcast(numbered.select(*on, "__g").distinct()), on, "left") if on else points.withColumn("__g", F.lit(1))
    own = numbered.orderBy("__at").select("__g", "__at", F.col("v").alias("vec")).toArrow()
    found = dealt.withColumn("__best", nearest_udf(own, k, largest)(F.col(value), "__g"))
    found = found.select(*points.columns, (F.posexplode_outer if keep else F.posexplode)("__best").alias("__pos", "__e"))
    found = found.select(*points.columns, F.col("__e.at").alias("__at"), (F.col("__pos") + 1).alias("rank"), F.col("__e.score").alias("score"))
    named = found.join(F.broadcast(numbered.select("__at", F.col("id").alias(receiver))), "__at", "left")
    return named.select(*points.columns, receiver, "rank", "score")


def nearest(
    points: DataFrame, receivers: DataFrame, k: int, on: list[str] | None = None, receiver: str = "receiver_id", value: str = "vec", metric: Metric | None = None, largest: bool = True, keep: bool = False, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """``points`` with ``receiver_id``, ``rank`` and ``score``: each row's k best receivers among those with the same ``on``
    columns, ties to the smaller receiver. With ``keep``, rows without any have one line of nulls. Columns of these three
    names are replaced. Every row of ``points`` is a point of its own, whatever its columns repeat.

    By cosine, receivers of at most ``limit`` bytes go to every task as matrices: neither a row per pair nor a shuffle of
    points. By another metric they are packed into one array per ``on`` key that stands beside each point. Beyond, points
    and receivers meet in blocks dealt by ``on`` and block, so that no task holds a whole hot key, and the blocks' best are
    ranked once more per numbered point. All give the same rows.
    """
    _check_k(k)
    on = on or []
    points = points.drop(receiver, "rank", "score")
    table, n, size = measured(receivers.select(*on, F.col(receiver).alias("id"), F.col(value).alias("v"), norm(value).alias("n")), "receivers")
    if metric is None and size <= limit:
        return _nearest_cosine(points, table, k, on, receiver, value, largest, keep)
    if size <= limit:
        packed = F.broadcast(table.groupBy(*on).agg(F.collect_list(F.struct("id", "v", "n")).alias("rs")))
        rows = points.withColumn("__n", norm(value))
        found = _scored(rows.join(packed, on, "left") if on else rows.join(packed, F.lit(True), "left"), k, value, metric, largest)
    else:
        blocks = -(-n // BLOCK_ROWS)
        block = F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("__block")
        packed = table.groupBy(*on, block).agg(F.collect_list(F.struct("id", "v", "n")).alias("rs"))
        numbered = written(points.withColumn("__row", F.monotonically_increasing_id()), "points")
        dealt = numbered.select("__row", *on, value, norm(value).alias("__n"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__block"))
        each = _scored(dealt.join(packed, [*on, "__block"]), k, value, metric, largest).select("__row", "__best")
        all_best = each.groupBy("__row").agg(F.slice(F.array_sort(F.flatten(F.collect_list("__best"))), 1, k).alias("__best"))
        found = numbered.join(all_best, "__row", "left").drop("__row")
    out = found.select("*", (F.posexplode_outer if keep else F.posexplode)("__best").alias("__pos", "__e"))
    return out.select(*points.columns, F.col("__e.id").alias(receiver), (F.col("__pos") + 1).alias("rank"), (F.col("__e.s") * (-1.0 if largest else 1.0)).alias("score"))


def knn_batch(queries: DataFrame, pool: DataFrame, k: int | Column, metric: Metric | None = None, largest: bool = True, on: list[str] | None = None) -> DataFrame:
    """(query_id, id, rank, score): k best rows of ``pool`` (id, vec) for each of ``queries`` (query_id, vec), among those
    with the same ``on`` columns; ``k`` may be a column of the queries.

    By cosine, blocks of queries meet blocks of the pool (``block_best``). By another metric, the queries are packed into
    blocks that meet every row of the pool once. Spark's window group limit keeps k rows per query and task before anything
    is shuffled.
    """
    if isinstance(k, int):
        _check_k(k)
    on, k = on or [], F.lit(k) if isinstance(k, int) else k
    order = Window.partitionBy("query_id").orderBy(F.desc("score") if largest else F.asc("score"), "id")
    if metric is None:
        asked = written(queries.select(*on, "query_id", "vec", k.cast("int").alias("k")).where("k > 0"), "queries")
        met = block_best(asked, pool.select(*on, "id", "vec"), on, largest, pool_first=True)
        return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("k")).select("query_id", "id", "rank", "score")
    table, n, size = measured(queries.select(*on, "query_id", "vec", k.alias("k")), "queries")
    block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // BLOCK_ROWS)))).alias("__block")
    packed = table.groupBy(*on, block).agg(F.collect_list(F.struct("query_id", F.col("vec").alias("v"), "k")).alias("rs"))
    packed = F.broadcast(packed) if size <= BROADCAST_BYTES else packed
    rows = pool.select(*on, "id", "vec")
    rows = rows.join(packed, on) if on else rows.crossJoin(packed)

    def score(q: Column) -> Column:
        return metric(F.col("vec"), q["v"])

    scores = F.filter(F.transform("rs", lambda q: F.struct(q["query_id"].alias("query_id"), q["k"].alias("k"), score(q).alias("score"))), lambda e: usable(e["score"]))
    pairs = rows.select("id", F.explode(scores).alias("e")).select("id", "e.*")
    most = table.agg(F.max("k")).first()[0] or 0
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.where(F.col("rank") <= F.col("k")).select("query_id", "id", "rank", "score")
