"""Mixing sources to target weights (operator 3) by Poisson replication.

A source of size s (characters) with target weight w of a mixture of size T is repeated w * T / s times on average: each
of its documents occurs k times, k drawn from the Poisson distribution with that mean by inverting its distribution
function at a uniform number that is a hash of doc_id and seed. The copies are then shuffled globally, in the order of
another hash. Counts depend on doc_id, seed and the rates alone, so a task that runs again draws the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from nearfield.sources.scratch import BROADCAST_BYTES, measured, written

SEED = 20240501
#: Weights where none are given: proportional to a source's size to this power (0: all sources alike, 1: as they are).
POWER = 0.5
#: Copies that a task makes of a document at most.
COPIES = 1000
#: Source tables too large to broadcast are joined by keys with so many salts.
_SALTS = 64


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


class _Inverse:
    """Inverts Poisson distributions; the distribution functions of the rates last asked about are kept."""

    def __init__(self, kept: int = 1_000_000):
        self.tables: dict[float, tuple[int, np.ndarray]] = {}
        self.kept = kept

    def table(self, rate: float) -> tuple[int, np.ndarray]:
        """(k, c): c[i] is the probability of at most k + i, for all counts within 12 deviations + 40 of ``rate``; outside
        lies less than 1e-30 of the whole. Far from 0, terms begin at the window's lower end and are normalised."""
        if rate not in self.tables:
            half = 12 * math.sqrt(rate) + 40
            low, high = max(0, math.floor(rate - half)), math.ceil(rate + half)
            logs = np.concatenate([[0.0], np.log(rate / np.arange(low + 1, high + 1))])
            if low:
                terms = np.cumsum(logs)
                found = np.cumsum(np.exp(terms - terms.max()))
                found /= found[-1]
            else:
                logs[0] = -rate
                found = np.cumsum(np.exp(np.cumsum(logs)))
            if sum(len(c) for _, c in self.tables.values()) + len(found) > self.kept:
                self.tables.clear()
            self.tables[rate] = low, found
        return self.tables[rate]

    def counts(self, u: np.ndarray, rates: np.ndarray) -> np.ndarray:
        """For each u in [0, 1) the smallest count whose distribution function at ``rates`` exceeds it."""
        out = np.zeros(len(u), np.int64)
        for rate in np.unique(rates[rates > 0]):
            at = np.flatnonzero(rates == rate)
            low, found = self.table(float(rate))
            out[at] = low + np.searchsorted(found, u[at], side="right")
        return out


@F.arrow_udf(LongType())
def _count(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    inverse = _Inverse()
    for u, rate in parts:
        yield pa.array(inverse.counts(np.asarray(u), np.asarray(rate)), pa.int64())


def _most(rate: float) -> int:
    """The largest count that a rate can draw."""
    return math.ceil(rate + 12 * math.sqrt(rate) + 40) + 1


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = POWER, total: float | None = None) -> DataFrame:
    """(source, size, rate): a row for each source. ``weights`` are the target shares (normalised; a source not named
    gets none); without them a share is proportional to size ** ``power``. ``total`` is the size of the mixture in
    characters, that of ``docs`` by default. A source without characters has rate 0 and is dropped from the mixture."""
    size = F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long")
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.sum(size).alias("size"))
    if weights is None:
        wanted = F.when(F.col("size") > 0, F.pow(F.col("size").cast("double"), F.lit(power))).otherwise(0.0)
    else:
        wanted, largest = F.lit(0.0), max([abs(float(v)) for v in weights.values()], default=0.0) or 1.0
        for k, v in weights.items():
            wanted = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v) / largest)).otherwise(wanted)
    sizes = written(sizes.withColumn("wanted", wanted), "sources")
    # decimals, so that the sum doesn't depend on the order of addition
    sums = sizes.agg(F.sum(F.col("wanted").cast("decimal(38, 14)")).alias("w"), F.sum("size").alias("t")).first()
    whole, mixture = float(sums.w or 0), float(total if total is not None else (sums.t or 0))
    if not whole:
        return sizes.select("source", "size", F.lit(0.0).alias("rate"))
    return sizes.select("source", "size", F.when(F.col("size") > 0, F.col("wanted") / whole * mixture / F.col("size")).otherwise(0.0).alias("rate"))


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = POWER, total: float | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` replicated to the target weights and globally shuffled, with ``copy`` (1 to k) and ``shuffle_key``.

    Columns of these two names are replaced. Rows with one doc_id draw the same count; null doc_ids count as the text
    "null"; a null source is a source of its own; rows of a source of rate 0 do not occur; an empty table gives an empty
    table. The result is range-partitioned by ``shuffle_key`` and sorted by it, ties by doc_id and copy. Where a source
    can draw more than ``COPIES`` copies, documents are dealt to tasks by so many copies each before they are replicated.
    """
    docs = docs.drop("copy", "shuffle_key")
    table, _, size = measured(rates(docs, weights, power, total).select(F.col("source").alias("__source"), F.col("rate").alias("__rate")), "rates")
    most = _most(table.agg(F.max("__rate")).first()[0] or 0.0)
    same = F.col("source").cast("string").eqNullSafe(F.col("__source"))
    if size <= BROADCAST_BYTES:
        both = docs.join(F.broadcast(table), same, "left")
    else:
        salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        both = docs.withColumn("__part", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)).cast("int")).join(salted, same & (F.col("__part") == F.col("__salt")), "left").drop("__part", "__salt")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    counted = both.withColumn("__n", _count(_uniform(F.lit("count"), F.lit(str(seed)), name), F.col("__rate"))).drop("__source", "__rate").where("__n > 0")
    first, last = F.lit(1).cast("long"), F.col("__n")
    if most > COPIES:
        counted = counted.withColumn("__first", F.explode(F.sequence(first, last, F.lit(COPIES).cast("long")))).repartition(parts, F.xxhash64("doc_id", "__first"))
        first, last = F.col("__first"), F.least(last, F.col("__first") + (COPIES - 1))
    copies = counted.withColumn("copy", F.explode(F.sequence(first, last))).drop("__n", "__first")
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit("order"), F.lit(str(seed)), name, F.col("copy").cast("string")).cast("binary")))
    return keyed.repartitionByRange(parts, "shuffle_key", "doc_id", "copy").sortWithinPartitions("shuffle_key", "doc_id", "copy")


def op3_poisson_mix(spark, sf_dir: str) -> DataFrame:
    """All documents, replicated so that each source weighs as the square root of its size, in shuffled order."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def mix_sql(docs: str, columns: str) -> str:
    """DuckDB SQL for ``mix`` over a table of distinct doc_ids; ``columns`` of the result besides copy and shuffle_key."""
    return f"""
SELECT {columns}, copy, md5('order:{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy) AS shuffle_key FROM (
  WITH sized AS (SELECT source, sum(length(coalesce(text, '')))::BIGINT AS size FROM {docs} GROUP BY source),
  wanted AS (SELECT *, CASE WHEN size > 0 THEN pow(size::DOUBLE, {POWER}) ELSE 0.0 END AS w FROM sized),
  whole AS (SELECT list_reduce(list(w ORDER BY coalesce(source, '')), lambda a, b: a + b) AS w, sum(size)::DOUBLE AS t FROM wanted),
  rate AS (SELECT source, CASE WHEN size > 0 THEN wanted.w / whole.w * t / size ELSE 0.0 END AS rate FROM wanted, whole),
  drawn AS (SELECT d.*, rate, ('0x' || substr(md5('count:{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
    FROM {docs} d JOIN rate r ON d.source IS NOT DISTINCT FROM r.source),
  cdf AS (SELECT source, k, sum(exp(CASE WHEN k = 0 THEN -rate ELSE lp END)) OVER (PARTITION BY source ORDER BY k) AS c FROM (
    SELECT source, rate, k, -rate + coalesce(sum(CASE WHEN k > 0 THEN ln(rate / k) END) OVER (PARTITION BY source ORDER BY k), 0) AS lp
    FROM rate, unnest(range(0, (ceil(rate + 12 * sqrt(rate) + 40) + 1)::BIGINT)) AS u(k) WHERE rate > 0)),
  times AS (SELECT drawn.source, drawn.u, count(*) AS n FROM (SELECT DISTINCT source, u FROM drawn) drawn JOIN cdf ON drawn.source IS NOT DISTINCT FROM cdf.source AND c <= u GROUP BY ALL)
  SELECT drawn.*, unnest(range(1, n + 1)) AS copy FROM drawn JOIN times ON drawn.source IS NOT DISTINCT FROM times.source AND drawn.u = times.u
)"""


OP3_SQL = mix_sql("documents", "doc_id, text, lang, source, n_chars")
