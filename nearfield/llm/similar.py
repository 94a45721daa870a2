"""Near-duplicates by exact Jaccard similarity of word shingles (``one_of_each_similar`` of the pipeline).

Two sets of a Jaccard similarity of at least ``least`` share an element among the first n - ceil(least * n) + 1 of their n
elements, whatever the common order. The order takes shingles that are common in a sample last, so that few texts meet by
chance; it decides how many candidates there are, never which pairs are found. Every candidate is verified exactly.

A first round compares the texts that share a shingle with one of them only; a second one compares those that are in
different components still. So a large group of near copies costs no square of its size, and no pair is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import extended
from nearfield.sources.scratch import written
from nearfield.llm.simhash import components, first_rows

#: Rows in whose texts common shingles are looked for, and how many of these the order knows of.
SAMPLE_ROWS = 10_000
COMMON = 100_000


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """The distinct XXH64 (seed 42) of a text's n-word shingles, ascending; words, case and short texts as in simhash."""
    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], "<u8")
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, digest = [0, *ends[:-n].tolist()], xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=True)), "<u8", len(starts)))


def _hashes(rows: DataFrame, n: int) -> DataFrame:
    """(__set, hashes) of rows (__set, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), n).view("<i8") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("__set"), pa.array(found, pa.list_(pa.int64()))], ["__set", "hashes"])

    return rows.select("__set", F.col("text").cast("string").alias("text")).mapInArrow(run, "__set long, hashes array<long>")


def _common(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample have, ascending, and how many have each."""
    share = max(1, docs.count() // SAMPLE_ROWS)
    sample = docs.select(F.xxhash64("text").alias("__set"), "text").where(F.pmod("__set", F.lit(share)) == 0).dropDuplicates(["__set"])
    counts = _hashes(sample, n).select(F.explode("hashes").alias("h")).groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).collect()
    own = np.array(sorted((r.h % (1 << 64), r["count"]) for r in counts), "<u8").reshape(-1, 2)
    return own[:, 0].copy(), own[:, 1].copy()


def prefix(found: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The elements of a set one of which it shares with every set that is similar enough."""
    size = min(len(found), len(found) - math.ceil(least * len(found) - 1e-9) + 1)
    seen = np.zeros(len(found), "<u8")
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], found), len(common[0]) - 1)
        seen = np.where(common[0][at] == found, common[1][at], 0)
    return found[np.lexsort((found, seen))[:size]]


def _verified(pairs: DataFrame, hashes: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar enough."""
    a, b = (hashes.select(F.col("__set").alias(x), F.col("hashes").alias(f"h{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").withColumn("same", F.size(F.array_intersect("ha", "hb")))
    return written(both.where(F.col("same") / (F.size("ha") + F.size("hb") - F.col("same")) >= least).select("a", "b"), "similar")


def keep_first(docs: DataFrame, n: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each component of near-duplicates, that with the smallest doc_id (nulls last, ties to the smallest hash of
    the text). Texts link if the Jaccard similarity of their sets of n-word shingles is at least ``least``.

    A null text counts as empty, and texts without words are alike. All columns are kept; an empty table gives no rows.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    common = _common(docs, n)
    numbered = docs.withColumn("__row", F.monotonically_increasing_id()).withColumn("__text", F.col("text").cast("string"))
    schema = extended(numbered.schema, __set="long", __n="int", __prefix="array<long>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, prefixes = [], [], []
            for t in batch.column("__text"):
                found = shingles(t.as_py(), n)
                ids.append(xxhash.xxh64_intdigest(found.tobytes(), 42))
                sizes.append(len(found))
                prefixes.append(prefix(found, common, least).view("<i8"))
            more = [pa.array(np.array(ids, "<u8").view("<i8")), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "__set", "__n", "__prefix"])

    rows = written(numbered.mapInArrow(run, schema).drop("__text"), "shingled")
    sets = rows.groupBy("__set").agg(F.min("__row").alias("__row"))
    tokens = rows.join(sets, ["__set", "__row"], "left_semi").select("__set", "__row", "__n", F.explode("__prefix").alias("token"))
    leaders = tokens.groupBy("token").agg(F.min("__set").alias("leader"), F.count("*").alias("m")).where("m > 1").select("token", "leader")
    shared = written(tokens.join(leaders, "token"), "shared")
    hashes = written(_hashes(rows.join(shared.select("__row").distinct(), "__row", "left_semi"), n), "hashes")
    near = _verified(shared.where("leader <> __set").select(F.col("leader").alias("a"), F.col("__set").alias("b")).distinct(), hashes, least)
    labels = components(near)
    # what shares a shingle and isn't in one component yet
    labelled = shared.join(labels.withColumnRenamed("node", "__set"), "__set", "left").select("token", "__set", "__n", F.coalesce("label", "__set").alias("label"))
    open_ = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token")
    left = written(labelled.join(open_, "token", "left_semi"), "open")
    a, b = (left.select("token", F.col("__set").alias(x), F.col("__n").alias(f"n{x}"), F.col("label").alias(f"l{x}")) for x in "ab")
    pairs = a.join(b, "token").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & (F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb") - 1e-6))
    more = _verified(pairs.select("a", "b").distinct(), hashes, least)
    if more.limit(1).count():
        labels = components(near.union(more))
    return first_rows(rows, "__set", labels).select(*docs.columns)
