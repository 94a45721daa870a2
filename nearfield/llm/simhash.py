"""SimHash near-duplicates (operator 4), candidates pruned by the pigeonring principle.

A 64-bit fingerprint is a ring of four 16-bit segments. If two fingerprints differ in at most ``radius`` bits, then from
some segment on, every chain of l consecutive segments differs in at most l * radius / 4 bits. So for radius 3 there is
a start whose own segment is equal, whose first two segments differ in one bit at most, the first three in two. The
first two conditions make a 32-bit join key: of two second segments that differ in one bit one has an even number of bits,
and only that one carries its one-bit variants. The third condition and the full distance are checked on each candidate,
and a pair is emitted at its first such start only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import extended, release
from nearfield.sources.scratch import forget, measured, sided, written

_BLOCK = 1 << 16


def fingerprint(text: str | None, n: int = 3) -> int:
    """SimHash of a whole text: bit i is 1 if set in over half the XXH64 (seed 42) of its n-word shingles.

    A-Z are lower-cased; words are runs of characters other than space and \\x09-\\x0D; repeats count; fewer than n words
    are one shingle, none give 0.
    """
    words = (text or "").encode().lower().split()  # bytes.lower and bytes.split know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], "<u8")
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts, digest = [0, *ends[:-n].tolist()], xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=True)), "<u8", len(starts))
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _BLOCK):
        part = hashes[k : k + _BLOCK]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, fp): one row for each row of ``docs``, fp as a signed 64-bit integer. A null text has fingerprint 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), n) for t in batch.column("text")], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _segment(fp: str, start: str, step: int) -> str:
    return f"(shiftright({fp}, 16 * (({start} + {step}) % 4)) & 65535L)"


def _first_start(x: Column, radius: int) -> Column:
    """The first start from which all chains of segments of the difference ``x`` are within budget; null if none is."""
    d = [F.bit_count(F.shiftright(x, 16 * j).bitwiseAND(F.lit(65535))) for j in range(4)]
    out = F.lit(None).cast("int")
    for i in reversed(range(4)):
        chains = [reduce(Column.__add__, [d[(i + k) % 4] for k in range(size)]) <= size * radius // 4 for size in (1, 2, 3, 4)]
        out = F.when(reduce(Column.__and__, chains), F.lit(i)).otherwise(out)
    return out


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b), a < b: each pair of the distinct fingerprints (column fp) that differs in at most ``radius`` bits, once.

    Neither side of the join is broadcast: Spark takes both for as large as ``distinct``, of which they are many times.
    """
    if not 0 <= radius <= 3:
        raise ValueError("radius must be from 0 to 3: the join key holds two chained segments of a ring of four")
    starts = distinct.select("fp", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("start"))
    key = lambda second: F.expr(f"shiftleft(cast(start AS bigint), 32) | shiftleft({_segment('fp', 'start', 0)}, 16) | ({second})")
    second = _segment("fp", "start", 1)
    base = starts.select(key(second).alias("key"), F.col("fp").alias("b"))
    # second segments one bit apart have an odd and an even number of bits: only the even one carries its variants
    same = F.array(F.lit(0)).cast("array<bigint>")
    flips = F.array(F.lit(0), *[F.lit(1 << k) for k in range(16)]).cast("array<bigint>")
    variants = F.when(F.expr(f"bit_count({second}) % 2 = 0"), flips).otherwise(same)
    probe = starts.select("fp", "start", F.explode(variants).alias("flip")).select(key(f"{second} ^ flip").alias("key"), F.col("fp").alias("a"))
    start = F.shiftright("key", 32)
    x = F.col("a").bitwiseXOR(F.col("b"))
    # a pair of equal second segments meets twice, one of unequal ones once
    once = (F.col("a") < F.col("b")) | (F.expr(_segment("(a ^ b)", "cast(shiftright(key, 32) AS int)", 1)) != 0)
    return probe.join(base.hint("merge"), "key").where(once & (_first_start(x, radius) == start)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over ``edges`` (a, b), for every node that has an edge.

    Each round takes the smallest label among the neighbours and then the label's own label, so that distances halve; a
    round's labels are written to the shared folder, and it ends when a round changes nothing.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")), "edges")
    labels, _, size = measured(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:  # as many labels in each round
        seen = both.join(sided(labels, size), both.b == labels.node).select(F.col("a").alias("node"), "label")
        near = written(labels.union(seen).groupBy("node").agg(F.min("label").alias("label")), "labels")
        up = near.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = written(near.join(sided(up, size), "label").select("node", F.col("above").alias("label")), "labels")
        changed = new.join(sided(labels, size), "node").where(new.label != labels.label).limit(1).count()
        forget(near, labels)
        labels = new
        if not changed:
            forget(both)
            return labels


def near_duplicates(docs: DataFrame, n: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint as 16 lowercase hex digits, component_id): one row for each row of ``docs``.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest doc_id reachable over links.
    A null or empty text has fingerprint 0 and links like any other; repeated rows stay and share a component; null
    doc_ids stay and never name a component unless all of it is null; an empty table gives no rows. Tables with a row for
    each fingerprint are never broadcast: a row is a few bytes, so moving both sides costs little.
    """
    found = written(fingerprints(docs, n), "fingerprints")
    nodes = written(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    labels = components(links(nodes, radius))
    linked = written(nodes.join(labels.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label")), "linked")
    smallest = linked.where("label <> fp OR first IS NOT NULL").groupBy("label").agg(F.min("first").alias("component_id"))
    classes = written(linked.join(smallest.hint("merge"), "label", "left").select("fp", "component_id"), "classes")
    return found.join(classes.hint("merge"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_rows(rows: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """One of the written ``rows`` (with doc_id, text and a unique __row) of each component: that with the smallest doc_id,
    nulls last, ties to the smallest hash of the text. ``labels`` (node, label) link values of ``key``; others stand alone."""
    own = rows.select(F.col(key).alias("node"), F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", F.xxhash64("text").alias("h"), "__row").alias("row"))
    nodes = own.groupBy("node").agg(F.min("row").alias("row")).join(labels.hint("merge"), "node", "left")
    first = written(nodes.groupBy(F.coalesce("label", "node")).agg(F.min("row").alias("row")).select(F.col("row.__row").alias("__row")), "first")
    gone, _, size = measured(rows.select("__row").join(first.hint("merge"), "__row", "left_anti"), "gone")
    return rows.join(sided(gone, size), "__row", "left_anti")  # mostly few are gone: then no text is shuffled


def keep_first(docs: DataFrame, n: int = 3, radius: int = 3) -> DataFrame:
    """One row of each component of near-duplicates, by ``first_rows``. Rows are told apart whether or not their doc_ids
    repeat or are null. All columns are kept."""
    numbered = docs.withColumn("__row", F.monotonically_increasing_id()).withColumn("__text", F.col("text").cast("string"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), n) for t in batch.column("__text")], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], [*batch.schema.names, "__fp"])
        release()

    rows = written(numbered.mapInArrow(run, extended(numbered.schema, __fp="long")).drop("__text"), "fingerprints")
    nodes = written(rows.select(F.col("__fp").alias("fp")).distinct(), "nodes")
    return first_rows(rows, "__fp", components(links(nodes, radius))).select(*docs.columns)


def op4_simhash_pigeonring(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
