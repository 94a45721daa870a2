"""Line dedup (operator 7): a suffix array over line-ID sequences by distributed prefix doubling.

Every text is a sequence of line IDs (128-bit hashes). ``ranks[k]`` orders the suffixes that begin at each line by their
first 2**k lines: rank 0 orders the lines themselves, and rank k+1 of a line refines its rank k by the rank k of the line
2**k further on. Suffixes whose first 2**k lines occur nowhere else are discarded on the way, so each round is smaller.
Doubling ends when ranks cover the longest run asked about.

A run of lines of length n is a prefix of its suffix; all suffixes that share it form one LCP interval of the suffix
array. The interval is found from two ranks, those of the first and of the last 2**k lines of the run (2**k <= n <
2**(k+1)). Of each interval's runs the first in (doc_id, line) order stays and the lines of later ones are deleted. It is
enough to ask about two runs per line, the shortest of at least ``min_words`` words that begins there and that ends there:
any longer repeated run is the union of such runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import extended, release
from nearfield.sources.scratch import forget, written

MIN_WORDS = 50
_NO_ID = -(1 << 63)
#: Rows of one rank are dealt over so many ranges of the next rank when they are counted up.
_RANGES = 256
#: A key that holds more than one in so many of the rows of a join is hot; so there are fewer hot keys than this at any size.
_HOT = 2000


def _windows(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Per line, the lines of the shortest run of at least ``least`` words that begins there, and that ends there; 0 for none."""
    upto = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    end = np.searchsorted(upto, upto[:-1] + least, side="left")
    ahead = np.where(end <= n, end - np.arange(n), 0)
    begin = np.searchsorted(upto, upto[1:] - least, side="right") - 1
    behind = np.where(upto[1:] >= least, np.arange(n) + 1 - begin, 0)
    return ahead, behind


def lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(id, th, ln, h1, h2, ahead, behind): one row for each line. A text is known by doc_id and its own hash; a null
    doc_id counts as the smallest integer and a null text as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(7)]
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = (t.as_py() or "").split("\n")
                raw = [x.encode() for x in own]
                n = len(own)
                h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in raw]), ">i8").reshape(n, 2)
                ahead, behind = _windows(np.array([len(x.split()) for x in raw]), min_words)
                th = np.uint64(xxhash.xxh64_intdigest(b"\n".join(raw), 42)).astype(np.int64)  # as Spark's xxhash64
                for c, v in zip(cols, (np.full(n, _NO_ID if i is None else i), np.full(n, th), np.arange(n), h[:, 0], h[:, 1], ahead, behind), strict=True):
                    c.append(v)
            if cols[0]:
                types = ("<i8", "<i8", "<i4", "<i8", "<i8", "<i4", "<i4")
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t)) for c, t in zip(cols, types, strict=True)], ["id", "th", "ln", "h1", "h2", "ahead", "behind"])
        release()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "id long, th long, ln int, h1 long, h2 long, ahead int, behind int")


def _counted_up(groups: DataFrame, by: list[str], order: list[str], bucket: Column) -> DataFrame:
    """``groups`` (with a count ``n``) and ``before``: how many rows of the same ``by`` have a smaller ``order``.

    Two levels, so that no window holds a whole hot key: sums per bucket (monotone in the order) are counted up first.
    """
    groups = groups.withColumn("bucket", bucket)
    w = ", ".join(by + ["bucket"])
    sums = groups.groupBy(*by, "bucket").agg(F.sum("n").alias("all"))
    partition = f"PARTITION BY {', '.join(by)} " if by else ""
    sums = sums.selectExpr(*by, "bucket", f"sum(all) OVER ({partition}ORDER BY bucket) - all AS base")
    inner = groups.withColumn("inner", F.expr(f"sum(n) OVER (PARTITION BY {w} ORDER BY {', '.join(order)}) - n"))
    return inner.join(sums, [*by, "bucket"]).withColumn("before", F.col("base") + F.col("inner")).drop("bucket", "base", "inner")


def _joined(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined to the written ``groups``: one row for each key that counts, with the number ``n`` of the key's rows.

    Rows of hot keys stay where they are and meet a broadcast of fewer than ``_HOT`` groups; the others are shuffled.
    """
    bar = (groups.agg(F.sum("n")).first()[0] or 0) // _HOT
    hot, cold = F.broadcast(groups.where(F.col("n") > bar).drop("n")), groups.where(F.col("n") <= bar).drop("n")
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def suffix_ranks(table: DataFrame, longest: int) -> list[DataFrame]:
    """``ranks[k]``: (id, th, ln, r) of the lines whose first 2**k lines occur elsewhere too, while 2**k <= ``longest``."""
    repeated = table.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    first = written(_counted_up(repeated, [], ["h1", "h2"], F.shiftright("h1", 48)).select("h1", "h2", "n", F.col("before").alias("r")), "groups")
    ranks = [written(_joined(table.select("id", "th", "ln", "h1", "h2"), first, ["h1", "h2"]).select("id", "th", "ln", "r"), "ranks")]
    forget(first)
    size = 1
    while 2 * size <= longest:
        now = ranks[-1]
        step = F.lit((now.agg(F.max("r")).first()[0] or 0) // _RANGES + 1)
        further = now.select("id", "th", (F.col("ln") - size).alias("ln"), F.col("r").alias("s"))
        pairs = written(now.join(further, ["id", "th", "ln"]), "pairs")
        repeated = pairs.groupBy("r", "s").agg(F.count("*").alias("n")).where("n > 1")
        finer = written(_counted_up(repeated, ["r"], ["s"], F.floor(F.col("s") / step)).select("r", "s", "n", (F.col("r") + F.col("before")).alias("finer")), "groups")
        ranks.append(written(_joined(pairs, finer, ["r", "s"]).select("id", "th", "ln", F.col("finer").alias("r")), "ranks"))
        forget(pairs, finer)
        size *= 2
    return ranks


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, start, size): runs of lines of at least ``min_words`` words that occur earlier, in (doc_id, line) order.

    Overlapping runs are not merged here; a text's union of them is what later copies lose.
    """
    table = written(lines(docs, min_words), "lines")
    if table.where("ln = 0").groupBy("id", "th").count().where("count > 1").limit(1).count():
        # repeated rows are one text: each doubling would pair their lines with one another
        once = written(table.dropDuplicates(["id", "th", "ln"]), "lines")
        forget(table)
        table = once
    longest = table.agg(F.max(F.greatest("ahead", "behind"))).first()[0] or 0
    ranks = suffix_ranks(table, longest)
    sizes = F.array_distinct(F.array(F.struct(F.col("ln").alias("start"), F.col("ahead").alias("size")), F.struct((F.col("ln") - F.col("behind") + 1).alias("start"), F.col("behind").alias("size"))))
    asked = table.where("ahead > 0 OR behind > 0").select("id", "th", F.explode(sizes).alias("w")).select("id", "th", "w.start", "w.size").where("size > 0").distinct()
    asked = asked.withColumn("k", F.floor(F.log2("size")).cast("int"))
    every = None
    for k, r in enumerate(ranks):
        r = r.withColumn("k", F.lit(k))
        every = r if every is None else every.unionByName(r)
    head = every.select("k", "id", "th", F.col("ln").alias("start"), F.col("r").alias("a"))
    tail = every.select("k", "id", "th", F.col("ln").alias("last"), F.col("r").alias("b"))
    found = asked.join(head, ["k", "id", "th", "start"]).withColumn("last", F.expr("start + size - shiftleft(1, k)")).join(tail, ["k", "id", "th", "last"])
    found = written(found.select("id", "th", "start", "size", "a", "b"), "runs")
    earliest = written(found.groupBy("size", "a", "b").agg(F.min(F.struct("id", "th", "start")).alias("first"), F.count("*").alias("n")).where("n > 1"), "groups")
    later = written(_joined(found, earliest, ["size", "a", "b"]).where(F.struct("id", "th", "start") > F.col("first")).select("id", "th", "start", "size"), "later")
    forget(table, found, earliest, *ranks)
    return later


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the lines of later copies of repeated runs, and with n_lines and n_removed (long).

    All other columns stay (columns named n_lines or n_removed are replaced). Repeated rows (same doc_id and text) count
    as one text and keep the same lines; of texts with one doc_id the one with the smaller hash comes first, null doc_ids
    before others. Null and empty texts are one empty line and never lose it. An empty table gives an empty table.
    """
    docs = docs.drop("n_lines", "n_removed")
    later = repeated_runs(docs, min_words).groupBy(F.col("id").alias("__id"), F.col("th").alias("__of")).agg(F.collect_list("start").alias("__starts"), F.collect_list("size").alias("__sizes"))

    known = docs.withColumn("__th", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    both = known.join(later, (F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)) == F.col("__id")) & (F.col("__th") == F.col("__of")), "left").drop("__id", "__of", "__th")
    schema, names = extended(docs.schema, n_lines="long", n_removed="long"), docs.columns

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            texts, n, gone = [], [], []
            for t, starts, sizes in zip(batch.column("text"), batch.column("__starts"), batch.column("__sizes"), strict=True):
                text = t.as_py()
                own = (text or "").split("\n")
                n.append(len(own))
                if not starts.is_valid:
                    gone.append(0)
                    texts.append(text)
                    continue
                marks = np.zeros(len(own) + 1, np.int64)
                np.add.at(marks, starts.values.to_numpy(), 1)
                np.add.at(marks, starts.values.to_numpy() + sizes.values.to_numpy(), -1)
                drop = np.cumsum(marks)[:-1] > 0
                gone.append(int(drop.sum()))
                texts.append("\n".join([x for x, d in zip(own, drop.tolist(), strict=True) if not d]))
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], schema.names)
        release()

    return both.mapInArrow(cut, schema)


def op7_line_runs(spark, sf_dir: str) -> DataFrame:
    """Per document: its lines, the lines that repeat an earlier run, and the SHA-256 of the text that is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    left = remove_repeats(docs)
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("left_sha256"))


OP7_SQL = f"""
WITH own AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i AS ln, ls[i] AS line, len(list_filter(regexp_split_to_array(ls[i], '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS w
  FROM own, unnest(range(1, len(ls) + 1)) AS u(i)),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY ln) AS cw FROM l),
win AS (
  SELECT a.doc_id, a.ln AS s, min(e.ln) AS e FROM c a JOIN c e ON a.doc_id = e.doc_id AND e.ln >= a.ln AND e.cw - a.cw + a.w >= {MIN_WORDS} GROUP BY ALL
  UNION
  SELECT e.doc_id, max(a.ln) AS s, e.ln AS e FROM c a JOIN c e ON a.doc_id = e.doc_id AND e.ln >= a.ln AND e.cw - a.cw + a.w >= {MIN_WORDS} GROUP BY e.doc_id, e.ln),
run AS (SELECT win.*, array_to_string(ls[s:e], chr(10)) AS body FROM win JOIN own USING (doc_id)),
later AS (SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS k FROM run) WHERE k > 1),
gone AS (SELECT DISTINCT l.doc_id, ln FROM l JOIN later ON l.doc_id = later.doc_id AND ln BETWEEN s AND e)
SELECT l.doc_id, count(*) AS n_lines, count(gone.ln) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY l.ln) FILTER (WHERE gone.ln IS NULL), '')) AS left_sha256
FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.ln = gone.ln GROUP BY l.doc_id
"""
