"""Quality rules (operator 2): base counts, and robust multivariate outliers per language and source.

All of it is DataFrame and SQL expressions. Five statistics of a text are transformed to logarithms and rounded to
thousandths, so that sums and sums of products are exact integers whatever the order of addition. Each group of language
and source has its own minimum-covariance-determinant estimate of location and scatter. From each of three starts,
concentration steps keep the three quarters of rows that lie nearest by Mahalanobis distance and estimate again from
them, until no group's rows change (after ``STEPS`` steps at most); the start that ends at the smallest determinant wins.
The starts are medians with quartile ranges, the mean and covariance of all rows, and medians with equal spreads.

The cut of each step comes from counts per bin of distance, whose width is a constant share of it, so no group is ever
gathered or sorted: a group of any size is some hundred pre-aggregated rows. All rows of the bin that the cut falls in
count as near.

A group's scatter is that of its rows and of ``PRIOR_ROWS`` further ones with stated spreads, and a floor is added: one
rule for groups of every size, under which a small or degenerate group still has a regular, cautious estimate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.sources.scratch import BROADCAST_BYTES, forget, measured, written

P = 5
SHARE = 0.75
STEPS = 20
STARTS = 3
CUT = 45.0
#: Least spread (in thousandths of a logarithm) added to each statistic's variance: a statistic that most rows share
#: exactly, such as "no symbols", else has none.
FLOORS = (60, 400, 1200, 600, 300)
#: Spreads (in thousandths of a logarithm) of the further rows that each group's scatter has.
PRIOR, PRIOR_ROWS = (150, 800, 1200, 800, 1000), 10
#: Estimates too large to broadcast are joined by keys with so many salts.
_SALTS = 64
#: Width of the statistics' bins that quartiles come from; bins of distance for each factor e.
_QBIN, _DBINS = 50, 64


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series."""
    term = total = 1 / a
    k = 0
    while term > 1e-16 * total:
        k += 1
        term *= x / (a + k)
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _consistency() -> float:
    """What the scatter of the nearest ``SHARE`` of normal rows is short by."""
    low, high = 0.0, 100.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _gamma_p(P / 2, mid / 2) < SHARE else (low, mid)
    return round(SHARE / _gamma_p(P / 2 + 1, low / 2), 6)


FACTOR = _consistency()
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
#: The transformed statistics, in SQL that Spark and DuckDB read alike.
STATISTICS = (
    "CAST(floor(1000 * ln(word_chars / CAST(n_words AS DOUBLE)) + 0.5) AS BIGINT)",
    "CAST(floor(1000 * ln(1 + 100 * (n_symbols / CAST(n_words AS DOUBLE))) + 0.5) AS BIGINT)",
    "CAST(floor(1000 * ln(1 + 1000 * (n_dup_lines / CAST(n_words AS DOUBLE))) + 0.5) AS BIGINT)",
    "CAST(floor(1000 * ln(1 + 100 * (n_repeat_words / CAST(n_words AS DOUBLE))) + 0.5) AS BIGINT)",
    "CAST(floor(1000 * ln(CAST(n_words AS DOUBLE)) + 0.5) AS BIGINT)",
)
BASE_FAILED = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that the text has twice or more (windows are compared by 64-bit hash)."""
    windows = F.sort_array(
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    )

    def twice(s: Column) -> Column:
        at = F.transform(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda k: F.when((F.get(s, k)["h"] == F.get(s, k - 1)["h"]) | (F.get(s, k)["h"] == F.get(s, k + 1)["h"]), F.get(s, k)["i"]).otherwise(-1),
        )
        return F.sort_array(F.filter(at, lambda i: i >= 0))

    def covered(p: Column) -> Column:
        """3 words for the first window, then as many as each next one begins after the one before it."""
        return F.when(F.size(p) == 0, F.lit(0)).otherwise(
            F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda n, k: n + F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), F.get(p, k) - F.get(p, k - 1))))
        )

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(_let(_let(windows, twice), covered))


def base_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), one row for each row of ``docs``.

    Words are runs of characters other than space and \\x09-\\x0D; a null or empty text has none, and all counts are 0.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    parts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+", -1), "").alias("words"),
        (F.length(text) - F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))).alias("spaces"), F.length(text).alias("size"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    return parts.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), (F.col("size") - F.col("spaces")).cast("long").alias("word_chars"),
        "n_symbols", "n_dup_lines", _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


#: Steps to ``d2`` from x0.. and a group's m0.., r1_0.. and v0..., each from those before it.
_SOLVED = [(f"y{i}", f"(x{i} - m{i})" + "".join(f" - r{i}_{j} * y{j}" for j in range(i))) for i in range(P)]
_SOLVED.append(("d2", " + ".join(f"y{i} * y{i} / v{i}" for i in range(P))))


def _decompose() -> list[tuple[str, str]]:
    """Columns of the LDL' decomposition of c{i}_{j}, each from those before it, and the determinant."""
    out: list[tuple[str, str]] = []
    for i in range(P):
        for j in range(i):
            out.append((f"u{i}_{j}", f"c{i}_{j}" + "".join(f" - u{i}_{k} * r{j}_{k}" for k in range(j))))
            out.append((f"r{i}_{j}", f"u{i}_{j} / v{j}"))
        out.append((f"v{i}", f"c{i}_{i}" + "".join(f" - u{i}_{k} * r{i}_{k}" for k in range(i))))
    return [*out, ("det", " * ".join(f"v{i}" for i in range(P)))]


_MOMENTS = [f"s{i}" for i in range(P)] + [f"s{i}_{j}" for i, j in PAIRS]
_DBIN = f"CAST(floor({_DBINS} * ln(1 + d2)) AS BIGINT)"
_PARAMS = [f"m{i}" for i in range(P)] + [f"r{i}_{j}" for i, j in PAIRS if i != j] + [f"v{i}" for i in range(P)]
#: Scatter from exact sums, in this very order of operations.
_FROM_SUMS = [f"CAST(s{i} AS DOUBLE) / n AS m{i}" for i in range(P)] + [
    f"(n * ((CAST(s{i}_{j} AS DOUBLE) / n - (CAST(s{i} AS DOUBLE) / n) * (CAST(s{j} AS DOUBLE) / n)) * {FACTOR})"
    + (f" + {PRIOR_ROWS * PRIOR[i] ** 2}) / (n + {PRIOR_ROWS}) + {FLOORS[i] ** 2}" if i == j else f") / (n + {PRIOR_ROWS})")
    + f" AS c{i}_{j}"
    for i, j in PAIRS
]
_MEDIANS = [f"CAST(q{i}_2 AS DOUBLE) * {_QBIN} AS m{i}" for i in range(P)]
#: Starts without correlation: quartile ranges as spreads, and the floors.
_FROM_QUARTILES = _MEDIANS + [
    (f"((q{i}_3 - q{i}_1) * {_QBIN} / 1.349) * ((q{i}_3 - q{i}_1) * {_QBIN} / 1.349) + {FLOORS[i] ** 2}" if i == j else "CAST(0 AS DOUBLE)") + f" AS c{i}_{j}" for i, j in PAIRS
]
_FROM_MEDIANS = _MEDIANS + [(f"CAST({FLOORS[i] ** 2} AS DOUBLE)" if i == j else "CAST(0 AS DOUBLE)") + f" AS c{i}_{j}" for i, j in PAIRS]
#: A group: language and source, nulls apart from empty strings.
_KEY = "concat(CASE WHEN lang IS NULL THEN 'n' ELSE 'v' || lang END, chr(9), CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END)"


def _estimates(groups: DataFrame, items: list[str]) -> DataFrame:
    out = groups.selectExpr("key", "start", *items)
    for name, expr in _decompose():
        out = out.withColumn(name, F.expr(expr))
    return out.select("key", "start", *_PARAMS, "det")


def _met(rows: DataFrame, estimates: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with d2, their squared distance by the estimates of their group."""
    table, _, size = measured(estimates, "quality-estimates")
    if size <= BROADCAST_BYTES:
        out = rows.join(F.broadcast(table), on, how)
    else:
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        out = rows.withColumn("salt", F.pmod(F.xxhash64(*[f"x{i}" for i in range(P)]), F.lit(_SALTS)).cast("int")).join(salted, [*on, "salt"], how).drop("salt")
    for name, expr in _SOLVED:
        out = out.withColumn(name, F.expr(expr))
    return out.drop(*_PARAMS, "det", *[f"y{i}" for i in range(P)])


def statistics(docs: DataFrame) -> DataFrame:
    """Written base counts with base_failed, the statistics x0.. and the group ``key``."""
    counts = base_counts(docs).withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("key", F.expr(_KEY))
    kinds = [F.when(~F.col("base_failed"), F.expr(x)).alias(f"x{i}") for i, x in enumerate(STATISTICS)]
    return written(counts.select("*", *kinds).drop("lang", "source"), "quality-counts")


def _sums(fit: DataFrame, by: list[str]) -> DataFrame:
    products = [F.sum(f"x{i}").alias(f"s{i}") for i in range(P)] + [F.sum(F.expr(f"x{i} * x{j}")).alias(f"s{i}_{j}") for i, j in PAIRS]
    return fit.groupBy(*by).agg(F.count("*").alias("n"), *products)


def _added(sums: DataFrame, by: list[str]) -> DataFrame:
    return sums.groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38, 0)")).alias(c) for c in _MOMENTS])


def estimates(fit: DataFrame, steps: int = STEPS) -> DataFrame:
    """(key, start, m.., r.., v.., det): the estimate of each group of ``fit`` (key, x0..) by the start with the smallest
    determinant, ties to the first start."""
    long = fit.select("key", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.expr(f"CAST(floor(x{i} / CAST({_QBIN} AS DOUBLE)) AS BIGINT)").alias("bin")) for i in range(P)])).alias("e"))
    bins = long.groupBy("key", "e.i", "e.bin").agg(F.count("*").alias("n"))
    bins = bins.selectExpr("key", "i", "bin", "sum(n) OVER (PARTITION BY key, i ORDER BY bin) AS upto", "sum(n) OVER (PARTITION BY key, i) AS total")
    quartiles = bins.groupBy("key").agg(*[F.min(F.expr(f"CASE WHEN i = {i} AND 4 * upto >= {q} * total THEN bin END")).alias(f"q{i}_{q}") for i in range(P) for q in (1, 2, 3)])
    quartiles = written(quartiles, "quality-quartiles")
    every = _added(_sums(fit.withColumn("part", F.expr("x4 % 64")), ["key", "part"]), ["key"])
    starts = ((quartiles, _FROM_QUARTILES), (every, _FROM_SUMS), (quartiles, _FROM_MEDIANS))
    now = None
    for k, (groups, items) in enumerate(starts):
        own = _estimates(groups.withColumn("start", F.lit(k)), items)
        now = own if now is None else now.unionByName(own)
    fit = fit.withColumn("start", F.explode(F.array(*[F.lit(k) for k in range(len(starts))])))
    before = None
    for _ in range(steps):
        by_bin = _sums(_met(fit, now, ["key", "start"]).withColumn("dbin", F.expr(_DBIN)), ["key", "start", "dbin"])
        by_bin = by_bin.selectExpr("*", "sum(n) OVER (PARTITION BY key, start ORDER BY dbin) AS upto", "sum(n) OVER (PARTITION BY key, start) AS total")
        near = written(_added(by_bin.where(f"upto - n < {SHARE} * total"), ["key", "start"]), "quality-near")
        now = _estimates(near, _FROM_SUMS)
        if before is not None:
            same = near.join(before, ["key", "start", "n", *_MOMENTS], "left_anti").limit(1).count() == 0
            forget(before)
            if same:
                break
        before = near
    best = now.groupBy("key").agg(F.min_by(F.struct(*now.columns[1:]), F.struct("det", "start")).alias("e"))
    return best.select("key", "e.*")


def quality_rules(docs: DataFrame, cut: float = CUT, steps: int = STEPS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2, one row a document.

    ``kept`` is false if base_failed, else true unless the squared Mahalanobis distance exceeds ``cut`` (of a chi-square
    with 5 degrees of freedom, 45 is passed by one normal row in some 70 million). Rows that failed the base rules shape no
    estimate. A null lang or source is apart from an empty one; a group of a single row keeps it (its distance is 0);
    ties and repeated rows count as often as they occur; an empty table gives no rows.
    """
    rows = statistics(docs)
    fit = rows.where("NOT base_failed").select("key", *[f"x{i}" for i in range(P)])
    found = _met(rows, estimates(fit, steps).drop("start"), ["key"], "left")
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= cut)).alias("kept"), F.round(F.least("d2", F.lit(1e6)), 3).alias("distance2"),
    )


def op2_robust_outliers(spark, sf_dir: str) -> DataFrame:
    """The quality counts and verdict of every document."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("distance2")


def _oracle() -> str:
    """The same in DuckDB, with all ``STEPS`` steps one after the other (steps after the last change change nothing)."""
    ws = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
    let = lambda items: ", ".join(f"{e} AS {c}" for c, e in items)  # noqa: E731  later items may use earlier ones
    est = lambda source, start, items: f"SELECT *, {let(_decompose())} FROM (SELECT key, {start} AS start, {', '.join(items)} FROM {source})"
    met = lambda rows, e, on, how: f"SELECT r.*, {let(_SOLVED)} FROM {rows} r {how} JOIN {e} e USING ({on})"
    sums = ", ".join([f"sum(x{i})::HUGEINT AS s{i}" for i in range(P)] + [f"sum(x{i} * x{j})::HUGEINT AS s{i}_{j}" for i, j in PAIRS])
    steps = [f"e0 AS ({est('qs', 0, _FROM_QUARTILES)} UNION ALL {est('every', 1, _FROM_SUMS)} UNION ALL {est('qs', 2, _FROM_MEDIANS)})"]
    for t in range(STEPS):
        steps.append(f"near{t} AS ({met('starts', f'e{t}', 'key, start', 'INNER')})")
        steps.append(f"bin{t} AS (SELECT key, start, {_DBIN} AS dbin, count(*) AS n, {sums} FROM near{t} GROUP BY ALL)")
        steps.append(f"cum{t} AS (SELECT *, sum(n) OVER (PARTITION BY key, start ORDER BY dbin) AS upto, sum(n) OVER (PARTITION BY key, start) AS total FROM bin{t})")
        steps.append(f"nst{t} AS (SELECT key, start, sum(n)::BIGINT AS n, {', '.join(f'sum({c})::HUGEINT AS {c}' for c in _MOMENTS)} FROM cum{t} WHERE upto - n < {SHARE} * total GROUP BY key, start)")
        steps.append(f"e{t + 1} AS ({est(f'nst{t}', 'start', _FROM_SUMS)})")
    quart = ", ".join(f"min(CASE WHEN i = {i} AND 4 * upto >= {q} * total THEN bin END) AS q{i}_{q}" for i in range(P) for q in (1, 2, 3))
    long = " UNION ALL ".join(f"SELECT key, {i} AS i, CAST(floor(x{i} / CAST({_QBIN} AS DOUBLE)) AS BIGINT) AS bin FROM fit" for i in range(P))
    return f"""
WITH txt AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda l: length(translate(l, {ws}, '')) > 0) AS lines FROM txt),
grams AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM words, unnest(range(1, len(w) - 1)) AS u(i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM grams) WHERE k > 1),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM twice, unnest([0, 1, 2]) AS v(o) GROUP BY rid),
counts AS (SELECT words.rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(translate(text, {ws}, ''))::BIGINT AS word_chars,
  (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM words LEFT JOIN rep USING (rid)),
failed AS (SELECT *, {BASE_FAILED} AS base_failed, {_KEY} AS key FROM counts),
rws AS (SELECT *, {', '.join(f'CASE WHEN NOT base_failed THEN {x} END AS x{i}' for i, x in enumerate(STATISTICS))} FROM failed),
fit AS (SELECT key, {', '.join(f'x{i}' for i in range(P))} FROM rws WHERE NOT base_failed),
starts AS (SELECT fit.*, start FROM fit, unnest(range(0, {STARTS})) AS u(start)),
bins AS (SELECT key, i, bin, sum(n) OVER (PARTITION BY key, i ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY key, i) AS total FROM (SELECT key, i, bin, count(*) AS n FROM ({long}) GROUP BY ALL)),
qs AS (SELECT key, {quart} FROM bins GROUP BY key),
every AS (SELECT key, count(*) AS n, {sums} FROM fit GROUP BY key),
{("," + chr(10)).join(steps)},
best AS (SELECT * EXCLUDE (start) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY det, start) AS k FROM e{STEPS}) WHERE k = 1),
fin AS ({met("rws", "best", "key", "LEFT")})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND coalesce(d2, 0.0) <= {CUT}) AS kept FROM fin
"""


OP2_SQL = _oracle()
