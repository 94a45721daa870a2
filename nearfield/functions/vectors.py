"""Vector arithmetic over arrays of doubles.

Two vectors of different length never combine: the result is null. ``zip_with`` alone would pad the shorter one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Metric = Callable[[Column, Column], Column]


def _col(v: Column | str) -> Column:
    return F.col(v) if isinstance(v, str) else v


def vec(*values: float) -> Column:
    """A literal vector."""
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def _zipped(a: Column | str, b: Column | str, f: Callable[[Column, Column], Column]) -> Column:
    a, b = _col(a), _col(b)
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, f))


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _total(_zipped(a, b, lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column | str, b: Column | str, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity: 0 for two zero vectors, null for a single one and for unequal lengths, so that such pairs are
    never selected. Norms that are known already can be passed."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    score = F.when((na == 0) & (nb == 0), F.lit(0.0)).when((na != 0) & (nb != 0), dot(a, b) / na / nb)
    return F.when(F.size(_col(a)) == F.size(_col(b)), score)


def l1_distance(a: Column | str, b: Column | str) -> Column:
    """Sum of absolute differences (what the store's "Euclidean" metric computes)."""
    return _total(_zipped(a, b, lambda x, y: F.abs(x - y)))


def l2_distance(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance, an addition of ours."""
    return F.sqrt(_total(_zipped(a, b, lambda x, y: (x - y) * (x - y))))


def add(a: Column | str, b: Column | str) -> Column:
    return _zipped(a, b, lambda x, y: x + y)


def subtract(a: Column | str, b: Column | str) -> Column:
    return _zipped(a, b, lambda x, y: x - y)


def scale(v: Column | str, factor: float | Column) -> Column:
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.transform(_col(v), lambda x: x * factor)


def divide(v: Column | str, by: float | Column) -> Column:
    """Elementwise quotient; null elements for a zero divisor."""
    by = by if isinstance(by, Column) else F.lit(float(by))
    return F.transform(_col(v), lambda x: F.try_divide(x, by))


def equal(a: Column | str, b: Column | str) -> Column:
    """Same length and elements; unlike Spark's own comparison, NaN equals nothing."""
    a, b = _col(a), _col(b)
    return (a == b) & ~F.exists(a, F.isnan)


def contains(vectors: Column | str, v: Column | str) -> Column:
    """Whether an array of vectors has an element equal to ``v``."""
    v = _col(v)
    return F.exists(_col(vectors), lambda x: (x == v) & ~F.exists(x, F.isnan))


def vec_mean(rows: DataFrame, by: list[str], value: str = "vec", out: str = "vec") -> DataFrame:
    """Elementwise mean per group (``by`` columns and ``out``); groups of mixed length give null, empty ones no row.

    Sums are combined before the shuffle, so a group costs one row per element and task, whatever its size.
    """
    flat = rows.select(*by, F.size(value).alias("__size"), F.posexplode(value).alias("__pos", "__x"))
    means = flat.groupBy(*by, "__pos").agg(F.avg("__x").alias("__m"), F.min("__size").alias("__lo"), F.max("__size").alias("__hi"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__m"))), lambda e: e["__m"])
    return means.groupBy(*by).agg(ordered.alias("__all"), F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi")).select(*by, F.when(F.col("__lo") == F.col("__hi"), F.col("__all")).alias(out))
