from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from nearfield.functions import vectors as V


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_norm_and_distances(spark):
    assert value(spark, V.norm(V.vec(3, 4))) == 5
    assert value(spark, V.l1_distance(V.vec(1, -1), V.vec(4, 1))) == 5
    assert value(spark, V.l2_distance(V.vec(0, 0), V.vec(3, 4))) == 5


@pytest.mark.parametrize(("a", "b", "want"), [((1, 0), (0, 1), 0.0), ((1, 2), (2, 4), 1.0), ((0, 0), (0, 0), 0.0), ((0, 0), (1, 1), None), ((1, 2), (1, 2, 3), None)])
def test_cosine_contract(spark, a, b, want):
    got = value(spark, V.cosine(V.vec(*a), V.vec(*b)))
    assert got is None if want is None else math.isclose(got, want, abs_tol=1e-12)


def test_arithmetic(spark):
    assert value(spark, V.add(V.vec(1, 2), V.vec(3, 4))) == [4, 6]
    assert value(spark, V.subtract(V.vec(1, 2), V.vec(3, 5))) == [-2, -3]
    assert value(spark, V.scale(V.vec(1, 2), 3)) == [3, 6]
    assert value(spark, V.divide(V.vec(1, 2), 2)) == [0.5, 1]
    assert value(spark, V.divide(V.vec(1, 2), 0)) == [None, None]
    assert value(spark, V.add(V.vec(1), V.vec(1, 2))) is None


def test_equality(spark):
    nan = F.array(F.lit(float("nan")))
    assert value(spark, V.equal(V.vec(1, 2), V.vec(1, 2)))
    assert not value(spark, V.equal(V.vec(1, 2), V.vec(1)))
    assert not value(spark, V.equal(nan, nan))
    assert value(spark, V.contains(F.array(V.vec(1), V.vec(2)), V.vec(2)))
    assert not value(spark, V.contains(F.array(V.vec(1)), V.vec(2)))


def test_mean_per_group(spark):
    rows = spark.createDataFrame([("a", [1.0, 1.0]), ("a", [3.0, 5.0]), ("b", [1.0]), ("b", [1.0, 2.0])], "g string, vec array<double>")
    assert {r.g: r.vec for r in V.vec_mean(rows, ["g"]).collect()} == {"a": [2, 3], "b": None}
    assert V.vec_mean(rows.limit(0), ["g"]).count() == 0
