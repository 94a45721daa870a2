from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from nearfield.functions.vectors import vec
from nearfield.operators import search as S


def pool(spark, *vecs):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "id long, vec array<double>")


def ids(df):
    return [r.id for r in sorted(df.collect(), key=lambda r: r["rank"])]


def test_fixtures(spark):
    p = pool(spark, (1, 2, 3), (1, 3, 5), (1, 4, 8))
    assert ids(S.knn_cos(p, vec(1, 1, 1), 2)) == [0, 1]
    assert ids(S.kfn_cos(p, vec(1, 1, 1), 2)) == [2, 1]
    p = pool(spark, (2, 2, 2), (3, 3, 3), (4, 4, 4))
    assert ids(S.knn_l1(p, vec(5, 5, 5), 2)) == [2, 1]
    assert ids(S.kfn_l1(p, vec(5, 5, 5), 2)) == [0, 1]


def test_edges(spark):
    p = pool(spark, (1, 1), (2, 2), (0, 0), (1, 1, 1), (float("nan"), 1))
    assert ids(S.knn_cos(p, vec(1, 1), 10)) == [0, 1]  # tied, smaller id first; the others have no score
    assert ids(S.knn_cos(p, vec(0, 0), 10)) == [2]
    assert ids(S.knn_cos(p, vec(1, 1), 0)) == []
    with pytest.raises(ValueError, match="negative"):
        S.knn_cos(p, vec(1, 1), -1)


@pytest.mark.parametrize("rows", [1024, 2])
@pytest.mark.parametrize("limit", [S.BROADCAST_BYTES, 0])
def test_nearest_in_blocks(spark, rows, limit, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", rows)
    points = pool(spark, (1, 2), (1, 9), (5, 1), (0, 0))
    receivers = pool(spark, (1, 0), (1, 1), (1, 3), (0, 1), (1, 8)).withColumnRenamed("id", "receiver_id")
    best = {(r.id, r["rank"]): r.receiver_id for r in S.nearest(points, receivers, 2, limit=limit).collect()}
    assert best == {(0, 1): 2, (0, 2): 1, (1, 1): 4, (1, 2): 3, (2, 1): 0, (2, 2): 1}
    one = {r.id: r.receiver_id for r in S.nearest(points, receivers, 1, limit=limit, keep=True).collect()}
    assert one == {0: 2, 1: 4, 2: 0, 3: None}
    assert S.nearest(points, receivers, 0, limit=limit).count() == 0


@pytest.mark.parametrize("n", [1000, 1025, 1200])
@pytest.mark.parametrize("limit", [S.BROADCAST_BYTES, 0])
def test_rows_with_one_id_stay_apart(spark, n, limit):
    """One id in two managers and twice in one: every row keeps a line of its own, whatever the number of receivers."""
    angle = F.lit(1.5) * F.col("id") / n
    receivers = spark.range(n).select(F.col("id").alias("receiver_id"), F.array(F.cos(angle), F.sin(angle)).alias("vec"), F.explode(F.array(F.lit("n0"), F.lit("n1"))).alias("node_id"))
    rows = [("n0", 7, 1, [1.0, 0.0]), ("n1", 7, 1, [0.0, 1.0]), ("n0", 7, 2, [1.0, 0.1]), ("n0", 7, 2, [1.0, 0.1]), ("n2", 7, 1, [1.0, 1.0]), ("n0", 8, 1, [1.0, 1.0, 1.0])]
    points = spark.createDataFrame(rows, "node_id string, id long, seq long, vec array<double>")
    got = sorted((r.node_id, r.id, r.seq, -1 if r.receiver_id is None else r.receiver_id) for r in S.nearest(points, receivers, 1, ["node_id"], keep=True, limit=limit).collect())
    third = round(math.atan(0.1) / 1.5 * n)
    assert got == [("n0", 7, 1, 0), ("n0", 7, 2, third), ("n0", 7, 2, third), ("n0", 8, 1, -1), ("n1", 7, 1, n - 1), ("n2", 7, 1, -1)]
    assert S.nearest(points, receivers, 1, ["node_id"], limit=limit).count() == 4


def test_batch_equals_single(spark):
    p = pool(spark, *[(i % 7 + 1, i % 5, i % 3) for i in range(60)])
    found = S.knn_batch(p.where("id < 3").withColumnRenamed("id", "query_id"), p, 4)
    for r in p.where("id < 3").collect():
        single = S.knn_cos(p, F.array(*map(F.lit, r.vec)), 4)
        assert ids(found.where(F.col("query_id") == r.id)) == ids(single)
