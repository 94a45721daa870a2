from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions.vectors import cosine
from nearfield.operators import blocks as B
from nearfield.operators import centroids as C
from nearfield.operators import routing as R
from nearfield.operators import search as S
from states import NOW, PAST, queries, state

ODD = [(0.0, 0.0), (1e-200, 1e-200), (1e200, 1e200), (float("nan"), 1.0), (float("inf"), 1.0), (1.0, 1.0, 1.0), (), (5e-324, 1.0), (-1.0, 0.5)]


def rows(spark, n: int):
    """Repeated, parallel and odd vectors, some null or with a null."""
    vecs = [(float(i % 7 - 3), float(i % 5 - 2)) for i in range(n)] + ODD
    return spark.createDataFrame([(i, list(v)) for i, v in enumerate(vecs)] + [(n + 50, None), (n + 51, [None, 1.0])], "id long, vec array<double>")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [(B.POOL_ROWS, B.QUERY_ROWS, B._CELLS, B._PAIRS), (16, 4, 32, 8)])
@pytest.mark.parametrize("largest", [True, False])
def test_blocks_equal_all_pairs(spark, size, largest, monkeypatch):
    for name, value in zip(("POOL_ROWS", "QUERY_ROWS", "_CELLS", "_PAIRS"), size, strict=True):
        monkeypatch.setattr(B, name, value)
    p = rows(spark, 80)
    q = p.where("id % 9 = 0 OR id >= 80").select(F.col("id").alias("query_id"), "vec", (F.col("id") % 6).cast("int").alias("k"))
    found = S.knn_batch(q, p, F.col("k"), largest=largest)
    assert "CoGroup" in plan(found)  # whole blocks meet: before, one row stood for each pair
    pairs = q.withColumnRenamed("vec", "qvec").crossJoin(p).select("query_id", "id", "k", cosine("vec", "qvec").alias("score")).where(S.usable("score")).collect()
    want = []
    for r in q.collect():
        own = sorted((-x.score if largest else x.score, x.id) for x in pairs if x.query_id == r.query_id)[: r.k]
        want += [(r.query_id, i, n + 1, -s if largest else s) for n, (s, i) in enumerate(own)]
    assert sorted(tuple(r) for r in found.select("query_id", "id", "rank", "score").collect()) == sorted(want)


def test_equal_vectors_are_scored_once_per_k():
    x = np.repeat(np.eye(2), 500, axis=0)
    assert B._first_copies(x, 3).tolist() == [0, 1, 2, 500, 501, 502]
    i, j, score = B.best(x[:1], B.norms(x[:1]), np.array([4]), x, B.norms(x))
    assert (i.tolist(), j.tolist(), score.tolist()) == ([0] * 4, [0, 1, 2, 3], [1.0] * 4)


def test_probes_that_nothing_is_left_for_are_dropped(spark):
    """Points that have no score with the query don't fill a probe, expired ones neither."""
    s = state(spark, {0: ((1, 0), [(1, 0), (1, 0.1), (0, 0), (1, 1, 1), ((1, 0), PAST)]), 1: ((1, 1), [(1, 1), (1, 0.9)]), 2: ((0, 1), [(0, 1)]), 3: ((-1, 1), [(-1, 1)])})
    q = queries(spark, (1, 0), k=3)
    alive = C.live(s.points, NOW)
    probes = C.ranked_centroids(s, q, 3).withColumn("ask", F.lit(3))
    left = C.still_missing(alive, probes, q, ["query_id", "namespace", "node_id"], ["crank"])
    assert sorted((r.centroid_id, r.ask) for r in left.collect()) == [(0, 3), (1, 1)]
    assert sorted((r.centroid_id, r["rank"], r.id) for r in C.manager_lookup(s, q, NOW).collect()) == [(0, 1, 0), (0, 2, 1), (1, 3, 6)]


def test_lookups_meet_in_blocks(spark):
    half = [(math.cos(a / 40), math.sin(a / 40)) for a in range(60)]
    s = state(spark, {0: ((1, 0), half[:30]), 1: ((0, 1), half[30:])})
    q = queries(spark, (1, 0), (0, 1), k=4)
    for found in (C.centroid_lookup(s, q, NOW), C.manager_lookup(s, q, NOW), R.get_points(s, q, "fast", NOW)):
        assert "CoGroup" in plan(found)
    assert sorted((r.query_id, r["rank"], r.id) for r in R.get_points(s, q, "fast", NOW).collect()) == [(0, n + 1, n) for n in range(4)] + [(1, 1, 59), (1, 2, 58), (1, 3, 57), (1, 4, 56)]


def test_few_receivers_meet_points_as_matrices(spark):
    """Keys without receivers, odd vectors and ties, with and without ``keep``, as the blocks of expressions give them."""
    points = rows(spark, 40).withColumn("node_id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("n"), (F.col("id") % 3).cast("string"))))
    receivers = rows(spark, 12).where("id % 2 = 0 OR id > 12").select(F.struct("id").alias("receiver_id"), "vec", F.explode(F.array(F.lit("n0"), F.lit("n1"))).alias("node_id"))
    for on, k, keep in (([], 3, False), (["node_id"], 1, True), (["node_id"], 2, False)):
        own = receivers if on else receivers.where("node_id = 'n0'").drop("node_id")
        few, many = (S.nearest(points, own, k, on, keep=keep, limit=limit) for limit in (S.BROADCAST_BYTES, 0))
        assert "ArrowEvalPython" in plan(few)  # before, expressions scored each pair
        assert sorted(map(repr, few.select("id", "node_id", "receiver_id", "rank", "score").collect())) == sorted(map(repr, many.select("id", "node_id", "receiver_id", "rank", "score").collect()))
