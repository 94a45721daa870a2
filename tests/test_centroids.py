from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from states import FUTURE, NOW, PAST, centroid_vectors, queries, sizes, state, vectors

from nearfield.operators import centroids as C

N = "n0"


def new_points(spark, *vecs, namespace="test", node=N, expires=None):
    schema = "namespace string, node_id string, seq bigint, id bigint, vec array<double>, payload binary, expires timestamp, expire_enabled boolean"
    return spark.createDataFrame([(namespace, node, 1000 + i, 1000 + i, [float(x) for x in v], None, expires, expires is not None) for i, v in enumerate(vecs)], schema)


def test_add_moves_the_mean(spark):
    _, s = C.add_points(state(spark, {0: ((1, 1), [])}), new_points(spark, (3, 3)), NOW)
    assert centroid_vectors(s) == {(N, 0): (3, 3)}
    _, s = C.add_points(s, new_points(spark, (5, 5)), NOW)
    assert centroid_vectors(s) == {(N, 0): (4, 4)}


def test_first_points_found_a_manager(spark):
    report, s = C.add_points(state(spark, {0: ((1, 1), [])}), new_points(spark, (1, 1), (2, 2), node="n9"), NOW)
    assert sizes(s) == {(N, 0): 0, ("n9", 0): 2}
    assert report.where("reason IS NOT NULL").count() == 0


def test_rejections(spark):
    s = state(spark, {0: ((1, 1), [])})
    report, after = C.add_points(s, new_points(spark, (1, 2), expires=PAST), NOW)
    assert [r.reason for r in report.collect()] == ["expired"]
    report, after = C.add_points(s, new_points(spark, (1, 2, 3)), NOW)
    assert [r.reason for r in report.collect()] == ["incomparable"]
    assert sizes(after) == {(N, 0): 0}


def test_routing_to_the_nearest_centroid(spark):
    _, s = C.add_points(state(spark, {0: ((1, 2), []), 1: ((1, 3), [])}), new_points(spark, (1, 2), (1, 3)), NOW)
    assert vectors(s.points) == {(N, 0): [(1, 2)], (N, 1): [(1, 3)]}


def test_auto_split(spark):
    _, s = C.add_points(state(spark, {0: ((1, 1), [])}), new_points(spark, (1, 1), (2, 2)), NOW, threshold=2)
    assert sorted(sizes(s).values()) == [1, 1]


def test_auto_split_goes_on_until_all_are_below(spark):
    vecs = [(1, 1 + i / 100) for i in range(23)]
    _, s = C.add_points(state(spark, {0: ((1, 1), [])}), new_points(spark, *vecs), NOW, threshold=6)
    # the oldest three go again and again while six or more are left
    assert sizes(s) == {(N, 0): 5, **{(N, k): 3 for k in range(1, 7)}}
    by = {k[1]: v for k, v in vectors(s.points).items()}
    assert by[1] == vecs[:3] and by[6] == vecs[15:18] and by[0] == vecs[18:]


def test_ages_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(C, "_AGE_ROWS", 3)
    s = state(spark, {0: ((1, 1), [(1, i) for i in range(20)]), 1: ((1, 1), [(1, i) for i in range(5)])})
    got = sorted((r.centroid_id, r.age, r.seq) for r in C._aged(s.points).collect())
    assert got == [(0, i + 1, i) for i in range(20)] + [(1, i + 1, 20 + i) for i in range(5)]


def test_distribution_to_given_receivers(spark):
    a = C.move_vector(state(spark, {0: ((1, 3), [(1, 3)] * 3 + [(1, 9)])}))
    b = state(spark, {"name": "n5", 0: ((1, 9), []), 1: ((9, 1), [])}, {"name": "n6", 0: ((1, 9, 1), [])})
    left, got = C.distribute_to(a, b, 1, NOW)
    assert vectors(left.points) == {(N, 0): [(1, 3)] * 3} and vectors(got.points) == {("n5", 0): [(1, 9)]}
    left, got = C.distribute_to(a, state(spark, {"name": "n6", 0: ((1, 9, 1), [])}), 1, NOW)
    assert len(vectors(left.points)[N, 0]) == 4 and got.points.count() == 0


def test_one_id_in_two_managers(spark):
    s = state(spark, {0: ((1, 1), [])}, {0: ((1, 2), [])})
    rows = new_points(spark, (1, 1)).unionByName(new_points(spark, (1, 1), node="n1")).unionByName(new_points(spark, (1, 2)).withColumn("seq", F.lit(1)))
    report, after = C.add_points(s, rows, NOW)
    assert report.where("reason IS NULL").count() == 3 and sizes(after) == {("n0", 0): 2, ("n1", 0): 1}


def test_expiry(spark):
    s = state(spark, {0: ((3, 3), [((2, 2), PAST), ((3, 3), FUTURE), ((4, 4), PAST)]), 1: ((1, 9), [((1, 9), PAST)])})
    after = C.expire(s, NOW)
    assert vectors(after.points) == {(N, 0): [(3, 3)]}
    assert centroid_vectors(after)[N, 1] == (1, 9)  # emptied: keeps its vector
    assert sizes(C.mem_trim(s, NOW)) == {(N, 0): 1}
    assert sizes(C.mem_trim(state(spark, {0: ((1, 1), [])}), NOW)) == {}


def test_mean_of_means(spark):
    s = C.move_vector(state(spark, {0: ((0, 0), [(1, 1), (3, 3)]), 1: ((0, 0), [(3, 3), (5, 5)])}))
    assert centroid_vectors(s) == {(N, 0): (2, 2), (N, 1): (4, 4)}
    assert [tuple(r.vec) for r in s.nodes().collect()] == [(3, 3)]


def test_portions(spark):
    s = state(spark, {0: ((1, 1), [(1, 1), (1, 1)]), 1: ((1, 1), [(1, 1)]), 2: ((1, 1), [])})
    assert {r.centroid_id: r.n_taken for r in C.portions(s, 4, NOW).collect()} == {0: 2, 1: 1}
    assert C.portions(s, 0, NOW).count() == 0


def test_drains(spark):
    taken, rest = C.drain(state(spark, {0: ((3, 3), [((2, 2), PAST), (3, 3), (4, 4)])}), 1, NOW)
    assert vectors(taken) == {(N, 0): [(3, 3)]}
    assert vectors(rest.points) == {(N, 0): [(4, 4)]}
    taken, rest = C.drain(state(spark, {0: ((1, 1), [((1, 4), PAST), (1, 2), (1, 3)])}), 1, NOW, ordered=True)
    assert vectors(taken) == {(N, 0): [(1, 3)]}
    taken, rest = C.drain(C.move_vector(state(spark, {0: ((1, 1), [(1, 3)] * 3 + [(1, 9)]), 1: ((5, 5), [(5, 5)])})), 2, NOW, ordered=True)
    assert vectors(taken) == {(N, 0): [(1, 9)], (N, 1): [(5, 5)]}
    assert sizes(rest) == {(N, 0): 3, (N, 1): 0}
    for n in (0, -1):
        assert C.drain(rest, n, NOW)[0].count() == 0


def test_distribute_internal(spark):
    s = C.move_vector(state(spark, {0: ((1, 3), [(1, 3)] * 3 + [(1, 9)]), 1: ((1, 9), [(1, 9)] * 3 + [(1, 3)])}))
    assert vectors(C.distribute_internal(s, 2, NOW).points) == {(N, 0): [(1, 3)] * 4, (N, 1): [(1, 9)] * 4}


def test_lookup(spark):
    s = C.move_vector(state(spark, {0: ((0, 0), [(1, 2), (1, 3)]), 1: ((0, 0), [(1, 6), (1, 7)])}))
    found, rest = C.lookup_and_drain(s, queries(spark, (1, 5.7)), NOW)
    assert [r.id for r in found.collect()] == [2]
    assert sizes(rest) == {(N, 0): 2, (N, 1): 1}
    assert C.manager_lookup(s, queries(spark, (1, 5.7), k=0), NOW).count() == 0
    assert C.manager_lookup(s, queries(spark, (1, 5.7), k=9), NOW).count() == 4


def test_fill_first_is_not_a_global_ranking(spark):
    s = state(spark, {0: ((1, 1), [(1, 1), (1, 9)]), 1: ((1, 2), [(1, 1.2)])})
    assert [r.id for r in C.manager_lookup(s, queries(spark, (1, 1), k=2), NOW).orderBy("rank").collect()] == [0, 1]


def test_nearest_centroids(spark):
    s = state(spark, {0: ((1, 2), []), 1: ((1, 3), []), 2: ((1, 4), [])})
    found, rest = C.take_centroids(s, queries(spark, (1, 5)), 1)
    assert [r.centroid_id for r in found.collect()] == [2]
    assert rest.centroids.count() == 2


def test_split(spark):
    s = state(spark, {0: ((1, 1), [(1, 1), (1, 2), (1, 3), (1, 4)])})
    after = C.split_by_size(s, 0, 5)
    assert vectors(after.points) == {(N, 0): [(1, 3), (1, 4)], (N, 1): [(1, 1), (1, 2)]}
    for bounds in ((4, 9), (0, 4)):  # exclusive at both ends
        assert sizes(C.split_by_size(s, *bounds)) == {(N, 0): 4}
    assert centroid_vectors(after)[N, 1] == (1, 1.5)


@pytest.mark.parametrize("bounds", [(1, 3), (-1, 3)])
def test_merge(spark, bounds):
    s = C.move_vector(state(spark, {0: ((0, 0), [(1, 3)]), 1: ((0, 0), [(2, 5)]), 2: ((0, 0), [(9, 8), (1, 7)])}))
    after = C.merge_centroids(s, *bounds)
    if bounds == (1, 3):
        assert sizes(after) == {(N, 0): 1, (N, 2): 3}
    assert sum(sizes(after).values()) == 4


def test_whole_state_survives_extra_columns(spark):
    s = state(spark, {0: ((1, 1), [(1, 1)])})
    wide = s.having(s.points.withColumn("score", F.lit(1)), s.centroids.withColumn("n_points", F.lit(7)))
    assert sizes(wide) == {(N, 0): 1}
