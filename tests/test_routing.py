from __future__ import annotations

from states import NOW, queries, sizes, state, vectors
from test_centroids import new_points

from nearfield.operators import centroids as C
from nearfield.operators import routing as R

PAIRS = ({0: ((1, 1), [(1, 1)]), 1: ((1, 2), [(1, 2)])}, {0: ((1, 3), [(1, 3)]), 1: ((1, 4), [(1, 4)])}, {0: ((1, 5), [(1, 5)]), 1: ((1, 6), [(1, 6)])})
SINGLES = ({0: ((1, 1), [(1, 1)])}, {0: ((1, 2), [(1, 2)])}, {0: ((1, 3), [(1, 3)])})


def order(df):
    return [r.node_id for r in df.orderBy("nrank").collect()]


def test_ranking(spark):
    assert order(R.best_fit_nodes(state(spark, *SINGLES), queries(spark, (1, 3)))) == ["n2", "n1", "n0"]
    assert order(R.best_fit_nodes(state(spark, *PAIRS), queries(spark, (1, 4)), "accurate"))[0] == "n1"
    assert sorted(order(R.best_fit_nodes(state(spark, *PAIRS), queries(spark, (1, 4)), "random"))) == ["n0", "n1", "n2"]


def test_get_and_drain(spark):
    found, rest = R.get_and_drain(state(spark, *SINGLES), queries(spark, (1, 2), drain=True), "fast", NOW)
    assert [(r.node_id, r.id) for r in found.collect()] == [("n1", 1)]
    assert sizes(rest)["n1", 0] == 0
    found, rest = R.get_and_drain(state(spark, *PAIRS), queries(spark, (1, 4), drain=True), "accurate", NOW)
    assert [(r.node_id, r.id) for r in found.collect()] == [("n1", 3)]
    assert sum(v for (n, _), v in sizes(rest).items() if n == "n1") == 1
    found, rest = R.get_and_drain(state(spark, *SINGLES), queries(spark, (1, 1)), "random", NOW)
    assert found.count() == 1 and rest.points.count() == 3


def test_get_visits_further_nodes_for_the_rest(spark):
    assert [r.id for r in R.get_points(state(spark, *SINGLES), queries(spark, (1, 3), k=2), "fast", NOW).orderBy("rank").collect()] == [2, 1]
    assert R.get_points(state(spark, *SINGLES), queries(spark, (1, 3), k=9), "fast", NOW).count() == 3


def test_an_empty_centroid_uses_up_a_probe(spark):
    s = state(spark, {0: ((1, 3), []), 1: ((1, 9), [(1, 9)])}, {0: ((1, 1), [(1, 1)])})
    assert [r.id for r in R.get_points(s, queries(spark, (1, 3), k=1), "accurate", NOW).collect()] == [1]


def test_put(spark):
    _, s = R.put_points(state(spark, *SINGLES), new_points(spark, (1, 2)), "fast", NOW)
    assert sizes(s)["n1", 0] == 2
    _, s = R.put_points(state(spark, *PAIRS), new_points(spark, (1, 4)), "accurate", NOW)
    assert vectors(s.points)["n1", 1] == [(1, 4), (1, 4)]
    report, s = R.put_points(state(spark, *SINGLES), new_points(spark, (1, 4, 7)), "fast", NOW)
    assert [r.reason for r in report.collect()] == ["incomparable"]


def test_distribute(spark):
    s = C.move_vector(state(spark, {0: ((1, 3), [(1, 3)] * 3 + [(1, 9)])}, {0: ((1, 9), [(1, 9)] * 3 + [(1, 3)])}))
    for route in ("fast", "accurate"):
        assert vectors(R.distribute(s, 1, route, NOW).points) == {("n0", 0): [(1, 3)] * 4, ("n1", 0): [(1, 9)] * 4}
    s = state(spark, {0: ((1, 1), [(1, 9)])}, {0: ((1, 9), [])})
    assert vectors(R.distribute(s, 1, "accurate", NOW).points) == {("n1", 0): [(1, 9)]}
    alone = state(spark, {0: ((1, 1), [(1, 9)])})
    assert vectors(R.distribute(alone, 1, "fast", NOW).points) == {("n0", 0): [(1, 9)]}


def test_steal(spark):
    s = state(spark, {0: ((1, 1), [(1, 1)] * 2), 1: ((1, 3), [(1, 1)] * 2)}, {0: ((1, 3), [])})
    after = R.steal_centroids(s, "test", "n0", "n1", 2)
    assert sizes(after) == {("n0", 0): 2, ("n1", 0): 0, ("n1", 1): 2}
    assert sorted(v for (n, _), v in sizes(R.steal_centroids(s, "test", "n0", "n1", 3)).items() if n == "n1") == [0, 2, 2]
    assert sizes(R.steal_centroids(s, "test", "n0", "n7", 1))["n7", 0] == 2


def test_load_balance_arithmetic(spark):
    s = state(spark, {0: ((1, 1), [(1, 1)] * 30)}, {0: ((1, 2), [])}, {0: ((1, 3), [(1, 3)])})
    plan = {(r.node_id, r.from_node): r.n_transfer for r in R.load_balance_plan(s).collect()}
    assert plan == {("n1", "n0"): (10 - 0) // 3 // 3, ("n2", "n0"): (10 - 1) // 3 // 3}
    even = state(spark, *SINGLES)
    assert R.load_balance_plan(even).count() == 0
