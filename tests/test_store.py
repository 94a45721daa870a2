from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from states import NOW, centroid_vectors, queries, sizes
from test_centroids import new_points

from nearfield.operators import centroids as C
from nearfield.plans.maintenance import Config, Skips, maintenance_cycle
from nearfield.plans.state import meta_counts
from nearfield.sources.requests import put_requests, query_requests, responses
from nearfield.sources.store import NamespaceNotFound, Store, WriteConflict
from nearfield.streaming import put_stream


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def test_put_then_query(spark, store):
    assert store.version() == 0 and store.load().points.count() == 0
    store.put(new_points(spark, (1, 2, 3)).drop("node_id"), "accurate", NOW)
    found = store.query(queries(spark, (1, 2, 3), k=3), "accurate", NOW)
    body = json.loads(responses(found, store.load().points).first().value)
    assert [p["vec"] for p in body] == [[1, 2, 3]] and body[0]["rank"] == 1
    with pytest.raises(NamespaceNotFound):
        store.query(queries(spark, (1, 2, 3), namespace="other"), now=NOW)


def test_draining_query_commits(spark, store):
    store.put(new_points(spark, (1, 2), (1, 3)).drop("node_id"), now=NOW)
    before = store.version()
    store.query(queries(spark, (1, 3), drain=True), now=NOW)
    assert store.version() == before + 1
    assert sum(sizes(store.load()).values()) == 1
    assert sum(sizes(store.load(before)).values()) == 2
    store.vacuum(1)
    assert store.version() == before + 1


def test_unmarked_versions_are_not_seen(spark, store, tmp_path):
    store.put(new_points(spark, (1, 2)).drop("node_id"), now=NOW)
    (tmp_path / "store" / "v=2").mkdir()
    assert store.version() == 1
    store.put(new_points(spark, (1, 3)).drop("node_id"), now=NOW)
    assert store.version() == 2 and store.load().points.count() == 2


def _written_bytes(tmp_path) -> int:
    return sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))


def test_a_put_writes_its_batch_alone(spark, store, tmp_path):
    store.put(new_points(spark, *[(1, i / 7) for i in range(1, 4000)]).drop("node_id"), now=NOW)
    first = _written_bytes(tmp_path)
    store.put(new_points(spark, (1, 2)).drop("node_id").withColumn("seq", F.lit(9).cast("long")), now=NOW)
    assert _written_bytes(tmp_path) - first < first / 8 and store.load().points.count() == 4000
    # running counts and sums give the means of all points
    exact = C.move_vector(store.load())
    assert centroid_vectors(store.load())["n0", 0] == pytest.approx(centroid_vectors(exact)["n0", 0])
    store.query(queries(spark, (1, 3), k=40, drain=True), now=NOW)
    exact = C.move_vector(store.load())
    assert store.load().points.count() == 3960 and centroid_vectors(store.load())["n0", 0] == pytest.approx(centroid_vectors(exact)["n0", 0])


def test_drained_points_can_come_back_and_deltas_are_compacted(spark, store):
    store.compact_after = 3
    rows = new_points(spark, (1, 2), (1, 3)).drop("node_id")
    for n in range(4):
        store.put(rows, now=NOW)
        assert store.load().points.count() == 2
        store.query(queries(spark, (1, 2), k=2, drain=True), now=NOW)
        assert store.load().points.count() == 0 and centroid_vectors(store.load())["n0", 0] == (1, 2.5)
    assert len(store._chain(store.version())) <= 4
    store.put(rows, now=NOW)
    version = store.version()
    store.vacuum(1)
    assert store.version() == version and store.load().points.count() == 2


def test_a_put_splits_down_to_the_threshold(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/split", Config(split_threshold=6))
    store.put(new_points(spark, *[(1, 1 + i / 100) for i in range(23)]).drop("node_id"), now=NOW)
    state = store.load()
    assert sizes(state) == {("n0", 0): 5, **{("n0", k): 3 for k in range(1, 7)}}
    exact = centroid_vectors(C.move_vector(state))
    assert all(v == pytest.approx(exact[k]) for k, v in centroid_vectors(state).items())


def test_one_of_two_writers_commits(spark, store, monkeypatch):
    store.put(new_points(spark, (1, 2)).drop("node_id"), now=NOW)
    late = Store(spark, store.path)
    monkeypatch.setattr(late, "version", lambda own=store.version(): own)
    store.put(new_points(spark, (1, 3)).drop("node_id"), now=NOW)
    with pytest.raises(WriteConflict):
        late.put(new_points(spark, (1, 4)).drop("node_id"), now=NOW)
    assert sorted(tuple(r.vec) for r in store.load().points.collect()) == [(1, 2), (1, 3)]


def test_a_repeated_batch_adds_nothing(spark, store):
    rows = new_points(spark, (1, 2)).drop("node_id")
    assert store.put(rows, now=NOW, stream="s", number=0).count() == 1
    assert store.put(rows, now=NOW, stream="s", number=0) is None and store.put(rows, now=NOW, stream="t", number=0).count() == 1
    assert store.load().points.count() == 2


def test_requests(spark):
    put = spark.createDataFrame([('{"namespace":"a","accurate":true,"dp":{"vec":[1,2],"payload":"aGk=","expires":"2024-05-01T00:00:00Z","expireEnabled":true}}',)], "value string")
    r = put_requests(put).first()
    assert (r.namespace, r.accurate, r.vec, bytes(r.payload), r.expire_enabled, r.expires.year) == ("a", True, [1, 2], b"hi", True, 2024)
    q = query_requests(spark.createDataFrame([(1, '{"namespace":"a","queryVec":[1],"n":2}')], "query_id long, value string")).first()
    assert (q.k, q.accurate, q.drain) == (2, False, False)
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        put_requests(spark.createDataFrame([("{nope",)], "value string")).collect()


def test_maintenance_keeps_points(spark, store):
    store.put(new_points(spark, *[(1, i) for i in range(1, 9)]).drop("node_id"), now=NOW)
    config = Config(n_internal=2, n_fast=2, n_accurate=2, split_range=(3, 100), merge_range=(-1, 2))
    after = maintenance_cycle(store.load(), config, 0, NOW, settle=store.commit)
    assert sum(r.n_points for r in meta_counts(after).collect()) == 8
    assert sizes(maintenance_cycle(after, Config(skips=Skips(*[7] * 9)), 3, NOW)) == sizes(after)


def test_settings():
    assert Skips(meta=0, expire=5000).meta == 1 and Skips(expire=5000).expire == 1000
    with pytest.raises(ValueError, match="range"):
        Config(split_range=(5, 5))


def test_stream_equals_batch(spark, store, tmp_path):
    rows = new_points(spark, (1, 2), (1, 3), (2, 5)).drop("node_id")
    rows.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        put_stream(source, store, f"{tmp_path}/checkpoint", now=NOW).awaitTermination()
    assert sorted(r.id for r in store.load().points.collect()) == [1000, 1001, 1002]
    assert store.load().points.where(F.col("node_id") == "n0").count() == 3
