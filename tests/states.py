"""Small states for tests: centroids with their points, per node."""

from __future__ import annotations

from datetime import datetime

from nearfield.plans.state import CENTROIDS, POINTS, State

NOW = "2024-06-01 00:00:00"
PAST, FUTURE = datetime(2024, 1, 1), datetime(2025, 1, 1)


def state(spark, *nodes: dict, namespace: str = "test") -> State:
    """Each node is {"name": node_id, centroid_id: (vector, [point, ...])}; a point is a vector or (vector, expiry)."""
    points, centroids, number = [], [], 0
    for k, node in enumerate(nodes):
        name = node.get("name", f"n{k}")
        for cid, (vec, own) in ((c, v) for c, v in node.items() if c != "name"):
            centroids.append((namespace, name, cid, cid, [float(x) for x in vec]))
            for p in own:
                vec_, expires = p if isinstance(p[0], tuple) else (p, None)
                points.append((namespace, name, cid, number, number, [float(x) for x in vec_], None, expires, expires is not None))
                number += 1
    return State(spark.createDataFrame(points, POINTS), spark.createDataFrame(centroids, CENTROIDS))


def vectors(points) -> dict:
    """Sorted point vectors per (node_id, centroid_id)."""
    out: dict = {}
    for r in points.collect():
        out.setdefault((r.node_id, r.centroid_id), []).append(tuple(r.vec))
    return {k: sorted(v) for k, v in out.items()}


def centroid_vectors(s: State) -> dict:
    return {(r.node_id, r.centroid_id): tuple(r.vec) for r in s.centroids.collect()}


def sizes(s: State) -> dict:
    return {(r.node_id, r.centroid_id): r.n_points for r in s.sizes().collect()}


def queries(spark, *vecs, k: int = 1, namespace: str = "test", drain: bool = False):
    return spark.createDataFrame([(i, namespace, [float(x) for x in v], k, False, drain) for i, v in enumerate(vecs)], "query_id bigint, namespace string, vec array<double>, k int, accurate boolean, drain boolean")
