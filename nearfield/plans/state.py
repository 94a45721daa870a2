"""The store's state: two tables, from which everything else derives."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.vectors import vec_mean

MANAGER = ["namespace", "node_id"]
CENTROID = [*MANAGER, "centroid_id"]
POINTS = "namespace string, node_id string, centroid_id bigint, seq bigint, id bigint, vec array<double>, payload binary, expires timestamp, expire_enabled boolean"
CENTROIDS = "namespace string, node_id string, centroid_id bigint, ord bigint, vec array<double>"
QUERIES = "query_id bigint, namespace string, vec array<double>, k int, accurate boolean, drain boolean"
POINT_COLUMNS = [c.split()[0] for c in POINTS.split(", ")]
CENTROID_COLUMNS = [c.split()[0] for c in CENTROIDS.split(", ")]


@dataclass(frozen=True)
class State:
    """``points`` belong to centroids, centroids to the manager of a (namespace, node_id).

    A centroid's vector is stored, because one that was emptied keeps its last vector and still attracts points. ``seq``
    is insertion order, ``ord`` the order of a manager's centroids.
    """

    points: DataFrame
    centroids: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> State:
        return cls(spark.createDataFrame([], POINTS), spark.createDataFrame([], CENTROIDS))

    def having(self, points: DataFrame | None = None, centroids: DataFrame | None = None) -> State:
        return replace(self, **{k: v.select(*names) for k, v, names in (("points", points, POINT_COLUMNS), ("centroids", centroids, CENTROID_COLUMNS)) if v is not None})

    def nodes(self) -> DataFrame:
        """(namespace, node_id, vec): a manager's vector is the unweighted mean of its centroids' vectors, empty ones included."""
        return vec_mean(self.centroids, MANAGER)

    def sizes(self) -> DataFrame:
        """(namespace, node_id, centroid_id, n_points): expired points count until they are swept."""
        counts = self.points.groupBy(*CENTROID).agg(F.count("*").alias("n"))
        return self.centroids.select(*CENTROID, "ord").join(counts, CENTROID, "left").select(*CENTROID, "ord", F.coalesce("n", F.lit(0)).alias("n_points"))


def meta_counts(state: State) -> DataFrame:
    """(node_id, namespace, n_centroids, n_points) of each manager."""
    return state.sizes().groupBy("node_id", "namespace").agg(F.count("*").alias("n_centroids"), F.sum("n_points").alias("n_points"))


def namespaces(state: State) -> DataFrame:
    return state.centroids.select("namespace").distinct()


def namespace_nodes(state: State) -> DataFrame:
    """(namespace, node_ids): the nodes that hold each namespace, in order."""
    return state.centroids.groupBy("namespace").agg(F.array_sort(F.collect_set("node_id")).alias("node_ids"))


def len_dp(state: State) -> DataFrame:
    """(namespace, node_id, n_points)."""
    return meta_counts(state).select("namespace", "node_id", "n_points")
