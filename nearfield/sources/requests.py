"""JSON requests and responses of put and query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POINT = "vec array<double>, payload binary, expires timestamp, expireEnabled boolean"
PUT = f"namespace string, accurate boolean, dp struct<{', '.join(p.replace(' ', ': ', 1) for p in POINT.split(', '))}>"
QUERY = "namespace string, accurate boolean, queryVec array<double>, n int, drain boolean"
_STRICT = {"mode": "FAILFAST"}


def put_requests(lines: DataFrame, value: str = "value") -> DataFrame:
    """(namespace, accurate, vec, payload, expires, expire_enabled) of put requests in JSON; a malformed one is an error.
    Payloads are base64."""
    r = lines.select(F.from_json(value, PUT, _STRICT).alias("r"))
    return r.select("r.namespace", F.coalesce("r.accurate", F.lit(False)).alias("accurate"), "r.dp.vec", "r.dp.payload", "r.dp.expires", F.coalesce("r.dp.expireEnabled", F.lit(False)).alias("expire_enabled"))


def query_requests(lines: DataFrame, value: str = "value", id: str = "query_id") -> DataFrame:
    """Columns of QUERIES of query requests in JSON; a malformed one is an error."""
    r = lines.select(id, F.from_json(value, QUERY, _STRICT).alias("r"))
    return r.select(F.col(id).alias("query_id"), "r.namespace", F.col("r.queryVec").alias("vec"), F.col("r.n").alias("k"), F.coalesce("r.accurate", F.lit(False)).alias("accurate"), F.coalesce("r.drain", F.lit(False)).alias("drain"))


def responses(found: DataFrame, points: DataFrame) -> DataFrame:
    """(query_id, value): the JSON array of each query's points in rank order, with rank and score besides."""
    full = found.select("query_id", "namespace", "node_id", "id", "seq", "rank", "score").join(points.drop("centroid_id"), ["namespace", "node_id", "id", "seq"])
    point = F.struct("rank", "vec", "payload", "expires", F.col("expire_enabled").alias("expireEnabled"), "score")
    return full.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list(point))).alias("value"))
