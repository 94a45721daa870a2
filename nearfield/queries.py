"""The store's queries over the driver's tables, each with DuckDB SQL for the same rows.

``embeddings`` is the store: id and seq are vec_id, a label is a centroid (its vector the mean of its points), the node is
"n" and label % 3, and every fifth point expires some hours after 2024-01-01. Scores are rounded, as sums of doubles
depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.operators import centroids as C
from nearfield.operators import routing as R
from nearfield.operators import search as S
from nearfield.plans.maintenance import Config, maintenance_cycle
from nearfield.plans.state import CENTROID, MANAGER, POINT_COLUMNS, State, len_dp, meta_counts, namespace_nodes, namespaces
from nearfield.sources.requests import put_requests, query_requests
from nearfield.sources.scratch import shared_path, written
from nearfield.sources.store import Store
from nearfield.streaming import put_stream

NOW = "2024-01-11 00:00:00"
N_DRAIN, N_MOVE, K, K_GET = 50, 40, 10, 200

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return register


# --- the tables as a store --------------------------------------------------------------------------------------------


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def points(spark: SparkSession, sf_dir: str, node: Column | None = None) -> DataFrame:
    node = F.concat(F.lit("n"), (F.col("label") % 3).cast("string")) if node is None else node
    return pool(spark, sf_dir).select(
        F.lit("emb").alias("namespace"), node.alias("node_id"), F.col("label").cast("long").alias("centroid_id"), F.col("id").alias("seq"), "id", "vec", F.lit(None).cast("binary").alias("payload"),
        F.expr("timestampadd(HOUR, id, timestamp'2024-01-01')").alias("expires"), (F.col("id") % 5 == 0).alias("expire_enabled"),
    )


def state(spark: SparkSession, sf_dir: str, node: Column | None = None) -> State:
    p = points(spark, sf_dir, node)
    return State(p, V.vec_mean(p, CENTROID).select(*CENTROID, F.col("centroid_id").alias("ord"), "vec"))


def searches(spark: SparkSession, sf_dir: str, k: int = K, drain: bool = False) -> DataFrame:
    """Every row whose id is divisible by 50, as a query."""
    return pool(spark, sf_dir).where("id % 50 = 0").select(F.col("id").alias("query_id"), F.lit("emb").alias("namespace"), "vec", F.lit(k).alias("k"), F.lit(False).alias("accurate"), F.lit(drain).alias("drain"))


def _score(c: str = "score") -> Column:
    return F.round(c, 6).alias(c)


def _placed() -> Column:
    """-1 for a point without a centroid."""
    return F.coalesce("centroid_id", F.lit(-1).cast("long")).alias("centroid_id")


def _why() -> Column:
    return F.coalesce("reason", F.lit("added")).alias("reason")


_E = "e AS (SELECT vec_id AS id, label, 'n' || (label % 3) AS node_id, label::BIGINT AS centroid_id, embedding::DOUBLE[] AS vec, (vec_id % 5 = 0 AND TIMESTAMP '2024-01-01' + vec_id * INTERVAL 1 HOUR < TIMESTAMP '2024-01-11') AS dead FROM embeddings)"


def _mean(by: str, source: str) -> str:
    return f"SELECT {by}, list(m ORDER BY pos) AS vec FROM (SELECT {by}, pos, avg(vec[pos]) AS m FROM {source}, unnest(range(1, len(vec) + 1)) AS u(pos) GROUP BY ALL) GROUP BY ALL"


_BASE = f"WITH {_E},\nc AS ({_mean('node_id, centroid_id', 'e')}),\nn AS ({_mean('node_id', 'c')}),\nq AS (SELECT id AS query_id, vec FROM e WHERE id % 50 = 0)"
_COS = "list_cosine_similarity"

# --- vector functions -------------------------------------------------------------------------------------------------


def _sum(v: Column) -> Column:
    return F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6)


def _next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector beside that of the next id."""
    a = pool(spark, sf_dir)
    return a.join(a.select((F.col("id") - 1).alias("id"), F.col("vec").alias("other")), "id")


_NEXT = f"WITH {_E}, p AS (SELECT a.id, a.vec, b.vec AS other FROM e a JOIN e b ON b.id = a.id + 1)"


@query(f"WITH {_E} SELECT id, round(sqrt(list_inner_product(vec, vec)), 6) AS norm FROM e")
def vec_norm(spark, sf_dir):
    return pool(spark, sf_dir).select("id", F.round(V.norm("vec"), 6).alias("norm"))


@query(f"{_NEXT} SELECT id, round(list_sum(vec) + list_sum(other), 6) AS added, round(list_sum(vec) - list_sum(other), 6) AS subtracted FROM p")
def vec_add_sub(spark, sf_dir):
    return _next(spark, sf_dir).select("id", _sum(V.add("vec", "other")).alias("added"), _sum(V.subtract("vec", "other")).alias("subtracted"))


@query(f"WITH {_E} SELECT id, round(list_sum(list_transform(vec, lambda x: x * 3)), 6) AS scaled, round(list_sum(list_transform(vec, lambda x: x / 4)), 6) AS divided FROM e")
def vec_scale(spark, sf_dir):
    return pool(spark, sf_dir).select("id", _sum(V.scale("vec", 3)).alias("scaled"), _sum(V.divide("vec", 4)).alias("divided"))


@query(f"{_NEXT} SELECT id, round({_COS}(vec, other), 6) AS score FROM p")
def cosine_pairs(spark, sf_dir):
    return _next(spark, sf_dir).select("id", F.round(V.cosine("vec", "other"), 6).alias("score"))


@query(f"{_NEXT} SELECT id, round(list_sum(list_transform(range(1, len(vec) + 1), lambda i: abs(vec[i] - other[i]))), 6) AS l1, round(list_distance(vec, other), 6) AS l2 FROM p")
def l1_pairs(spark, sf_dir):
    return _next(spark, sf_dir).select("id", F.round(V.l1_distance("vec", "other"), 6).alias("l1"), F.round(V.l2_distance("vec", "other"), 6).alias("l2"))


@query(f"{_NEXT} SELECT id, vec = other AS same, vec = vec AS itself, list_contains([other, vec], vec) AS among FROM p")
def vec_eq_in(spark, sf_dir):
    return _next(spark, sf_dir).select("id", V.equal("vec", "other").alias("same"), V.equal("vec", "vec").alias("itself"), V.contains(F.array("other", "vec"), "vec").alias("among"))


# --- search -----------------------------------------------------------------------------------------------------------


def _top(metric: V.Metric, largest: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the vector of the smallest id."""
    p = pool(spark, sf_dir)
    first = p.agg(F.min_by("vec", "id").alias("target"))
    found = S.top_k(p.crossJoin(F.broadcast(first)), F.col("target"), K, metric, largest)
    return found.select("id", "rank", _score())


_L1 = "list_sum(list_transform(range(1, len(e.vec) + 1), lambda i: abs(e.vec[i] - t.vec[i])))"
for _name, _metric, _largest, _sql in (("knn_cos_top10", V.cosine, True, f"{_COS}(e.vec, t.vec)"), ("kfn_cos_top10", V.cosine, False, f"{_COS}(e.vec, t.vec)"), ("knn_l1_top10", V.l1_distance, False, _L1), ("kfn_l1_top10", V.l1_distance, True, _L1)):
    query(
        f"WITH {_E}, t AS (SELECT vec FROM e ORDER BY id LIMIT 1), s AS (SELECT e.id, {_sql} AS score FROM e, t), r AS (SELECT id, row_number() OVER (ORDER BY score {'DESC' if _largest else 'ASC'}, id)::INTEGER AS rank, score FROM s) SELECT id, rank, round(score, 6) AS score FROM r WHERE rank <= {K}",
        _name,
    )(partial(_top, _metric, _largest))


@query(f"WITH {_E}, s AS (SELECT q.id AS query_id, e.id, {_COS}(q.vec, e.vec) AS score FROM e q, e WHERE q.id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM s) SELECT query_id, id, rank, round(score, 6) AS score FROM r WHERE rank <= {K}")
def knn_cos_batch(spark, sf_dir):
    return S.knn_batch(searches(spark, sf_dir).select("query_id", "vec"), pool(spark, sf_dir), K).select("query_id", "id", "rank", _score())


@query(f"{_BASE}, s AS (SELECT query_id, id, {_COS}(q.vec, e.vec) AS score FROM e, q WHERE NOT dead), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM s) SELECT query_id, id, rank, round(score, 6) AS score FROM r WHERE rank <= {K}")
def exact_top_k(spark, sf_dir):
    return R.exact_top_k(state(spark, sf_dir), searches(spark, sf_dir), NOW).select("query_id", "id", "rank", _score())


# --- means and counts -------------------------------------------------------------------------------------------------


def _long(df: DataFrame, *by: str) -> DataFrame:
    return df.select(*by, F.posexplode("vec").alias("pos", "x")).select(*by, "pos", F.round("x", 6).alias("x"))


@query(f"{_BASE} SELECT node_id, centroid_id, (pos - 1)::INTEGER AS pos, round(vec[pos], 6) AS x FROM c, unnest(range(1, len(vec) + 1)) AS u(pos)")
def centroid_mean(spark, sf_dir):
    return _long(C.move_vector(state(spark, sf_dir)).centroids, "node_id", "centroid_id")


@query(f"{_BASE} SELECT node_id, (pos - 1)::INTEGER AS pos, round(vec[pos], 6) AS x FROM n, unnest(range(1, len(vec) + 1)) AS u(pos)")
def manager_mean(spark, sf_dir):
    return _long(state(spark, sf_dir).nodes(), "node_id")


@query(f"{_BASE} SELECT 'emb' AS namespace, node_id, count(*) AS n_points FROM e GROUP BY ALL", "len_dp")
def _len_dp(spark, sf_dir):
    return len_dp(state(spark, sf_dir))


@query("SELECT DISTINCT 'emb' AS namespace FROM embeddings", "namespaces")
def _namespaces(spark, sf_dir):
    return namespaces(state(spark, sf_dir))


@query(f"WITH {_E} SELECT 'emb' AS namespace, string_agg(DISTINCT node_id, ',' ORDER BY node_id) AS node_ids FROM e", "namespace_nodes")
def _namespace_nodes(spark, sf_dir):
    return namespace_nodes(state(spark, sf_dir)).select("namespace", F.concat_ws(",", "node_ids").alias("node_ids"))


@query(f"WITH {_E} SELECT node_id, 'emb' AS namespace, count(DISTINCT centroid_id) AS n_centroids, count(*) AS n_points FROM e GROUP BY ALL", "meta_counts")
def _meta_counts(spark, sf_dir):
    return meta_counts(state(spark, sf_dir))


# --- assignment and lookup --------------------------------------------------------------------------------------------


@query(f"{_BASE}, s AS (SELECT e.id, c.centroid_id, {_COS}(e.vec, c.vec) AS score FROM e JOIN c USING (node_id) WHERE NOT dead), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, centroid_id) AS k FROM s) SELECT e.id, coalesce(r.centroid_id, -1) AS centroid_id, round(coalesce(r.score, 0), 6) AS score, CASE WHEN dead THEN 'expired' ELSE 'added' END AS reason FROM e LEFT JOIN r ON e.id = r.id AND k = 1")
def assign_nearest_centroid(spark, sf_dir):
    s = state(spark, sf_dir)
    return C.assign(s, s.points, NOW).select("id", _placed(), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"), _why())


_CRANK = f"cr AS (SELECT query_id, c.node_id, c.centroid_id, {_COS}(q.vec, c.vec) AS cscore, row_number() OVER (PARTITION BY query_id, node_id ORDER BY {_COS}(q.vec, c.vec) DESC, centroid_id)::INTEGER AS crank FROM q, c)"
_PRANK = f"pr AS (SELECT cr.*, e.id, {_COS}(q.vec, e.vec) AS score, row_number() OVER (PARTITION BY query_id, cr.node_id, cr.centroid_id ORDER BY {_COS}(q.vec, e.vec) DESC, e.id)::INTEGER AS prank FROM cr JOIN q USING (query_id) JOIN e ON e.node_id = cr.node_id AND e.centroid_id = cr.centroid_id WHERE NOT dead)"


@query(f"{_BASE}, {_CRANK} SELECT query_id, node_id, centroid_id, crank, round(cscore, 6) AS cscore FROM cr WHERE crank <= 2")
def nearest_centroids(spark, sf_dir):
    return C.nearest_centroids(state(spark, sf_dir), searches(spark, sf_dir), 2).select("query_id", "node_id", "centroid_id", "crank", _score("cscore"))


@query(f"{_BASE}, {_CRANK} SELECT query_id, cr.node_id, round(list_sum(c.vec), 6) AS vec_sum FROM cr JOIN c ON c.centroid_id = cr.centroid_id AND c.node_id = cr.node_id WHERE crank = 1")
def nearest_centroid_vec(spark, sf_dir):
    s = state(spark, sf_dir)
    return C.nearest_centroids(s, searches(spark, sf_dir), 1).join(s.centroids, CENTROID).select("query_id", "node_id", _sum(F.col("vec")).alias("vec_sum"))


@query(f"{_BASE}, {_CRANK}, {_PRANK} SELECT query_id, node_id, centroid_id, id, prank, round(score, 6) AS score FROM pr WHERE prank <= {K}")
def centroid_lookup(spark, sf_dir):
    return C.centroid_lookup(state(spark, sf_dir), searches(spark, sf_dir), NOW).select("query_id", "node_id", "centroid_id", "id", "prank", _score())


_MANAGER = f"{_BASE}, {_CRANK}, {_PRANK}, m AS (SELECT *, row_number() OVER (PARTITION BY query_id, node_id ORDER BY crank, prank)::INTEGER AS rank FROM pr WHERE crank <= {{k}} AND prank <= {{k}})"


@query(_MANAGER.format(k=K_GET) + f" SELECT query_id, node_id, centroid_id, id, rank, round(score, 6) AS score FROM m WHERE rank <= {K_GET}")
def manager_lookup(spark, sf_dir):
    return C.manager_lookup(state(spark, sf_dir), searches(spark, sf_dir, K_GET), NOW).select("query_id", "node_id", "centroid_id", "id", "rank", _score())


@query(_MANAGER.format(k=K) + f" SELECT id, node_id FROM e WHERE NOT dead AND id NOT IN (SELECT id FROM m WHERE rank <= {K})")
def lookup_drain_remainder(spark, sf_dir):
    return C.lookup_and_drain(state(spark, sf_dir), searches(spark, sf_dir), NOW)[1].points.select("id", "node_id")


# --- draining, expiry and reshaping -----------------------------------------------------------------------------------


def _drained(order: str, n: int) -> str:
    return f"d1 AS (SELECT e.*, row_number() OVER (PARTITION BY e.node_id, e.centroid_id ORDER BY {order}) AS pos FROM e JOIN c ON c.node_id = e.node_id AND c.centroid_id = e.centroid_id WHERE NOT dead), d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY pos, centroid_id) AS turn FROM d1) WHERE turn <= {n})"


_WORST = f"{_COS}(e.vec, c.vec), e.id"


@query(f"{_BASE}, {_drained('e.id', N_DRAIN)} SELECT node_id, centroid_id, id FROM d")
def drain_unordered(spark, sf_dir):
    return C.drain(state(spark, sf_dir), N_DRAIN, NOW)[0].select("node_id", "centroid_id", "id")


@query(f"{_BASE}, {_drained(_WORST, N_DRAIN)} SELECT node_id, centroid_id, id FROM d")
def drain_ordered(spark, sf_dir):
    return C.drain(state(spark, sf_dir), N_DRAIN, NOW, ordered=True)[0].select("node_id", "centroid_id", "id")


@query(f"{_BASE}, {_drained('e.id', N_DRAIN)} SELECT node_id, centroid_id, count(*) AS n_taken FROM d GROUP BY ALL")
def portions(spark, sf_dir):
    return C.portions(state(spark, sf_dir), N_DRAIN, NOW).select("node_id", "centroid_id", "n_taken")


@query(f"{_BASE}, l AS ({_mean('node_id, centroid_id', '(SELECT * FROM e WHERE NOT dead)')}) SELECT c.node_id, c.centroid_id, (SELECT count(*) FROM e WHERE NOT dead AND e.centroid_id = c.centroid_id) AS n_points, round(list_sum(coalesce(l.vec, c.vec)), 6) AS vec_sum FROM c LEFT JOIN l USING (node_id, centroid_id)")
def expire(spark, sf_dir):
    s = C.expire(state(spark, sf_dir), NOW)
    return s.sizes().join(s.centroids.select(*CENTROID, _sum(F.col("vec")).alias("vec_sum")), CENTROID).select("node_id", "centroid_id", "n_points", "vec_sum")


@query(f"WITH {_E} SELECT node_id, centroid_id, count(*) AS n_points FROM e WHERE NOT dead GROUP BY ALL")
def mem_trim(spark, sf_dir):
    return C.mem_trim(state(spark, sf_dir), NOW).sizes().select("node_id", "centroid_id", "n_points")


@query(f"WITH {_E}, z AS (SELECT node_id, centroid_id, count(*) AS n FROM e GROUP BY ALL), w AS (SELECT *, max(centroid_id) OVER (PARTITION BY node_id) + row_number() OVER (PARTITION BY node_id ORDER BY n <= 20, centroid_id) AS new_id FROM z), r AS (SELECT e.*, n, new_id, row_number() OVER (PARTITION BY e.node_id, e.centroid_id ORDER BY id) AS age FROM e JOIN w USING (node_id, centroid_id)) SELECT id, node_id, CASE WHEN n > 20 AND age <= n // 2 THEN new_id ELSE centroid_id END AS centroid_id FROM r")
def split_centroids(spark, sf_dir):
    return C.split_by_size(state(spark, sf_dir), 20, 1_000_000_000).points.select("id", "node_id", "centroid_id")


def _merged(low: int, high: int) -> str:
    """A manager's centroids as lists, and a step for each in order: those it absorbs go, its size and vector grow."""
    summed = lambda what: f"coalesce(list_sum(list_transform(taken, lambda t: {what})), 0)"
    return f"""WITH RECURSIVE {_E}, c AS ({_mean('node_id, centroid_id', 'e')}), z AS (SELECT node_id, centroid_id, count(*) AS n FROM e GROUP BY ALL),
r AS (SELECT node_id, list(centroid_id ORDER BY centroid_id) AS ids, list(n ORDER BY centroid_id) AS n, list(vec ORDER BY centroid_id) AS vecs, list(false) AS gone, 1::BIGINT AS i FROM z JOIN c USING (node_id, centroid_id) GROUP BY node_id
UNION ALL SELECT node_id, ids,
  list_transform(range(1, len(ids) + 1), lambda j: CASE WHEN j = i THEN (n[i] + {summed("n[t]")})::BIGINT WHEN list_contains(taken, j) THEN 0 ELSE n[j] END),
  list_transform(range(1, len(ids) + 1), lambda j: CASE WHEN j <> i OR len(taken) = 0 THEN vecs[j] ELSE list_transform(range(1, len(vecs[i]) + 1), lambda p: (n[i] * vecs[i][p] + {summed("n[t] * vecs[t][p]")}) / (n[i] + {summed("n[t]")})) END),
  list_transform(range(1, len(ids) + 1), lambda j: gone[j] OR list_contains(taken, j)), i + 1
FROM (SELECT *, CASE WHEN NOT gone[i] AND n[i] > {low} AND n[i] < {high} THEN o[1:len(list_filter(range(1, len(o) + 1), lambda p: n[i] + coalesce(list_sum(list_transform(o[1:p - 1], lambda j: n[j])), 0) < {high}))] ELSE [] END AS taken
  FROM (SELECT *, list_transform(list_sort(list_transform(list_filter(range(1, len(ids) + 1), lambda j: j <> i AND NOT gone[j]), lambda j: {{'s': -{_COS}(vecs[i], vecs[j]), 'j': j}})), lambda x: x.j) AS o FROM r WHERE i <= len(ids))))
SELECT node_id, ids[j] AS centroid_id, n[j] AS n_points FROM r, unnest(range(1, len(ids) + 1)) AS u(j) WHERE i > len(ids) AND NOT gone[j]"""


@query(_merged(-1, 150))
def merge_centroids(spark, sf_dir):
    return C.merge_centroids(written_state(state(spark, sf_dir)), -1, 150).sizes().select("node_id", "centroid_id", "n_points")


def written_state(s: State) -> State:
    """Both tables written to the shared folder, so that later plans don't hold how they came about."""
    return State(written(s.points, "points"), written(s.centroids, "centroids"))


_REST = f"rest AS ({_mean('node_id, centroid_id', '(SELECT * FROM e WHERE NOT dead AND id NOT IN (SELECT id FROM d))')}), c2 AS (SELECT c.node_id, c.centroid_id, coalesce(rest.vec, c.vec) AS vec FROM c LEFT JOIN rest USING (node_id, centroid_id)), n2 AS ({_mean('node_id', 'c2')})"
_KEPT = "SELECT id, node_id, centroid_id FROM e WHERE NOT dead AND id NOT IN (SELECT id FROM d) UNION ALL"
_BEST_CENTROID = f"SELECT id, node_id, centroid_id FROM (SELECT t.id, c2.node_id, c2.centroid_id, row_number() OVER (PARTITION BY t.id ORDER BY {_COS}(t.vec, c2.vec) DESC, c2.centroid_id) AS k FROM t JOIN c2 ON t.to_node = c2.node_id) WHERE k = 1"


@query(f"{_BASE}, {_drained(_WORST, N_MOVE)}, {_REST}, t AS (SELECT *, node_id AS to_node FROM d) {_KEPT} {_BEST_CENTROID}")
def distribute_internal(spark, sf_dir):
    return C.distribute_internal(written_state(state(spark, sf_dir)), N_MOVE, NOW).points.select("id", "node_id", "centroid_id")


# --- nodes ------------------------------------------------------------------------------------------------------------


def _drawn(*parts: str) -> str:
    """52 bits of the MD5 of seed 1 and the parts."""
    return f"('0x' || substr(md5('1' || {' || '.join(f"':' || {p}" for p in parts)}), 1, 13))::BIGINT"


def _node_rank(route: str, queries: str = "q", nodes: str = "n", cents: str = "c", key: str = "query_id") -> str:
    table = nodes if route == "fast" else cents
    if route == "random":
        return f"nr AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY nscore DESC, node_id)::INTEGER AS nrank FROM (SELECT q.{key}, t.node_id, {_drawn(f'q.{key}', 't.node_id')} / {float(1 << 52)}::DOUBLE AS nscore FROM {queries} q, {nodes} t))"
    return f"nr AS (SELECT {key}, node_id, nscore, row_number() OVER (PARTITION BY {key} ORDER BY nscore DESC, node_id)::INTEGER AS nrank FROM (SELECT q.{key}, t.node_id, max({_COS}(q.vec, t.vec)) AS nscore FROM {queries} q, {table} t GROUP BY ALL))"


def _best_fit(route: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_fit_nodes(state(spark, sf_dir), searches(spark, sf_dir), route, seed=1).select("query_id", "node_id", "nrank", _score("nscore"))


def _get(route: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.get_points(written_state(state(spark, sf_dir)), searches(spark, sf_dir, K_GET), route, NOW, seed=1)
    return found.select("query_id", "node_id", "centroid_id", "id", "rank", _score())


def _put(route: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's opposite, as a new point."""
    p = points(spark, sf_dir).drop("node_id", "centroid_id").withColumn("vec", V.scale("vec", -1)).withColumn("id", F.col("id") + 1_000_000_000)
    return R.put_points(written_state(state(spark, sf_dir)), p, route, NOW, seed=1)[0].select("id", "node_id", _placed(), _why())


def _distribute(route: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.distribute(written_state(state(spark, sf_dir)), N_MOVE, route, NOW).points.select("id", "node_id", "centroid_id")


_NEW = "w AS (SELECT id + 1000000000 AS id, list_transform(vec, lambda x: -x) AS vec, dead FROM e)"
_FIRST = {r: f"{_node_rank(r, 'w', key='id')}, t AS (SELECT w.*, nr.node_id AS to_node FROM w JOIN nr USING (id) WHERE nrank = 1)" for r in ("fast", "accurate")}
_FIRST["random"] = f"t AS (SELECT w.*, names[{_drawn('id')} % len(names) + 1] AS to_node FROM w, (SELECT list(DISTINCT node_id ORDER BY node_id) AS names FROM e))"
for _route in R.ROUTES:
    query(f"{_BASE}, {_node_rank(_route)} SELECT query_id, node_id, nrank, round(nscore, 6) AS nscore FROM nr", f"best_fit_nodes_{_route}")(partial(_best_fit, _route))
    query(
        f"{_BASE}, {_CRANK}, {_PRANK}, {_node_rank(_route)}, g AS (SELECT pr.*, row_number() OVER (PARTITION BY pr.query_id ORDER BY nrank, crank, prank)::INTEGER AS rank FROM pr JOIN nr ON nr.query_id = pr.query_id AND nr.node_id = pr.node_id) SELECT query_id, node_id, centroid_id, id, rank, round(score, 6) AS score FROM g WHERE rank <= {K_GET}",
        f"get_{_route}",
    )(partial(_get, _route))
    query(
        f"{_BASE}, {_NEW}, {_FIRST[_route]}, c2 AS (SELECT * FROM c), b AS ({_BEST_CENTROID}) SELECT t.id, to_node AS node_id, CASE WHEN dead THEN -1 ELSE b.centroid_id END AS centroid_id, CASE WHEN dead THEN 'expired' ELSE 'added' END AS reason FROM t JOIN b USING (id)",
        f"put_{_route}",
    )(partial(_put, _route))
for _route in ("fast", "accurate"):
    query(
        f"{_BASE}, {_drained(_WORST, N_MOVE)}, {_REST}, {_node_rank(_route, 'd', 'n2', 'c2', 'id')}, t AS (SELECT d.*, nr.node_id AS to_node FROM d JOIN nr USING (id) WHERE nrank = 1) {_KEPT} {_BEST_CENTROID}",
        f"distribute_{_route}",
    )(partial(_distribute, _route))


@query(f"{_BASE}, {_drained(_WORST, N_MOVE)}, t AS (SELECT id, vec FROM d WHERE node_id <> 'n1'), b AS (SELECT id, centroid_id FROM (SELECT t.id, c.centroid_id, row_number() OVER (PARTITION BY t.id ORDER BY {_COS}(t.vec, c.vec) DESC, c.centroid_id) AS k FROM t, c WHERE c.node_id = 'n1') WHERE k = 1) SELECT id, 'n1' AS node_id, centroid_id FROM b UNION ALL SELECT id, node_id, centroid_id FROM e WHERE NOT dead AND id NOT IN (SELECT id FROM t) AND node_id <> 'n1' UNION ALL SELECT id, node_id, centroid_id FROM e WHERE node_id = 'n1'")
def distribute_to_receivers(spark, sf_dir):
    """The managers of n0 and n2 give their worst points to the centroids of n1."""
    s = written_state(state(spark, sf_dir))
    part = lambda keep: State(s.points.where(keep), s.centroids.where(keep))
    left, got = C.distribute_to(part("node_id <> 'n1'"), part("node_id = 'n1'"), N_MOVE, NOW)
    return left.points.unionByName(got.points).select("id", "node_id", "centroid_id")


@query(f"{_BASE}, {_CRANK} SELECT id, node_id, centroid_id FROM e WHERE NOT EXISTS (SELECT 1 FROM cr WHERE crank = 1 AND query_id = 0 AND cr.node_id = e.node_id AND cr.centroid_id = e.centroid_id)")
def take_centroids(spark, sf_dir):
    """What is left when each manager gives away its centroid nearest to the first vector, with its points."""
    return C.take_centroids(written_state(state(spark, sf_dir)), searches(spark, sf_dir).where("query_id = 0"), 1)[1].points.select("id", "node_id", "centroid_id")


@query(f"{_BASE}, {_CRANK}, {_PRANK}, {_node_rank('fast')}, g AS (SELECT pr.*, row_number() OVER (PARTITION BY pr.query_id ORDER BY nrank, crank, prank)::INTEGER AS rank FROM pr JOIN nr ON nr.query_id = pr.query_id AND nr.node_id = pr.node_id) SELECT id, node_id FROM e WHERE NOT dead AND id NOT IN (SELECT id FROM g WHERE rank <= {K})")
def get_drain_remainder(spark, sf_dir):
    """What is left when every query takes its answers out of the store."""
    return R.get_and_drain(written_state(state(spark, sf_dir)), searches(spark, sf_dir, drain=True), "fast", NOW)[1].points.select("id", "node_id")


@query(f"WITH {_E}, x AS (SELECT *, max(centroid_id) OVER (PARTITION BY node_id) AS last, row_number() OVER (PARTITION BY node_id, centroid_id ORDER BY id) AS age, count(*) OVER (PARTITION BY node_id, centroid_id) AS n FROM e), z AS (SELECT *, greatest(0, (n - 20) // 10 + 1) AS times FROM x WHERE n >= 20), f AS (SELECT DISTINCT node_id, centroid_id, times FROM z), b AS (SELECT *, sum(times) OVER (PARTITION BY node_id ORDER BY centroid_id) - times AS before FROM f) SELECT x.id, x.node_id, CASE WHEN b.times IS NOT NULL AND (age - 1) // 10 < b.times THEN (last + before + 1 + (age - 1) // 10)::BIGINT ELSE x.centroid_id END AS centroid_id FROM x LEFT JOIN b USING (node_id, centroid_id)")
def auto_split(spark, sf_dir):
    """Adding nothing to centroids that are over the threshold already: each gives its ten oldest points until it is below 20."""
    s = written_state(state(spark, sf_dir))
    return C.add_points(s, s.points.where("false"), NOW, threshold=20)[1].points.select("id", "node_id", "centroid_id")


_STEAL = f"{_BASE}, z AS (SELECT node_id, centroid_id, count(*) AS n_points FROM e GROUP BY ALL), o AS (SELECT z.*, row_number() OVER (ORDER BY {_COS}(c.vec, t.vec) DESC, c.centroid_id) AS k FROM z JOIN c USING (node_id, centroid_id), n t WHERE z.node_id = 'n0' AND t.node_id = 'n1'), g AS (SELECT *, coalesce(sum(n_points) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM o), moved AS (SELECT * FROM g WHERE before < 60)"


@query(f"{_STEAL} SELECT centroid_id, n_points, before FROM moved")
def steal_plan(spark, sf_dir):
    return R.steal_plan(state(spark, sf_dir), "emb", "n0", "n1", 60)


@query(f"{_STEAL} SELECT id, CASE WHEN centroid_id IN (SELECT centroid_id FROM moved) THEN 'n1' ELSE node_id END AS node_id FROM e")
def steal_centroids(spark, sf_dir):
    return R.steal_centroids(written_state(state(spark, sf_dir)), "emb", "n0", "n1", 60).points.select("id", "node_id")


def _uneven() -> Column:
    return F.when(F.col("label") < 7, "n0").when(F.col("label") < 9, "n1").otherwise("n2")


@query("WITH x AS (SELECT CASE WHEN label < 7 THEN 'n0' WHEN label < 9 THEN 'n1' ELSE 'n2' END AS node_id, count(*) AS n FROM embeddings GROUP BY ALL), t AS (SELECT sum(n)::BIGINT // 3 AS mean, floor(0.4 * (sum(n)::BIGINT // 3)) AS margin FROM x) SELECT 'emb' AS namespace, a.node_id, b.node_id AS from_node, ((mean - a.n) // 3 // 3)::BIGINT AS n_transfer FROM x a, x b, t WHERE a.node_id <> b.node_id AND a.n <= mean - margin AND (mean - a.n) // 3 // 3 > 0 AND b.n - (mean - a.n) // 3 // 3 >= mean + margin")
def load_balance_plan(spark, sf_dir):
    return R.load_balance_plan(state(spark, sf_dir, _uneven()))


# --- the store itself -------------------------------------------------------------------------------------------------


@query()
def maintenance_cycle_pass(spark, sf_dir):
    """All steps of pass 0 over an uneven store, with the counts afterwards."""
    config = Config(n_internal=N_MOVE, n_fast=N_MOVE, n_accurate=N_MOVE, split_range=(100, 1_000_000_000), merge_range=(-1, 20))
    return meta_counts(maintenance_cycle(written_state(state(spark, sf_dir, _uneven())), config, 0, NOW, settle=written_state))


@query(f"WITH {_E} SELECT id, 'n0' AS node_id, 0::BIGINT AS centroid_id FROM e WHERE NOT dead")
def stream_put(spark, sf_dir):
    """All points streamed into an empty store: the first founds a centroid, which all others join."""
    store = Store(spark, shared_path(spark, "store"), Config(split_threshold=0))
    source = spark.readStream.schema("vec_id bigint, embedding array<float>, label int").parquet(f"{sf_dir}/embedding[s].parquet")
    rows = source.select(
        F.lit("emb").alias("namespace"), F.col("vec_id").alias("seq"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.lit(None).cast("binary").alias("payload"),
        F.expr("timestampadd(HOUR, vec_id, timestamp'2024-01-01')").alias("expires"), (F.col("vec_id") % 5 == 0).alias("expire_enabled"),
    )
    put_stream(rows, store, shared_path(spark, "stream"), now=NOW).awaitTermination()
    return store.load().points.select("id", "node_id", "centroid_id")


@query(f"WITH {_E} SELECT id, 'emb' AS namespace, id % 2 = 0 AS accurate, round(list_sum(vec), 6) AS vec_sum, id % 5 = 0 AS expire_enabled FROM e")
def put_request_codec(spark, sf_dir):
    """Every point through the JSON of a put request and back; the payload carries its id."""
    p = pool(spark, sf_dir)
    dp = F.struct("vec", F.encode(F.col("id").cast("string"), "UTF-8").alias("payload"), F.lit(None).cast("timestamp").alias("expires"), (F.col("id") % 5 == 0).alias("expireEnabled"))
    lines = p.select(F.to_json(F.struct(F.lit("emb").alias("namespace"), (F.col("id") % 2 == 0).alias("accurate"), dp.alias("dp"))).alias("value"))
    return put_requests(lines).select(F.decode("payload", "UTF-8").cast("long").alias("id"), "namespace", "accurate", _sum(F.col("vec")).alias("vec_sum"), "expire_enabled")


@query(f"WITH {_E} SELECT id AS query_id, 'emb' AS namespace, {K} AS k, false AS accurate, true AS drain, round(list_sum(vec), 6) AS vec_sum FROM e")
def query_request_codec(spark, sf_dir):
    p = pool(spark, sf_dir)
    lines = p.select(F.col("id").alias("query_id"), F.to_json(F.struct(F.lit("emb").alias("namespace"), F.lit(False).alias("accurate"), F.col("vec").alias("queryVec"), F.lit(K).alias("n"), F.lit(True).alias("drain"))).alias("value"))
    return query_requests(lines).select("query_id", "namespace", "k", "accurate", "drain", _sum(F.col("vec")).alias("vec_sum"))


_LINE = "line AS (SELECT l_orderkey::BIGINT AS k, l_linenumber::BIGINT AS n, [l_quantity, l_extendedprice / 1000, l_discount * 100, l_tax * 100] AS vec FROM lineitem), f AS (SELECT l_returnflag || l_linestatus AS node_id, [avg(l_quantity), avg(l_extendedprice / 1000), avg(l_discount * 100), avg(l_tax * 100)] AS vec FROM lineitem GROUP BY ALL)"


@query(f"WITH {_LINE}, s AS (SELECT k, n, line.vec, f.node_id, {_COS}(line.vec, f.vec) AS score FROM line, f), b AS (SELECT k, n, vec, max_by(node_id, score) AS node_id, max(score) AS score FROM s GROUP BY ALL) SELECT node_id, count(*) AS n_rows, round(sum(score), 3) AS score_sum FROM b GROUP BY ALL")
def lineitem_assign(spark, sf_dir):
    """Every line item's four measures assigned to the nearest of the return flags' means: a large assignment."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = [F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_discount") * 100, F.col("l_tax") * 100]
    rows = li.select("l_orderkey", "l_linenumber", F.array(*parts).alias("vec"))
    means = li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("receiver_id")).agg(F.array(*[F.avg(p) for p in parts]).alias("vec"))
    found = S.nearest(rows, means, 1)
    return found.groupBy(F.col("receiver_id").alias("node_id")).agg(F.count("*").alias("n_rows"), F.round(F.sum("score"), 3).alias("score_sum"))
