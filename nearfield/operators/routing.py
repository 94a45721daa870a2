"""Operators over nodes: routing, put and get, redistribution, stealing and load balance.

A node is a logical shard: the managers with its node_id. "Fast" routing ranks nodes by their manager's vector,
"accurate" routing by their nearest centroid. Ties go to the smaller node_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.vectors import cosine, norm
from nearfield.operators.centroids import Now, add_points, assign, drain, live, move_vector, probe, ranked_centroids, still_missing, without
from nearfield.operators.search import knn_batch, nearest, usable
from nearfield.plans.state import CENTROID, MANAGER, POINT_COLUMNS, State
from nearfield.sources.scratch import small, written

ROUTES = ("fast", "accurate", "random")


def _draw(seed: int, *parts: Column) -> Column:
    """52 bits of the MD5 of the seed and the parts, joined by colons: any engine draws the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary")), 1, 13), 16, 10).cast("long")


def random_rank(key: Column, node: Column, seed: int) -> Column:
    """A number in [0, 1) for each key and node that orders the nodes, the same whenever the seed is."""
    return _draw(seed, key.cast("string"), node) / F.lit(float(1 << 52))


def best_fit_nodes(state: State, queries: DataFrame, route: str = "fast", seed: int = 0) -> DataFrame:
    """(query_id, namespace, node_id, nrank, nscore): the nodes that can answer each query, best first."""
    return ranked_nodes(state, small(queries, "queries"), route, seed)


def ranked_nodes(state: State, queries: DataFrame, route: str, seed: int) -> DataFrame:
    """``best_fit_nodes`` of queries that ``small`` has measured."""
    if route not in ROUTES:
        raise ValueError(f"route must be one of {ROUTES}")
    q = queries.select("query_id", "namespace", F.col("vec").alias("qvec")).withColumn("qn", norm("qvec"))
    if route == "random":
        pairs = state.centroids.select(*MANAGER).distinct().join(q, "namespace")
        scored = pairs.withColumn("nscore", random_rank(F.col("query_id"), F.col("node_id"), seed))
    else:
        table = state.nodes() if route == "fast" else state.centroids.select(*MANAGER, "vec")
        scored = table.join(q, "namespace").withColumn("nscore", cosine("qvec", "vec", F.col("qn"))).where(usable("nscore"))
        if route == "accurate":
            scored = scored.groupBy("query_id", *MANAGER).agg(F.max("nscore").alias("nscore"))
    order = Window.partitionBy("query_id").orderBy(F.desc("nscore"), "node_id")
    return scored.withColumn("nrank", F.row_number().over(order)).select("query_id", *MANAGER, "nrank", "nscore")


def get_points(state: State, queries: DataFrame, route: str = "fast", now: Now = None, seed: int = 0) -> DataFrame:
    """(query_id, namespace, node_id, centroid_id, id, seq, rank, score): k points for each query (columns of QUERIES).

    Nodes are visited in routing order, and within a node centroids from the nearest on. A node is asked for what is
    still missing, and probes at most so many centroids; results aren't ranked anew across centroids or nodes.
    """
    queries = small(queries, "queries")
    most = queries.agg(F.max("k")).first()[0] or 0
    ks = queries.select("query_id", F.greatest("k", F.lit(0)).alias("k"))
    alive = live(state.points, now)
    sizes = small(alive.groupBy(*CENTROID).agg(F.count("*").alias("n")), "sizes")
    probes = written(ranked_centroids(state, queries, most).join(sizes, CENTROID, "left").withColumn("n", F.coalesce("n", F.lit(0))), "probes")
    per_node = probes.groupBy("query_id", *MANAGER).agg(F.transform(F.array_sort(F.collect_list(F.struct("crank", "n"))), lambda e: e["n"]).alias("sizes"))
    visits = ranked_nodes(state, queries, route, seed).join(per_node, ["query_id", *MANAGER]).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("nrank", "node_id", "sizes"))).alias("visits"))
    # what each visit may probe: what is missing when its turn comes
    plan = F.aggregate(
        "visits",
        F.struct(F.col("k").cast("long").alias("left"), F.expr("array(cast(null as struct<nrank: int, node_id: string, ask: bigint>))").alias("asked")),
        lambda acc, v: F.struct(
            (acc["left"] - F.least(acc["left"], F.aggregate(F.slice(v["sizes"], 1, F.greatest(acc["left"], F.lit(1)).cast("int")), F.lit(0).cast("long"), lambda a, x: a + x))).alias("left"),
            F.concat(acc["asked"], F.array(F.struct(v["nrank"].alias("nrank"), v["node_id"].alias("node_id"), acc["left"].alias("ask")))).alias("asked"),
        ),
        lambda acc: acc["asked"],
    )
    asked = visits.join(ks, "query_id").select("query_id", F.explode(plan).alias("v")).where("v.ask > 0").select("query_id", "v.nrank", "v.node_id", "v.ask")
    probes = probes.drop("n").join(small(asked), ["query_id", "node_id"]).where("crank <= ask")
    found = probe(alive, still_missing(alive, probes, queries, ["query_id"], ["nrank", "crank"]), queries).join(ks, "query_id")
    order = Window.partitionBy("query_id").orderBy("nrank", "crank", "prank")
    return found.withColumn("rank", F.row_number().over(order)).where("rank <= k").select("query_id", *CENTROID, "id", "seq", "rank", "score")


def get_and_drain(state: State, queries: DataFrame, route: str = "fast", now: Now = None, seed: int = 0) -> tuple[DataFrame, State]:
    """``get_points``, and the state without what the queries that drain have found."""
    found = written(get_points(state, queries, route, now, seed), "found")
    taken = found.join(queries.where("drain").select("query_id"), "query_id", "left_semi")
    return found, move_vector(state.having(points=without(live(state.points, now), taken)))


def exact_top_k(state: State, queries: DataFrame, now: Now = None) -> DataFrame:
    """(query_id, id, rank, score): the true k most similar live points of the namespace, an addition of ours."""
    return knn_batch(queries, live(state.points, now), F.col("k"), on=["namespace"])


def route_points(state: State, points: DataFrame, route: str = "fast", seed: int = 0) -> DataFrame:
    """``points`` (namespace, id, vec, ...) with the node_id that ranks first for each; a point that no node can rank goes
    to a random one of ``nodes``' node_ids (of all namespaces). One line for each row, whatever ids repeat."""
    if route not in ROUTES:
        raise ValueError(f"route must be one of {ROUTES}")
    points = points.drop("node_id")
    spots = F.broadcast(state.centroids.select("node_id").distinct().agg(F.array_sort(F.collect_set("node_id")).alias("all_nodes")))  # one row: the nodes' names
    lucky = F.when(F.size("all_nodes") > 0, F.element_at("all_nodes", (_draw(seed, F.col("id").cast("string")) % F.greatest(F.size("all_nodes"), F.lit(1))).cast("int") + 1))
    if route == "random":
        return points.crossJoin(spots).withColumn("node_id", lucky).drop("all_nodes")
    by_node = state.nodes() if route == "fast" else state.centroids.select(*MANAGER, "vec")
    best = nearest(points, by_node, 1, ["namespace"], receiver="node_id", keep=True).drop("rank", "score")
    return best.crossJoin(spots).withColumn("node_id", F.coalesce("node_id", lucky)).drop("all_nodes")


def put_points(state: State, points: DataFrame, route: str = "fast", now: Now = None, threshold: int = 0, seed: int = 0) -> tuple[DataFrame, State]:
    """Add points to the nodes that routing picks: (report, new state). The report says who was rejected and why."""
    return add_points(state, route_points(state, points, route, seed), now, threshold)


def distribute(state: State, n: int, route: str = "fast", now: Now = None) -> State:
    """The ``n`` points of each manager that are least like their centroid move to the node that routing picks for them
    (maybe their own), and to its nearest centroid. A point that no node can take stays where it was."""
    taken, rest = drain(state, n, now, ordered=True)
    was = taken.withColumns({"was_node": F.col("node_id"), "was": F.col("centroid_id")})
    placed = assign(rest, route_points(rest, was, route), now)
    stays = F.col("reason").isNotNull()
    back = placed.withColumns({"node_id": F.when(stays, F.col("was_node")).otherwise(F.col("node_id")), "centroid_id": F.coalesce("centroid_id", "was")})
    return move_vector(rest.having(points=rest.points.unionByName(back.select(*POINT_COLUMNS))))


def steal_plan(state: State, namespace: str, source: str, target: str, limit: int) -> DataFrame:
    """(centroid_id, n_points, before): the source's centroids that go to the target. Empty ones are left out; the rest,
    nearest to the target's vector first, go whole until at least ``limit`` points have gone."""
    theirs = state.sizes().where((F.col("namespace") == namespace) & (F.col("node_id") == source) & (F.col("n_points") > 0))
    nodes = state.nodes().where(F.col("namespace") == namespace)
    # a target without the namespace begins at the source's vector
    own = nodes.where(F.col("node_id").isin(source, target)).orderBy((F.col("node_id") == target).desc()).limit(1).select(F.col("vec").alias("tvec"))
    scored = theirs.join(state.centroids.select(*CENTROID, "vec"), CENTROID).crossJoin(F.broadcast(own)).withColumn("score", cosine("vec", "tvec")).where(usable("score"))
    # counted up in 1,025 ranges of the score first, so that no task sorts all centroids of a node
    scored = written(scored.withColumn("part", F.floor((1 - F.col("score")) * 512).cast("int")).select("centroid_id", "ord", "n_points", "score", "part"), "steal")
    sums = scored.groupBy("part").agg(F.sum("n_points").alias("all"))
    base = F.broadcast(sums.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("base")))
    own = Window.partitionBy("part").orderBy(F.desc("score"), "ord", "centroid_id")
    before = (F.col("base") + F.sum("n_points").over(own) - F.col("n_points")).alias("before")
    return scored.join(base, "part").select("centroid_id", "n_points", before).where(F.col("before") < limit)


def steal_centroids(state: State, namespace: str, source: str, target: str, limit: int) -> State:
    """Move what ``steal_plan`` names; moved centroids come after the target's own, numbered by the points before them."""
    plan = steal_plan(state, namespace, source, target, limit)
    mine = (F.col("namespace") == namespace) & (F.col("node_id") == target)
    last = state.centroids.where(mine).agg(F.coalesce(F.max("centroid_id") + 1, F.lit(0)).alias("i"), F.coalesce(F.max("ord") + 1, F.lit(0)).alias("o"))
    moved = plan.crossJoin(F.broadcast(last)).select(F.lit(namespace).alias("namespace"), F.lit(source).alias("node_id"), "centroid_id", (F.col("before") + F.col("i")).alias("new_id"), (F.col("before") + F.col("o")).alias("new_ord"))
    moved = small(moved, "moved")

    def renamed(df: DataFrame) -> DataFrame:
        out = df.join(moved, CENTROID, "left")
        out = out.withColumn("node_id", F.when(F.col("new_id").isNotNull(), F.lit(target)).otherwise(F.col("node_id"))).withColumn("centroid_id", F.coalesce("new_id", "centroid_id"))
        return out.withColumn("ord", F.coalesce("new_ord", "ord")) if "ord" in df.columns else out

    return state.having(renamed(state.points), renamed(state.centroids))


def load_balance_plan(state: State) -> DataFrame:
    """(namespace, node_id, from_node, n_transfer): which node may pull points from which.

    With mean = points // holders (the nodes that hold the namespace) and margin = int(0.4 * mean), a node of at most
    mean - margin points, which may be one without the namespace, pulls (mean - points) // nodes // 3 from each holder, if
    that is more than 0 and the holder keeps at least mean + margin; a single holder needn't.
    """
    nodes = state.centroids.select("node_id").distinct()
    held = state.centroids.select(*MANAGER).distinct().groupBy("namespace").agg(F.count("*").alias("holders"))
    counts = state.centroids.select("namespace").distinct().crossJoin(small(nodes)).join(state.points.groupBy(*MANAGER).agg(F.count("*").alias("n")), MANAGER, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    every = counts.groupBy("namespace").agg(F.sum("n").alias("total"), F.count("*").alias("nodes")).join(held, "namespace")
    every = every.withColumn("mean", F.expr("total div holders")).withColumn("margin", F.floor(0.4 * F.col("mean")))
    low = counts.join(every, "namespace").where("n <= mean - margin").withColumn("n_transfer", F.expr("(mean - n) div nodes div 3")).where("n_transfer > 0")
    holding = state.centroids.select(*MANAGER).distinct()
    other = counts.join(holding, MANAGER, "left_semi").select("namespace", F.col("node_id").alias("from_node"), F.col("n").alias("other"))
    pairs = low.join(other, "namespace").where("from_node <> node_id AND (other - n_transfer >= mean + margin OR holders = 1)")
    return pairs.select("namespace", "node_id", "from_node", "n_transfer")
