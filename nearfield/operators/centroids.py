"""Operators of a centroid manager, for all managers of a state at once.

Every operator is a function from a state to a result and, where it changes something, a new state. ``now`` is explicit:
all reads leave expired points out. Changes are judged against the state as it was (all points of a batch meet the same
centroids), so results don't depend on the order in which tasks run.
"""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.ttl import expired
from nearfield.functions.vectors import cosine, norm, vec_mean
from nearfield.operators.blocks import LEAST, MOST, block_best
from nearfield.operators.search import nearest, usable
from nearfield.plans.state import CENTROID, MANAGER, POINT_COLUMNS, State
from nearfield.sources.scratch import small, written

Now = datetime | str | None


def live(points: DataFrame, now: Now = None) -> DataFrame:
    return points.where(~expired(now))


def move_vector(state: State) -> State:
    """Each centroid's vector becomes the mean of its points; without points, or with points of mixed length, it stays."""
    means = vec_mean(state.points, CENTROID, out="mean")
    moved = state.centroids.join(means, CENTROID, "left").withColumn("vec", F.coalesce("mean", "vec"))
    return state.having(centroids=moved)


def expire(state: State, now: Now = None) -> State:
    """Sweep expired points; emptied centroids stay."""
    return move_vector(state.having(points=live(state.points, now)))


def mem_trim(state: State, now: Now = None) -> State:
    """Sweep expired points and drop centroids that are empty."""
    state = expire(state, now)
    return state.having(centroids=state.centroids.join(state.points.select(*CENTROID).distinct(), CENTROID, "left_semi"))


# --- adding ---------------------------------------------------------------------------------------------------------


def assign(state: State, points: DataFrame, now: Now = None) -> DataFrame:
    """``points`` (namespace, node_id and all but centroid_id) with ``centroid_id`` of the nearest centroid of their
    manager, ``score``, and ``reason``: null, "expired", or "incomparable" where no centroid has their dimension (such
    points have no centroid). One line for each row, whatever ids repeat within or across managers."""
    rows = points.drop("centroid_id")
    best = nearest(rows, state.centroids.select(*MANAGER, "centroid_id", "vec"), 1, MANAGER, receiver="centroid_id", keep=True).drop("rank")
    late = expired(now)
    out = best.withColumn("reason", F.when(late, "expired").when(F.col("centroid_id").isNull(), "incomparable"))
    return out.withColumns({c: F.when(F.col("reason").isNull(), F.col(c)) for c in ("centroid_id", "score")})


def found_managers(state: State, points: DataFrame, now: Now = None) -> State:
    """Managers that ``points`` name and that have no centroid yet get one, at their first live point's vector."""
    first = live(points, now).groupBy(*MANAGER).agg(F.min_by("vec", F.struct("seq", "id")).alias("vec"))
    new = first.join(state.centroids.select(*MANAGER).distinct(), MANAGER, "left_anti")
    new = new.select(*MANAGER, F.lit(0).cast("long").alias("centroid_id"), F.lit(0).cast("long").alias("ord"), "vec")
    return state.having(centroids=state.centroids.unionByName(new))


def pieces(n: Column, threshold: int) -> Column:
    """How often a centroid of ``n`` points gives its ``threshold // 2`` oldest points away until it is below ``threshold``."""
    return F.greatest(F.lit(0).cast("long"), F.floor((n - threshold) / (threshold // 2)).cast("long") + 1)


def add_points(state: State, points: DataFrame, now: Now = None, threshold: int = 0) -> tuple[DataFrame, State]:
    """Add a batch: (report, new state). The report has each point's id, seq, centroid_id and the reason of a rejection.
    Centroids of at least ``threshold`` points (if over 1) then give their ``threshold // 2`` oldest points to a new
    centroid, again and again until they are below it."""
    state = found_managers(state, points, now)
    placed = assign(state, points, now)
    accepted = placed.where("reason IS NULL").select(*POINT_COLUMNS)
    new = move_vector(state.having(points=state.points.unionByName(accepted)))
    if threshold > 1:
        new = split_centroids(new, F.col("n_points") >= threshold, F.lit(threshold // 2), pieces(F.col("n_points"), threshold))
    return placed.select(*MANAGER, "id", "seq", "centroid_id", "reason"), new


# --- taking ---------------------------------------------------------------------------------------------------------


def _portions(candidates: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The round-robin share of ``n`` per manager: first points of all centroids in order, then second points, and so on."""
    own = Window.partitionBy(*CENTROID).orderBy(*order)
    turn = Window.partitionBy(*MANAGER).orderBy("pos", "ord", "centroid_id")
    first = candidates.withColumn("pos", F.row_number().over(own)).where(F.col("pos") <= max(0, n))
    return first.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= max(0, n))


def portions(state: State, n: int, now: Now = None) -> DataFrame:
    """(namespace, node_id, centroid_id, n_taken): how many points each centroid gives when its manager gives ``n``."""
    rows = live(state.points, now).join(small(state.centroids.select(*CENTROID, "ord")), CENTROID)
    return _portions(rows, [F.col("seq"), F.col("id")], n).groupBy(*CENTROID).agg(F.count("*").alias("n_taken"))


def drain_candidates(state: State, n: int, now: Now = None, ordered: bool = False) -> DataFrame:
    """The points that ``drain`` takes, with pos, turn and, if ``ordered``, their similarity to their centroid."""
    rows = live(state.points, now).join(small(state.centroids.select(*CENTROID, "ord", F.col("vec").alias("cvec"))), CENTROID)
    if not ordered:
        return _portions(rows.drop("cvec"), [F.col("seq"), F.col("id")], n)
    scored = rows.withColumn("score", cosine("vec", "cvec")).drop("cvec").where(usable("score"))
    return _portions(scored, [F.col("score"), F.col("id")], n)


def without(points: DataFrame, taken: DataFrame) -> DataFrame:
    return points.join(taken.select(*MANAGER, "id", "seq"), [*MANAGER, "id", "seq"], "left_anti").select(*POINT_COLUMNS)


def drain(state: State, n: int, now: Now = None, ordered: bool = False) -> tuple[DataFrame, State]:
    """Take at most ``n`` live points of each manager, the oldest (or, if ``ordered``, the least like their centroid) of
    each centroid first: (taken, new state). Nothing for n <= 0."""
    taken = written(drain_candidates(state, n, now, ordered).select(*POINT_COLUMNS), "drained")
    return taken, move_vector(state.having(points=without(live(state.points, now), taken)))


# --- looking up -----------------------------------------------------------------------------------------------------


def nearest_centroids(state: State, queries: DataFrame, n: int) -> DataFrame:
    """(query_id, namespace, node_id, centroid_id, crank, cscore): of each manager the ``n`` centroids nearest to each query."""
    return ranked_centroids(state, small(queries, "queries"), n)


def ranked_centroids(state: State, queries: DataFrame, n: int) -> DataFrame:
    """``nearest_centroids`` of queries that ``small`` has measured."""
    q = queries.select("query_id", "namespace", F.col("vec").alias("qvec")).withColumn("qn", norm("qvec"))
    pairs = state.centroids.select(*CENTROID, F.col("vec").alias("cvec")).join(q, "namespace")
    scored = pairs.withColumn("cscore", cosine("qvec", "cvec", F.col("qn"))).where(usable("cscore"))
    order = Window.partitionBy("query_id", *MANAGER).orderBy(F.desc("cscore"), "centroid_id")
    return scored.withColumn("crank", F.row_number().over(order)).where(F.col("crank") <= n).select("query_id", *CENTROID, "crank", "cscore")


def take_centroids(state: State, queries: DataFrame, n: int) -> tuple[DataFrame, State]:
    """The nearest centroids of each query, and the state without them and their points."""
    found = written(nearest_centroids(state, queries, n), "found")
    gone = found.select(*CENTROID).distinct()
    return found, state.having(state.points.join(gone, CENTROID, "left_anti"), state.centroids.join(gone, CENTROID, "left_anti"))


def plain(value: Column | str) -> Column:
    """Whether a vector has a score with every other such vector of its length."""
    n = norm(value)
    return F.coalesce((n > LEAST) & (n < MOST), F.lit(False))


def still_missing(state_points: DataFrame, probes: DataFrame, queries: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``probes`` whose ``ask`` is held to what of the query's k the earlier ones (per ``by``, in ``order``) are sure to leave
    missing; those that nothing is left for are dropped. Only points that are sure to score count, so the first k rows stay."""
    sizes = small(state_points.where(plain("vec")).groupBy(*CENTROID, F.size("vec").alias("__dim")).agg(F.count("*").alias("__n")), "sizes")
    q = queries.select("query_id", F.col("k").cast("long").alias("__k"), F.when(plain("vec"), F.size("vec")).alias("__dim"))
    counted = probes.join(q, "query_id").join(sizes, [*CENTROID, "__dim"], "left")
    sure = F.least(F.col("ask").cast("long"), F.coalesce("__n", F.lit(0)))
    before = F.sum(sure).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    left = counted.withColumn("ask", F.least(F.col("ask").cast("long"), F.col("__k") - F.coalesce(before, F.lit(0))))
    return left.where("ask > 0").select(*probes.columns)


def probe(points: DataFrame, probes: DataFrame, queries: DataFrame) -> DataFrame:
    """``probes`` (query_id, centroid, ask, ...) joined with the centroids' points: each query's ``ask`` best of each
    probed centroid, with score and prank. Payloads are left behind; they join by id at the end. ``queries`` are such as
    ``small`` has measured."""
    asked = written(probes.withColumnRenamed("ask", "k").where("k > 0"), "probes")
    scored = block_best(asked.join(queries.select("query_id", "vec"), "query_id"), points.select(*CENTROID, "id", "seq", "vec"), CENTROID)
    order = Window.partitionBy("query_id", *CENTROID).orderBy(F.desc("score"), "id")
    return scored.withColumn("prank", F.row_number().over(order)).where(F.col("prank") <= F.col("k")).drop("k")


def centroid_lookup(state: State, queries: DataFrame, now: Now = None) -> DataFrame:
    """(query_id, namespace, node_id, centroid_id, id, seq, prank, score): k nearest live points in every centroid."""
    queries = small(queries, "queries")
    probes = queries.select("query_id", "namespace", F.col("k").alias("ask")).join(state.centroids.select(*CENTROID), "namespace")
    return probe(live(state.points, now), probes, queries).select("query_id", *CENTROID, "id", "seq", "prank", "score")


def manager_lookup(state: State, queries: DataFrame, now: Now = None) -> DataFrame:
    """k points per query and manager: the nearest centroid's best first, then the next centroid's, over at most k
    centroids (empty ones use up a probe). Not a global top-k: results aren't ranked anew across centroids."""
    queries, alive = small(queries, "queries"), live(state.points, now)
    most = queries.agg(F.max("k")).first()[0] or 0
    ks = queries.select("query_id", "k")
    probes = ranked_centroids(state, queries, most).join(ks, "query_id").where("crank <= k").withColumnRenamed("k", "ask")
    found = probe(alive, still_missing(alive, probes, queries, ["query_id", *MANAGER], ["crank"]), queries).join(ks, "query_id")
    order = Window.partitionBy("query_id", *MANAGER).orderBy("crank", "prank")
    return found.withColumn("rank", F.row_number().over(order)).where("rank <= k").select("query_id", *CENTROID, "id", "seq", "crank", "prank", "rank", "score")


def lookup_and_drain(state: State, queries: DataFrame, now: Now = None) -> tuple[DataFrame, State]:
    """``manager_lookup``, and the state without the points found."""
    found = written(manager_lookup(state, queries, now), "found")
    return found, move_vector(state.having(points=without(live(state.points, now), found)))


# --- reshaping ------------------------------------------------------------------------------------------------------


def _size_between(low: int, high: int) -> Column:
    """Exclusive at both ends."""
    return (F.col("n_points") > low) & (F.col("n_points") < high)


#: A centroid's points are counted by age in ranges of about so many.
_AGE_ROWS = 100_000


def _aged(points: DataFrame) -> DataFrame:
    """``points`` with ``age``: 1 for a centroid's oldest point (by seq, then id), and so on. Counts per range of seq are
    added up first, so that no task sorts a whole large centroid."""
    spread = small(points.groupBy(*CENTROID).agg(F.min("seq").alias("__lo"), F.max("seq").alias("__hi"), F.ceil(F.count("*") / _AGE_ROWS).alias("__parts")), "ages")
    seq, lo, hi = (F.col(c).cast("double") for c in ("seq", "__lo", "__hi"))
    at = F.coalesce(F.floor((seq - lo) / (hi - lo + 1) * F.col("__parts")), F.lit(0)).alias("__part")
    dealt = points.join(spread, CENTROID).select(*points.columns, at)
    sums = dealt.groupBy(*CENTROID, "__part").agg(F.count("*").alias("__n"))
    base = small(sums.withColumn("__base", F.sum("__n").over(Window.partitionBy(*CENTROID).orderBy("__part")) - F.col("__n")).drop("__n"), "ages")
    own = F.row_number().over(Window.partitionBy(*CENTROID, "__part").orderBy("seq", "id"))
    return dealt.withColumn("__own", own).join(base, [*CENTROID, "__part"]).withColumn("age", F.col("__base") + F.col("__own")).drop("__part", "__own", "__base")


def split_centroids(state: State, predicate: Column, trim: Column | None = None, times: Column | None = None) -> State:
    """Centroids that satisfy ``predicate`` (over n_points) give their ``trim`` oldest points, half by default, to a new
    centroid, which comes after all others of its manager; and the next oldest to a further one, ``times`` (1) in all."""
    trim = F.floor(F.col("n_points") / 2) if trim is None else trim
    times = F.lit(1) if times is None else times
    last = state.centroids.groupBy(*MANAGER).agg(F.max("centroid_id").alias("last_id"), F.max("ord").alias("last_ord"))
    order = Window.partitionBy(*MANAGER).orderBy("ord", "centroid_id")  # over centroids
    halves = state.sizes().where(predicate).withColumns({"trim": trim.cast("long"), "times": times.cast("long")}).where("trim > 0 AND times > 0")
    halves = halves.withColumn("before", F.sum("times").over(order) - F.col("times")).join(last, MANAGER)
    halves = small(halves.select(*CENTROID, "trim", "times", (F.col("last_id") + F.col("before") + 1).alias("first_id"), (F.col("last_ord") + F.col("before") + 1).alias("first_ord")), "halves")
    aged = _aged(state.points.join(halves.select(*CENTROID), CENTROID, "left_semi")).join(halves, CENTROID)
    piece = F.floor((F.col("age") - 1) / F.col("trim"))
    cut = aged.withColumn("centroid_id", F.when(piece < F.col("times"), F.col("first_id") + piece).otherwise(F.col("centroid_id")))
    rest = state.points.join(halves.select(*CENTROID), CENTROID, "left_anti")
    new = halves.join(state.centroids.select(*CENTROID, "vec"), CENTROID).withColumn("k", F.explode(F.expr("sequence(0L, times - 1)")))
    new = new.select(*MANAGER, (F.col("first_id") + F.col("k")).alias("centroid_id"), (F.col("first_ord") + F.col("k")).alias("ord"), "vec")
    return move_vector(state.having(rest.select(*POINT_COLUMNS).unionByName(cut.select(*POINT_COLUMNS)), state.centroids.unionByName(new)))


def split_by_size(state: State, low: int, high: int) -> State:
    return split_centroids(state, _size_between(low, high))


_MERGED = "namespace string, node_id string, centroid_id bigint, into_id bigint"


def merge_plan(state: State, low: int, high: int) -> DataFrame:
    """(namespace, node_id, centroid_id, into_id) of the centroids that another absorbs, given sizes and vectors alone.

    In order, each centroid whose size is between the bounds (exclusive) absorbs the nearest others whole, whatever
    their size, until its own size leaves the range; nearness is to its vector as its turn begins. A manager's
    centroids, not its points, are one group here.
    """
    rows = state.sizes().join(state.centroids.select(*CENTROID, "vec"), CENTROID)

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ord", "centroid_id"])
        ids, n = pdf.centroid_id.to_numpy(), pdf.n_points.to_numpy().copy()
        own = [np.asarray(v, float) for v in pdf.vec]
        dims = np.array([len(v) for v in own])
        vecs, at = {}, np.zeros(len(own), int)  # a matrix per dimension, and each centroid's row in it
        for d in np.unique(dims):
            of = np.flatnonzero(dims == d)
            vecs[d], at[of] = np.array([own[j] for j in of]).reshape(len(of), d), np.arange(len(of))
        into = np.full(len(ids), -1)
        for i in range(len(ids)):
            if into[i] >= 0 or not low < n[i] < high:
                continue
            x = vecs[dims[i]]
            others = np.flatnonzero((dims == dims[i]) & (into < 0))
            others = others[others != i]
            norms, mine = np.linalg.norm(x[at[others]], axis=1), np.linalg.norm(x[at[i]])
            others, norms = others[(norms == 0) == (mine == 0)], norms[(norms == 0) == (mine == 0)]
            near = x[at[others]] @ x[at[i]] / norms / mine if mine else np.zeros(len(others))
            others, near = others[np.isfinite(near)], near[np.isfinite(near)]
            for j in others[np.lexsort((others, -near))]:
                total = n[i] + n[j]
                if n[j]:
                    x[at[i]] = (n[i] * x[at[i]] + n[j] * x[at[j]]) / total if n[i] else x[at[j]]
                n[i], n[j], into[j] = total, 0, i
                if not low < n[i] < high:
                    break
        final = np.where(into >= 0, into, np.arange(len(ids)))
        while (final[final] != final).any():
            final = final[final]
        gone = np.flatnonzero(into >= 0)
        return pd.DataFrame({"namespace": pdf.namespace.iloc[0], "node_id": pdf.node_id.iloc[0], "centroid_id": ids[gone], "into_id": ids[final[gone]]}).astype({"centroid_id": "int64", "into_id": "int64"})

    return rows.groupBy(*MANAGER).applyInPandas(greedy, _MERGED)


def merge_centroids(state: State, low: int, high: int) -> State:
    plan = small(merge_plan(state, low, high))
    points = state.points.join(plan, CENTROID, "left").withColumn("centroid_id", F.coalesce("into_id", "centroid_id"))
    return move_vector(state.having(points, state.centroids.join(plan, CENTROID, "left_anti")))


def distribute_internal(state: State, n: int, now: Now = None) -> State:
    """The ``n`` points of each manager that are least like their centroid go to the nearest centroid of the manager (their
    own included): one reassignment step. A point that none can take stays where it was."""
    taken, rest = drain(state, n, now, ordered=True)
    placed = assign(rest, taken.withColumn("was", F.col("centroid_id")), now)
    back = placed.withColumn("centroid_id", F.coalesce("centroid_id", "was"))
    return move_vector(rest.having(points=rest.points.unionByName(back.select(*POINT_COLUMNS))))


def distribute_to(state: State, receivers: State, n: int, now: Now = None) -> tuple[State, State]:
    """The ``n`` points of each manager of ``state`` that are least like their centroid go to the nearest centroid of
    ``receivers`` in their namespace, whatever its node: (state, receivers) afterwards. A point that none can take stays
    where it was."""
    taken, rest = drain(state, n, now, ordered=True)
    to = receivers.centroids.select("namespace", F.struct("node_id", "centroid_id").alias("receiver_id"), "vec")
    placed = written(nearest(taken, to, 1, ["namespace"], keep=True), "placed")
    moved = placed.where("receiver_id IS NOT NULL").withColumns({"node_id": F.col("receiver_id.node_id"), "centroid_id": F.col("receiver_id.centroid_id")})
    stay = placed.where("receiver_id IS NULL")
    after = receivers.having(points=receivers.points.unionByName(moved.select(*POINT_COLUMNS)))
    return move_vector(rest.having(points=rest.points.unionByName(stay.select(*POINT_COLUMNS)))), move_vector(after)
