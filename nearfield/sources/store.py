"""A durable store: a log of small versions over Parquet snapshots of a state, and put and query over them."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions.vectors import add, divide, scale, subtract, vec_mean
from nearfield.operators.centroids import Now, assign, found_managers, pieces, split_centroids
from nearfield.operators.routing import get_points, route_points
from nearfield.plans.maintenance import Config, maintenance_cycle
from nearfield.plans.state import CENTROID, CENTROID_COLUMNS, MANAGER, POINT_COLUMNS, POINTS, State
from nearfield.sources.scratch import written

#: A centroid with its running count and sum of points, and whether it was dropped.
_KEPT = "namespace string, node_id string, centroid_id bigint, ord bigint, vec array<double>, n bigint, total array<double>"
_KEY = [*MANAGER, "id", "seq"]


class NamespaceNotFound(LookupError):
    """No node holds the namespace."""


class WriteConflict(RuntimeError):
    """Another writer has committed the version that this one was about to commit; nothing of this one's is seen."""


@dataclass
class Store:
    """Versions below ``path``: ``v=N/_COMPLETE`` names what version N adds to the one before it, files in ``data``.

    A version is a base (a whole snapshot) or a delta: points added, keys of points gone (which count for earlier
    versions' points only), and centroids that changed, with running counts and sums. So a put or a draining query reads
    centroids and writes in proportion to its batch. After ``compact_after`` deltas a base follows.

    The marker is written elsewhere and renamed, which fails if it exists: of two writers one commits and the other gets a
    WriteConflict. Readers see whole versions only.
    """

    spark: SparkSession
    path: str
    config: Config = Config()
    compact_after: int = 50

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    # --- the log ----------------------------------------------------------------------------------------------------

    def version(self) -> int:
        """The newest complete version; 0 for none."""
        fs, path = self._fs()
        root = path(self.path)
        if not fs.exists(root):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(root)]
        return max((int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit() and fs.exists(path(f"{self.path}/{n}/_COMPLETE"))), default=0)

    def _manifest(self, version: int) -> dict:
        fs, path = self._fs()
        stream = fs.open(path(f"{self.path}/v={version}/_COMPLETE"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _chain(self, version: int) -> list[tuple[int, dict]]:
        """The versions that make up ``version``, from its base on."""
        out: list[tuple[int, dict]] = []
        while version and not (out and out[-1][1]["base"]):
            out.append((version, self._manifest(version)))
            version -= 1
        return out[::-1]

    def _publish(self, version: int, manifest: dict) -> None:
        fs, path = self._fs()
        jvm, to = self.spark._jvm, path(f"{self.path}/v={version}/_COMPLETE")
        at = path(f"{self.path}/data/{manifest['data']}/_manifest")
        fs.mkdirs(to.getParent())
        out = fs.create(at, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        names = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            names.rename(at, to, self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception as e:
            if "AlreadyExists" in str(e) or fs.exists(to):
                raise WriteConflict(f"version {version} of {self.path} was committed meanwhile") from e
            raise

    # --- reading ----------------------------------------------------------------------------------------------------

    def _read(self, chain: list[tuple[int, dict]], name: str, schema: str) -> DataFrame:
        """What the versions of a chain have under ``name``, with the version ``v``."""
        out = self.spark.createDataFrame([], f"{schema}, v int")
        for v, manifest in chain:
            if name in manifest["has"]:
                out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.path}/data/{manifest['data']}/{name}").withColumn("v", F.lit(v)))
        return out

    def _centroids(self, chain: list[tuple[int, dict]]) -> DataFrame:
        """Each centroid as last written, with count and sum, unless it was dropped."""
        rows = self._read(chain, "centroids", f"{_KEPT}, dropped boolean")
        newest = F.row_number().over(Window.partitionBy(*CENTROID).orderBy(F.desc("v")))
        return rows.withColumn("k", newest).where("k = 1 AND NOT dropped").drop("k", "v", "dropped")

    def _points(self, chain: list[tuple[int, dict]]) -> DataFrame:
        points = self._read(chain, "points", POINTS)
        if not any("gone" in m["has"] for _, m in chain):
            return points.drop("v")
        gone = self._read(chain, "gone", "namespace string, node_id string, id bigint, seq bigint").groupBy(*_KEY).agg(F.max("v").alias("until"))
        return points.join(gone, _KEY, "left").where("until IS NULL OR v >= until").select(*POINT_COLUMNS)

    def load(self, version: int | None = None) -> State:
        """A version of the state, the newest by default; empty if there is none."""
        version = self.version() if version is None else version
        if not version:
            return State.empty(self.spark)
        chain = self._chain(version)
        return State(self._points(chain), self._centroids(chain).select(*CENTROID_COLUMNS))

    # --- writing ----------------------------------------------------------------------------------------------------

    def _write(self, base: int, whole: bool, tables: dict[str, DataFrame], streams: dict | None = None) -> None:
        """Write the version after ``base``."""
        manifest = {"data": uuid.uuid4().hex, "base": whole, "has": sorted(tables), "streams": (self._manifest(base)["streams"] if base else {}) | (streams or {})}
        for name, table in tables.items():
            table.write.partitionBy(*MANAGER).parquet(f"{self.path}/data/{manifest['data']}/{name}")
        self._publish(base + 1, manifest)

    def commit(self, state: State, base: int | None = None) -> State:
        """Write the whole of ``state`` as the version after ``base`` (the newest) and give it as read back: lineage ends
        here, and earlier deltas are compacted."""
        means = vec_mean(state.points, CENTROID, out="mean")
        counts = state.points.groupBy(*CENTROID).agg(F.count("*").alias("n"))
        kept = state.centroids.join(counts, CENTROID, "left").join(means, CENTROID, "left")
        kept = kept.select(*CENTROID_COLUMNS, F.coalesce("n", F.lit(0)).alias("n"), scale("mean", F.col("n")).alias("total"), F.lit(False).alias("dropped"))
        self._write(self.version() if base is None else base, True, {"points": state.points, "centroids": kept})
        return self.load()

    def _moved(self, centroids: DataFrame, points: DataFrame, sign: int) -> DataFrame:
        """Those of ``centroids`` that ``points`` came to (sign 1) or left (-1), by running counts and sums."""
        batch = vec_mean(points, CENTROID, out="mean").join(points.groupBy(*CENTROID).agg(F.count("*").alias("m")), CENTROID)
        both = centroids.join(batch, CENTROID).withColumn("part", scale("mean", F.col("m")))
        n, change = F.col("n") + sign * F.col("m"), add("total", "part") if sign > 0 else subtract("total", "part")
        both = both.withColumns({"total": F.when(n <= 0, F.lit(None)).when(F.col("n") == 0, F.col("part")).otherwise(change), "n": F.greatest(n, F.lit(0))})
        vec = F.when(F.col("n") > 0, F.coalesce(divide("total", F.col("n")), F.col("vec"))).otherwise(F.col("vec"))
        return both.withColumn("vec", vec).select(*CENTROID_COLUMNS, "n", "total", F.lit(False).alias("dropped"))

    def _compact(self) -> None:
        if len(self._chain(self.version())) > self.compact_after:
            self.commit(self.load())

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the newest versions and those that they are made of."""
        fs, path = self._fs()
        newest = self.version()
        oldest = self._chain(max(1, newest + 1 - keep))[0][0] if newest else 1
        for f in fs.listStatus(path(self.path)):
            name = f.getPath().getName()
            v = int(name[2:]) if name.startswith("v=") and name[2:].isdigit() else oldest
            if v < oldest:
                if fs.exists(path(f"{self.path}/{name}/_COMPLETE")):
                    fs.delete(path(f"{self.path}/data/{self._manifest(v)['data']}"), True)
                fs.delete(f.getPath(), True)

    # --- put and query ----------------------------------------------------------------------------------------------

    def put(self, points: DataFrame, route: str = "fast", now: Now = None, seed: int = 0, stream: str | None = None, number: int = 0) -> DataFrame | None:
        """Add points (namespace, id, seq, vec, payload, expires, expire_enabled) and commit. Gives the report of what was
        accepted and what was rejected, and why. In an empty store a point goes to node "n0".

        Batches of a ``stream`` are numbered upwards; one that was committed before is left out (None). Centroids that
        reach the config's threshold are split in a version of their own.
        """
        base = self.version()
        chain = self._chain(base)
        if stream is not None and chain and chain[-1][1]["streams"].get(stream, -1) >= number:
            return None
        kept = written(self._centroids(chain), "centroids")
        state = State(self.spark.createDataFrame([], POINTS), kept.select(*CENTROID_COLUMNS))
        routed = route_points(state, points, route, seed) if kept.limit(1).count() else points.withColumn("node_id", F.lit("n0"))
        routed = written(routed, "routed")
        founded = found_managers(state, routed, now).centroids.join(kept.select(*CENTROID), CENTROID, "left_anti")
        every = written(kept.unionByName(founded.select(*CENTROID_COLUMNS, F.lit(0).cast("long").alias("n"), F.lit(None).cast("array<double>").alias("total"))), "centroids")
        placed = written(assign(state.having(centroids=every), routed, now), "placed")
        accepted = placed.where("reason IS NULL").select(*POINT_COLUMNS)
        moved = written(self._moved(every, accepted, 1), "moved")
        self._write(base, not base, {"points": accepted, "centroids": moved}, {stream: number} if stream is not None else None)
        if self.config.split_threshold > 1:
            self._split(moved.where(F.col("n") >= self.config.split_threshold).select(*CENTROID))
        self._compact()
        return placed.select(*MANAGER, "id", "seq", "centroid_id", "reason")

    def _split(self, large: DataFrame) -> None:
        """Split the centroids named; only their points are read."""
        large = written(large, "large")
        if not large.limit(1).count():
            return
        base = self.version()
        state = self.load(base)
        own = State(written(state.points.join(F.broadcast(large), CENTROID, "left_semi"), "split"), written(state.centroids, "centroids"))
        t = self.config.split_threshold
        after = split_centroids(own, F.col("n_points") >= t, F.lit(t // 2), pieces(F.col("n_points"), t))
        points = written(after.points, "split")
        changed = points.join(own.points.select(*CENTROID, "id", "seq"), [*CENTROID, "id", "seq"], "left_anti")
        counts = points.groupBy(*CENTROID).agg(F.count("*").alias("n"))
        rows = after.centroids.join(counts, CENTROID).select(*CENTROID_COLUMNS, "n", scale("vec", F.col("n")).alias("total"), F.lit(False).alias("dropped"))
        self._write(base, False, {"points": changed, "gone": changed.select(*_KEY), "centroids": rows})

    def query(self, queries: DataFrame, route: str = "fast", now: Now = None, seed: int = 0) -> DataFrame:
        """Answers to queries (columns of QUERIES); what draining queries found is gone afterwards."""
        base = self.version()
        chain = self._chain(base)
        state = self.load(base)
        unknown = queries.join(state.centroids.select("namespace").distinct(), "namespace", "left_anti").limit(1).collect()
        if unknown:
            raise NamespaceNotFound(unknown[0].namespace)
        found = written(get_points(state, queries, route, now, seed), "found")
        taken = written(found.join(queries.where("drain").select("query_id"), "query_id", "left_semi").select(*_KEY).distinct(), "taken")
        if taken.limit(1).count():
            left = written(state.points.join(taken, _KEY, "left_semi").select(*POINT_COLUMNS), "left")
            self._write(base, False, {"gone": taken, "centroids": self._moved(self._centroids(chain), left, -1)})
            self._compact()
        return found

    def maintain(self, number: int, now: Now = None) -> State:
        """One maintenance pass, committed whole after each of its steps."""
        return maintenance_cycle(self.load(), self.config, number, now, settle=self.commit)
