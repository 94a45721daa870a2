"""Tables written to the folder that all executors share, and sizes measured as they are written."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: Tables of at most so many bytes (as rows hold them, not as files do) are broadcast.
BROADCAST_BYTES = 64 << 20
#: The same for sides of narrow rows, for which a driver holds some ten times their bytes while it builds what it broadcasts.
SIDE_BYTES = 4 << 20
_written: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Where it is unset, a session that runs in
    this process alone gets a folder of our own; on a cluster that is an error, since executors have disks of their own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="nearfield-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is removed when the driver ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends there, and lost executors cost nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bytes(value: Column, kind: DataType) -> Column:
    """About what a value takes in a row."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 16
    if isinstance(kind, StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, StructType, ArrayType)):
            inner = F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + _bytes(x, kind.elementType))
            return F.coalesce(inner, F.lit(0).cast("long")) + 16
        return F.greatest(F.coalesce(F.size(value), F.lit(0)), F.lit(0)).cast("long") * 8 + 16
    return F.lit(8).cast("long")


def measured(df: DataFrame, name: str) -> tuple[DataFrame, int, int]:
    """``written``, with the numbers of rows and bytes, which are counted as the rows are written."""
    seen = Observation()
    size = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0).cast("long"))
    table = written(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")), name)
    return table, seen.get["rows"], seen.get["bytes"]


def small(df: DataFrame, name: str = "small", limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` written, and marked for broadcast if it has at most ``limit`` bytes; what is above it runs once only."""
    table, _, size = measured(df, name)
    return F.broadcast(table) if size <= limit else table


def sided(side: DataFrame, size: int) -> DataFrame:
    """A side of a join with at most ``size`` bytes: marked for broadcast up to ``SIDE_BYTES``, else for a merge join. Spark
    itself would go by the files below, whatever they are compressed to and however many rows are made of one."""
    return F.broadcast(side) if size <= SIDE_BYTES else side.hint("merge")


def forget(*frames: DataFrame) -> None:
    """Remove the files of superseded ``written`` tables (their inputs must not be needed again)."""
    for df in frames:
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _remove(df.sparkSession, file)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark._sc._jsc is not None:
                _remove(spark, path)
        except Exception:  # the session is gone: nothing to do
            return
