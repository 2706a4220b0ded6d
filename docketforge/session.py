"""Session set-up and the few places where lineage is cut."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Options a session gets when this package builds it itself; a session handed in keeps its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Small partitions may be costly ones: those of texts that a kernel reads aren't put together below this.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[*]", app: str = "docketforge", **options: str) -> SparkSession:
    """A session with DEFAULTS; ``options`` use ``__`` for the dots of an option name."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in options.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where it is unset a local session gets a temporary folder; on a cluster that is an error, as executors would write to
    folders of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="docketforge-")
        spark.conf.set("spark.checkpoint.dir", named)
        atexit.register(_remove, spark, named)
    return named.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone at exit
        pass


#: Tables and folders that were written to the shared folder and not released yet.
_WRITTEN: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own below shared_dir, removed by release() or when the driver's process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(release)
    _WRITTEN.append((spark, path))
    return path


def release() -> int:
    """Removes what scratch() and cut() have written so far; returns how many. Call it once a query's result has been stored: the tables behind it are gone then."""
    n = len(_WRITTEN)
    while _WRITTEN:
        _remove(*_WRITTEN.pop())
    return n


def cut(df: DataFrame, name: str = "cut", partition_by: list[str] | None = None) -> DataFrame:
    """Writes df as a Parquet table below shared_dir and reads it back: the lineage ends there.

    The table survives the loss of executors; release() removes it, or the end of the driver's process.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """df with the hint that its joins sort and merge, for tables that grow with the input.

    Sizes are estimated from compressed files, and exploded rows aren't counted: such a table can be taken for a small one
    and be broadcast, whole, through the driver.
    """
    return df.hint("merge")


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """df over at least ``per_core`` partitions a core, for stages whose cost is CPU and not bytes.

    A table that already has as many partitions is left as it is, so large inputs aren't shuffled.
    """
    want = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df.repartition(want) if df.rdd.getNumPartitions() < max(2, want // 2) else df
