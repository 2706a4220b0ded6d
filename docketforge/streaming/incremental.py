"""Incremental runs as Structured Streaming: resume, stateful de-duplication, windowed counts.

Each query drains what its source holds (availableNow) into a Parquet sink in the shared folder and returns the sink:
with a checkpoint kept by the caller the next run would take up where this one ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketforge.operators.splitting import ranked
from docketforge.session import scratch
from docketforge.sources.tables import table


#: How late an event may come; the state holds no window that ended longer before the latest event.
LATE = "2 days"


class Aborted(RuntimeError):
    """A guard ended the run."""


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files; a single file is a folder's only one."""
    static = table(spark, sf_dir, name)
    files = static.inputFiles()
    folder = files[0].rsplit("/", 1)[0]
    reader = spark.readStream.schema(static.schema)
    return reader.parquet(folder) if folder.endswith(".parquet") else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def drain(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None, name: str = "stream", checkpoint: str | None = None) -> str:
    """Runs the stream over all there is and returns the folder of its sink. ``each`` takes the place of the plain Parquet sink."""
    base = scratch(stream.sparkSession, name)
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{base}/checkpoint")
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").start(f"{base}/out")
    query.awaitTermination()
    return f"{base}/out"


def resumed(stream: DataFrame, done: DataFrame, keys: list[str], name: str = "resume") -> DataFrame:
    """Rows of the stream whose keys aren't among ``done``, by an anti-join of the stream with what is finished."""
    path = drain(stream.join(done.select(*keys).distinct().withColumn("__done", F.lit(True)), keys, "left").where("__done IS NULL").drop("__done"), name=name)
    return stream.sparkSession.read.parquet(path)


def first_of_key(stream: DataFrame, key: str, time: str, late: str = "30 days", name: str = "dedup") -> DataFrame:
    """One row for each key within the watermark; state older than ``late`` is dropped."""
    path = drain(stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key]), name=name)
    return stream.sparkSession.read.parquet(path)


def staged(stream: DataFrame, keys: list[str], name: str = "staged") -> DataFrame:
    """The landing table of a stream, a row for each key: every batch appends what the table hasn't got, so batches that are run again change nothing."""
    spark, path = stream.sparkSession, f"{scratch(stream.sparkSession, name)}/table"

    def upsert(batch: DataFrame, epoch: int) -> None:
        new = batch.dropDuplicates(keys)
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            new = new.join(spark.read.schema(batch.schema).parquet(path).select(*keys), keys, "left_anti")
        new.write.mode("append").parquet(path)

    drain(stream, each=upsert, name=f"{name}-run")
    return spark.read.schema(stream.schema).parquet(path)


def guarded(stream: DataFrame, empty: Column, group: str, order: list[str], most: int, name: str = "guard") -> tuple[DataFrame, bool]:
    """(what was written, whether the run was ended): batches are written until one has ``most`` rows in a row for which ``empty`` holds.

    Rows are in the order of ``order`` inside their group, whose first column is a time; that batch is still written.
    """
    out = f"{scratch(stream.sparkSession, name)}/out"
    ended = []

    def each(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("append").parquet(out)
        hour = F.date_trunc("hour", order[0])
        rows = ranked(batch.withColumn("__e", empty), group, hour, order).withColumnRenamed("rank", "__r").drop("size").where("__e")
        runs = ranked(rows, group, hour, order).groupBy(group, (F.col("__r") - F.col("rank")).alias("g")).agg(F.count("*").alias("n"))
        longest = runs.agg(F.max("n")).first()[0] or 0
        if longest >= most:
            ended.append(epoch)
            raise Aborted(f"{longest} empty rows in a row")

    try:
        drain(stream, each=each, name=f"{name}-run")
    except Exception:
        if not ended:
            raise
    return stream.sparkSession.read.schema(stream.schema).parquet(out), bool(ended)


def safety_valve(rows: DataFrame, wanted: int, times: int = 6) -> DataFrame:
    """At most ``times`` rows for each of ``wanted`` keys; the limit is the feature."""
    return rows.limit(times * wanted)


def resumed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "pair_records").where("load_id < 3").select("cluster_id", "chunk_index")
    rows = stream_of(spark, sf_dir, "pair_records").select("pair_id", "cluster_id", "chunk_index")
    return resumed(rows, done, ["cluster_id", "chunk_index"])


def deduplicated_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream_of(spark, sf_dir, "clusters").select("cluster_id", F.col("ingested_at").cast("timestamp").alias("ingested_at"))
    return first_of_key(rows, "cluster_id", "ingested_at").select("cluster_id")


def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type. A window's state is dropped once the watermark has passed it; its last count is the one that stands."""
    rows = stream_of(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type").withWatermark("ts", LATE)
    counts = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    out = scratch(spark, "event-windows")

    def upsert(batch: DataFrame, epoch: int) -> None:
        batch.select(F.col("w.start").alias("window_start"), "event_type", "n", F.lit(epoch).alias("epoch")).write.mode("append").parquet(out)

    drain(counts, mode="update", each=upsert, name="event-state")
    latest = spark.read.parquet(out).groupBy("window_start", "event_type").agg(F.max_by("n", "epoch").alias("n"))
    return latest.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def staged_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cluster_id, opinions, words): opinions landed from their stream, joined with the clusters' metadata."""
    rows = stream_of(spark, sf_dir, "sub_opinions").select("cluster_id", "opinion_id", "word_count")
    landed = staged(rows, ["cluster_id", "opinion_id"])
    known = table(spark, sf_dir, "clusters").select("cluster_id").distinct()
    return landed.join(known, "cluster_id").groupBy("cluster_id").agg(F.count("*").alias("opinions"), F.sum("word_count").alias("words"))


def guarded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rows, aborted): the pairs written before three empty answers in a row end the run."""
    rows = stream_of(spark, sf_dir, "pair_records").select("pair_id", "load_id", "loaded_at", "answer")
    written, aborted = guarded(rows, F.trim(F.coalesce("answer", F.lit(""))) == "", "load_id", ["loaded_at", "pair_id"], 3)
    return written.agg(F.count("*").alias("rows")).withColumn("aborted", F.lit(aborted))
