"""Tolerant readers and sinks of the exchange formats, and the keyed loads over them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BROKEN = "_broken"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType, strict: bool = False) -> DataFrame:
    """One record a line. Blank and malformed lines are left out, or fail the read if ``strict``; unknown fields are dropped, missing ones null."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    # Read as text first: the reader then needs no second pass to know which lines are broken.
    wide = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}).alias("r"))
    return rows.where(F.col("r").isNotNull() & F.col(f"r.{BROKEN}").isNull()).select(*[F.col(f"r.`{f.name}`") for f in schema.fields])


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """As read_jsonl(), empty where there is no such file."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return read_jsonl(spark, path, schema) if there else spark.createDataFrame([], schema)


def read_authority_csv(spark: SparkSession, path: str, needed: tuple[str, ...] = ("caseId", "caseName", "usCite", "issueArea"), years: tuple[int, int] | None = None, positions: bool = False) -> DataFrame:
    """The authority table, all strings, Latin-1. Missing columns raise; ``years`` keeps decisions dated in that range; ``positions`` adds __position, a row's place in the file."""
    rows = spark.read.csv(path, header=True, encoding="ISO-8859-1", multiLine=False, escape='"')
    missing = [c for c in needed if c not in rows.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}; it has {rows.columns}")
    if years:
        year = F.regexp_extract(F.coalesce("dateDecision", F.lit("")), "/([0-9]{4})$", 1)
        rows = rows.where((year != "") & year.try_cast("int").between(*years))
    return rows.withColumn("__position", position()) if positions else rows


def read_parts(spark: SparkSession, paths: list[str], columns: list[str] | None = None) -> DataFrame:
    """Parquet parts with schemas that may differ, by name; only ``columns`` are read."""
    rows = spark.read.option("mergeSchema", "true").parquet(*paths)
    return rows.select(*columns) if columns else rows


def part_paths(base: str, n: int = 28, width: int = 5) -> list[str]:
    return [f"{base}/part-{i:0{width}d}.parquet" for i in range(n)]


def one_of_key(df: DataFrame, key: str, position: str, last: bool = False) -> DataFrame:
    """The first (or last) row of each key by its place in the input; rows with a null or blank key are left out."""
    order = F.col(position).desc() if last else F.col(position).asc()
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.where(F.trim(F.col(key).cast("string")) != "").withColumn("__n", n).where("__n = 1").drop("__n")


def by_id(rows: DataFrame, key: str = "caseId") -> DataFrame:
    """The last row of each trimmed key in the file; blank keys are left out. rows: with __position."""
    return one_of_key(rows.withColumn(key, F.trim(key)), key, "__position", last=True).drop("__position")


def require_columns(df: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    """df, if it has the columns and any row."""
    missing = [c for c in needed if c not in df.columns]
    if missing or df.isEmpty():
        raise ValueError(f"missing columns {missing}" if missing else "no rows")
    return df


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_splits(df: DataFrame, path: str, column: str = "split") -> None:
    """One folder for each split."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def write_report(df: DataFrame, path: str, most: int = 10_000) -> None:
    """A small result as one JSON document, an array of objects with indents. More than ``most`` rows are refused: a report isn't an export."""
    rows = [json.loads(r) for (r,) in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a report holds at most {most} rows")
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(json.dumps(rows, indent=2, ensure_ascii=False).encode()))
    finally:
        out.close()


def read_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def append_missing(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose keys the JSON table at path doesn't have yet; a run that was cut short is taken up by running it again."""
    spark = df.sparkSession
    done = read_optional(spark, path, df.select(*keys).schema).distinct()
    df.join(done, keys, "left_anti").write.mode("append").option("ignoreNullFields", "false").json(path)


def write_splits_with_report(df: DataFrame, path: str, column: str = "split", group: str = "cluster_id") -> None:
    """One folder of JSON lines for each split below ``path``/data, and the splits' sizes as ``path``/report.json."""
    df.write.mode("overwrite").partitionBy(column).option("ignoreNullFields", "false").json(f"{path}/data")
    write_report(df.groupBy(column).agg(F.count("*").alias("pairs"), F.count_distinct(group).alias("groups")), f"{path}/report.json")


def position() -> F.Column:
    """Where a row stands in its files; rows of one file keep their order."""
    return F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def targets(authority: DataFrame, years: tuple[int, int]) -> DataFrame:
    """(caseid, us_cite, year, area): authority rows decided in the years that have a citation, in one notation, ordered by year and citation as text."""
    cite = F.regexp_replace(F.coalesce("usCite", F.lit("")), r"U\. S\.", "U.S.")
    pattern = r"([0-9]+) *U\.?S\.? *([0-9]+)"
    year = F.regexp_extract(F.coalesce("dateDecision", F.lit("")), "/([0-9]{4})$", 1)
    rows = authority.where((year != "") & cite.rlike(pattern)).select(
        F.col("caseId").alias("caseid"), F.concat(F.regexp_extract(cite, pattern, 1), F.lit(" U.S. "), F.regexp_extract(cite, pattern, 2)).alias("us_cite"), year.try_cast("int").alias("year"), F.trim("issueArea").alias("area")
    )
    return rows.where(F.col("year").between(*years)).orderBy("year", "us_cite")


def category_index(rows: DataFrame, key: str, position: str) -> DataFrame:
    """(key, category): each key's last category that isn't empty, ``category`` before ``scdb_category``."""
    filled = [F.nullif(F.col(c), F.lit("")) for c in ("category", "scdb_category") if c in rows.columns]
    return rows.select(F.col(key), F.col(position).alias("__p"), F.coalesce(*filled).alias("category")).where(F.col(key).isNotNull() & F.col("category").isNotNull()).groupBy(key).agg(F.max_by("category", F.struct("__p", "category")).alias("category"))


def probe(df: DataFrame) -> DataFrame:
    """(position, column_name, column_type) of a table's columns, without reading its rows."""
    rows = [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, column_type string")


def top_groups(df: DataFrame, columns: list[str], k: int = 15) -> DataFrame:
    """The k most frequent combinations of the columns with their number ``n``; of equal numbers the first in the columns' order, nulls first."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *[F.asc_nulls_first(c) for c in columns]).limit(k)


def rewrite(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Replaces the Parquet table at path by df, which may read it: df is written beside it, the first table is kept once as .bak.

    If a run ends between its two renames the table lies at .old; the next call, or restore(), puts it back.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    new, old, bak, now = (hadoop.Path(path + end) for end in (".new", ".old", ".bak", ""))
    fs = now.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    restore(spark, path)
    df.write.mode("overwrite").parquet(f"{path}.new")
    fs.rename(now, old)
    if not fs.rename(new, now):
        fs.rename(old, now)
        raise OSError(f"{path} couldn't be replaced")
    if fs.exists(bak):
        fs.delete(old, True)
    else:
        fs.rename(old, bak)


def restore(spark: SparkSession, path: str) -> bool:
    """Puts the table back that an interrupted rewrite() left aside; whether there was one."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    old, now = hadoop.Path(f"{path}.old"), hadoop.Path(path)
    fs = now.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(now) or not fs.exists(old):
        return False
    return fs.rename(old, now)
