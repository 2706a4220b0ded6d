"""Seeded sampling and splitting without leakage; orders come from a hash, so any engine gives the same ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def order_key(*columns: Column, seed: int = 42) -> Column:
    """A pseudo-random order of rows: the md5 of seed and key."""
    return F.md5(F.concat_ws("#", F.lit(str(seed)), *[c.cast("string") for c in columns]).cast("binary"))


def ranked(df: DataFrame, group: str, bucket: Column, order: list) -> DataFrame:
    """df with ``rank`` (from 1) and ``size`` of each row's group, by an order that ``bucket`` coarsens.

    A group may hold any share of the rows: rows are numbered inside their bucket, to which the rows in the group's
    earlier buckets are added. ``bucket`` must grow with the order and have a bounded number of values.
    """
    rows = df.withColumn("__b", bucket)
    counts = rows.groupBy(group, "__b").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(group)
    before = counts.withColumn("__before", F.sum("__n").over(w.orderBy("__b")) - F.col("__n")).withColumn("size", F.sum("__n").over(w)).withColumnsRenamed({group: "__g", "__b": "__gb"})
    joined = rows.join(before, rows[group].eqNullSafe(before["__g"]) & (rows["__b"] == before["__gb"]))
    n = F.row_number().over(Window.partitionBy(group, "__b").orderBy(*order))
    return joined.withColumn("rank", F.col("__before") + n).drop("__b", "__g", "__gb", "__n", "__before")


def stratified_groups(groups: DataFrame, group: str, stratum: str, train: float = 0.8, val: float = 0.1, tiny: int = 5, seed: int = 42) -> DataFrame:
    """(group, stratum, split): groups split within their stratum; strata of fewer than ``tiny`` groups go to train. Sizes round half to even."""
    rows = groups.select(F.col(group).alias("g"), F.coalesce(F.col(stratum), F.lit("uncoded")).alias("stratum")).where("g IS NOT NULL").groupBy("g").agg(F.min("stratum").alias("stratum"))
    rows = ranked(rows.withColumn("o", order_key(F.col("g"), seed=seed)), "stratum", F.substring("o", 1, 3), ["o", "g"])
    n_train, n_val = F.bround(F.col("size") * train), F.bround(F.col("size") * val)
    split = F.when((F.col("size") < tiny) | (F.col("rank") <= n_train), "train").when(F.col("rank") <= n_train + n_val, "val").otherwise("test")
    return rows.select(F.col("g").alias(group), F.col("stratum").alias(stratum), split.alias("split"))


def leakage(pairs: DataFrame, group: str = "cluster_id", key: str = "pair_id", trials: int = 20, test: float = 0.1, seed: int = 42) -> DataFrame:
    """(trial, test_pairs, leaked, share): shuffling pairs and not groups, how many test pairs have their group in train too.

    A pair is a test pair of a trial by its hash, so a trial needs no global order; groups with a train pair are an
    aggregate. Pairs without group never leak.
    """
    unit = lambda t: F.conv(F.substring(F.md5(F.concat_ws("#", F.lit(str(seed)), t.cast("string"), F.col("k").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    base = pairs.select(F.col(key).alias("k"), F.col(group).alias("g")).distinct()
    rows = base.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("is_test", unit(F.col("trial")) < test)
    per = rows.groupBy("trial", "g").agg(F.count_if("is_test").alias("t"), F.count_if(~F.col("is_test")).alias("r"))
    leaked = F.when(F.col("g").isNotNull() & (F.col("r") > 0), F.col("t")).otherwise(0)
    return per.groupBy("trial").agg(F.sum("t").alias("test_pairs"), F.sum(leaked).alias("leaked")).withColumn("share", F.round(F.col("leaked") / F.col("test_pairs"), 6))


def split_profile(pairs: DataFrame) -> DataFrame:
    """(split, question_type, category, pairs, groups): one row for each split, and for each of its question types and categories."""
    rows = pairs.select("split", F.coalesce("question_type", F.lit("uncoded")).alias("question_type"), F.coalesce("category", F.lit("uncoded")).alias("category"), "pair_id", "cluster_id")
    return rows.groupingSets([["split"], ["split", "question_type"], ["split", "category"]], "split", "question_type", "category").agg(F.count("*").alias("pairs"), F.count_distinct("cluster_id").alias("groups"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows' keys by the hash order; the limit is the feature, and each task keeps only n rows for it."""
    return df.select(F.col(key)).distinct().orderBy(order_key(F.col(key), seed=seed), key).limit(n)


def floor_assignment(items: DataFrame, key: str, group: str, seed: int = 42) -> DataFrame:
    """(key, other): for each item another item of its group, by one step around the group's hash order; an item alone in its group gets null."""
    rows = items.select(F.col(key).alias("k"), F.col(group).alias("g")).distinct().withColumn("o", order_key(F.col("k"), seed=seed))
    rows = ranked(rows, "g", F.substring("o", 1, 3), ["o", "k"])
    after = rows.select(F.col("g").alias("g2"), F.col("rank").alias("r2"), F.col("k").alias("other"))
    both = rows.join(after, rows["g"].eqNullSafe(after["g2"]) & (after["r2"] == F.col("rank") % F.col("size") + 1))
    return both.select(F.col("k").alias(key), F.when(F.col("other") != F.col("k"), F.col("other")).alias("other"))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with ``position`` from 0 in the order of the columns. The first column, a number, is cut at its quantiles, so that rows are numbered in parts of about equal size."""
    first = order[0]
    marks = rows.agg(F.percentile_approx(first, [i / 64 for i in range(1, 64)], 10_000).alias("marks"))
    bucket = F.size(F.filter(F.coalesce("marks", F.array()), lambda m: m < F.col(first)))
    numbered = rows.crossJoin(F.broadcast(marks)).withColumn("__all", F.lit(1)).withColumn("__at", bucket).drop("marks")
    return ranked(numbered, "__all", F.col("__at"), order).withColumn("position", F.col("rank") - 1).drop("rank", "size", "__all", "__at")


def inner_val(train: DataFrame, group: str, share: float = 0.05, seed: int = 42) -> DataFrame:
    """(group, inner_split): a share of the groups, at least one, for validation inside training; the rest stays in training."""
    groups = train.select(F.col(group)).where(F.col(group).isNotNull()).distinct().withColumn("o", order_key(F.col(group), seed=seed)).withColumn("all", F.lit(1))
    rows = ranked(groups, "all", F.substring("o", 1, 3), ["o", group])
    n = F.greatest(F.lit(1), F.floor(F.col("size") * share))
    return rows.select(group, F.when(F.col("rank") <= n, "val").otherwise("train").alias("inner_split"))


def uncovered(parts: list[DataFrame], universe: DataFrame) -> DataFrame:
    """(missing, extra): keys of the universe in none of the parts, and keys of the parts that the universe hasn't."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    count = lambda d: d.agg(F.count("*").alias("n"))
    a, b = count(universe.subtract(union)), count(union.subtract(universe))
    return a.select(F.col("n").alias("missing")).crossJoin(b.select(F.col("n").alias("extra")))
