"""Evaluation of systems: overlap measures, floors, bootstrap intervals, paired comparisons, diagnostics."""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketforge.functions import text as T
from docketforge.functions.udfs import overlap_scores


def rouge1(rows: DataFrame, key: str, reference: str, prediction: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, precision, recall, f1) of unstemmed words, by multiset intersection inside each row; zeros where either has none."""
    tokens = lambda c: F.regexp_extract_all(F.lower(T.blank(F.col(c))), F.lit("[a-z0-9]+"), F.lit(0))
    r = rows.select(F.col(key), *keep, tokens(reference).alias("a"), tokens(prediction).alias("b"))
    count = lambda arr, w: F.size(F.filter(arr, lambda x: x == w))
    common = F.aggregate(F.array_intersect("a", "b"), F.lit(0), lambda n, w: n + F.least(count(F.col("a"), w), count(F.col("b"), w)))
    r = r.withColumn("c", common)
    p, q = F.when(F.size("b") > 0, F.col("c") / F.size("b")).otherwise(F.lit(0.0)), F.when(F.size("a") > 0, F.col("c") / F.size("a")).otherwise(F.lit(0.0))
    return r.select(key, *keep, F.round(p, 6).alias("precision"), F.round(q, 6).alias("recall"), F.round(F.when(F.col("c") > 0, 2 * p * q / (p + q)).otherwise(F.lit(0.0)), 6).alias("f1"))


def scored(rows: DataFrame, key: str, reference: str, prediction: str) -> DataFrame:
    """(key, rouge1_p, rouge1_r, rouge1_f, rougeL_f, meteor) with stems; nulls count as empty texts."""
    return rows.select(F.col(key), overlap_scores(T.blank(F.col(reference)), T.blank(F.col(prediction))).alias("s")).select(key, "s.*")


def diagnostics(rows: DataFrame, system: str, reference: str, prediction: str) -> DataFrame:
    """(system, n, empty, mean_words, length_ratio, duplicates, warnings) of each system's predictions."""
    by = rows.groupBy(F.col(system).alias("system")).agg(
        F.count("*").alias("n"), F.count_if(F.trim(T.blank(F.col(prediction))) == "").alias("empty"), F.avg(T.word_count(F.col(prediction))).alias("mean_words"), F.avg(T.word_count(F.col(reference))).alias("ref_words"),
        (F.count("*") - F.count_distinct(T.blank(F.col(prediction)))).alias("duplicates"),
    )
    ratio = F.col("mean_words") / F.col("ref_words")
    warnings = F.array_compact(F.array(F.when(ratio > 2.0, "verbose"), F.when(ratio < 0.5, "terse"), F.when(F.col("duplicates") > 0.1 * F.col("n"), "duplicates"), F.when(F.col("empty") > 0, "empty")))
    return by.select("system", "n", "empty", F.round("mean_words", 4).alias("mean_words"), F.round(ratio, 4).alias("length_ratio"), "duplicates", warnings.alias("warnings"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


#: Modulus of the hash family that draws the weights: products of two residues fit 64 bits in any engine.
PRIME = (1 << 31) - 1
#: Probability of at most 0, 1, ... 5 occurrences of a row in a resample: Poisson with mean 1.
STEPS = [float(x) for x in np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120)])]
RESAMPLES = 2000
#: Groups whose sums a task holds before it hands them on.
HELD = 500


def coefficients(resamples: int, seed: int) -> np.ndarray:
    """Three residues for each resample, from the md5 of seed and resample."""
    marks = [hashlib.md5(f"{seed}#{r}".encode()).hexdigest() for r in range(resamples)]
    return np.array([[int(m[i : i + 8], 16) % PRIME for i in (0, 8, 16)] for m in marks], np.int64).T


def resample_sums(rows: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(g, r, w, wv): for each group and resample the sum of the weights and of weight times value, from rows (g, k, v); r = -1 has each row once.

    A row's weight in a resample is Poisson(1), drawn by a polynomial of its key's hash modulo PRIME, so it needs no row
    number and no shuffle: tasks add up where the rows lie, and what is shuffled is one row for each group and resample.
    """
    a, b, c = coefficients(resamples, seed)
    cuts = np.array([int(np.ceil(s * PRIME)) for s in STEPS], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for g, sums in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([g] * (resamples + 1), pa.string()), pa.array(np.arange(-1, resamples), pa.int32()), pa.array(sums[0]), pa.array(sums[1])], names=["g", "r", "w", "wv"])
            held.clear()

        for batch in batches:
            groups, h, v = batch.column(0).to_pylist(), np.asarray(batch.column(1)), np.asarray(batch.column(2))
            names, of = np.unique(np.array(groups, object), return_inverse=True)
            for at in range(0, len(h), 256):
                x = h[at : at + 256, None]
                w = np.searchsorted(cuts, ((a * x + b) % PRIME * x + c) % PRIME, side="right").astype(float)
                part, values = of[at : at + 256], v[at : at + 256]
                for i in np.unique(part):
                    mine = part == i
                    sums = held.setdefault(names[i], np.zeros((2, resamples + 1)))
                    sums[0, 0] += mine.sum()
                    sums[1, 0] += values[mine].sum()
                    sums[0, 1:] += w[mine].sum(axis=0)
                    sums[1, 1:] += values[mine] @ w[mine]
            if len(held) > HELD:
                yield from told()
        yield from told()

    hashed = F.conv(F.substring(F.md5(F.col("k").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % PRIME
    given = rows.where("g IS NOT NULL AND v IS NOT NULL").select(F.col("g").cast("string").alias("g"), hashed.alias("h"), F.col("v").cast("double").alias("v"))
    return given.mapInArrow(run, "g string, r int, w double, wv double").groupBy("g", "r").agg(F.sum("w").alias("w"), F.sum("wv").alias("wv"))


def hash_bootstrap(rows: DataFrame, group: str, key: str, value: str, resamples: int = RESAMPLES, seed: int = 42) -> DataFrame:
    """(group, n, mean, low, high): percentile interval of the mean over resample_sums(). Null values and groups are left out; a group without values has no row."""
    sums = resample_sums(rows.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(value).alias("v")), resamples, seed)
    m = F.when((F.col("r") >= 0) & (F.col("w") > 0), F.col("wv") / F.col("w"))
    whole = lambda x: F.max(F.when(F.col("r") < 0, x))
    out = sums.groupBy("g").agg(whole(F.col("w")).cast("long").alias("n"), whole(F.col("wv") / F.col("w")).alias("mean"), F.percentile(m, F.lit(0.025)).alias("low"), F.percentile(m, F.lit(0.975)).alias("high"))
    return out.select(F.col("g").alias(group), "n", *[F.round(c, 4).alias(c) for c in ("mean", "low", "high")])


def aligned(rows: DataFrame, system: str, key: str, baseline: str) -> DataFrame:
    """(system, items, missing, extra, aligned): whether a system has exactly the baseline's items, the condition of a paired comparison."""
    keys = rows.select(F.col(system).alias("s"), F.col(key).alias("k")).groupBy("s", "k").agg(F.count("*").alias("n"))
    base = keys.where(F.col("s") == baseline).select("k", F.col("n").alias("m"))
    size = base.agg(F.count("*").alias("size"))
    per = keys.where(F.col("s") != baseline).join(base, "k", "left").groupBy("s").agg(F.count("*").alias("items"), F.count_if(F.col("m") == F.col("n")).alias("common"))
    out = per.crossJoin(F.broadcast(size)).select(F.col("s").alias(system), "items", (F.col("size") - F.col("common")).alias("missing"), (F.col("items") - F.col("common")).alias("extra"))
    return out.withColumn("aligned", (F.col("missing") == 0) & (F.col("extra") == 0))


def paired(rows: DataFrame, system: str, key: str, value: str, baseline: str, resamples: int = RESAMPLES, seed: int = 42) -> DataFrame:
    """(system, n, mean_diff, p, significant): each system against ``baseline`` over the items both have, by hash_bootstrap()'s weights on the differences.

    p is twice the smaller share of resamples on one side of 0; significant says that it is below 0.05.
    """
    base = rows.where(F.col(system) == baseline).select(F.col(key).alias("k"), F.col(value).alias("base"))
    diffs = rows.where(F.col(system) != baseline).select(F.col(system).alias("g"), F.col(key).alias("k"), F.col(value).alias("value")).join(base, "k").select("g", "k", (F.col("value") - F.col("base")).alias("v"))
    sums = resample_sums(diffs, resamples, seed).withColumn("m", F.when(F.col("w") > 0, F.col("wv") / F.col("w")))
    whole = lambda x: F.max(F.when(F.col("r") < 0, x))
    above = F.count_if((F.col("r") >= 0) & (F.col("m") > 0)) / F.count_if((F.col("r") >= 0) & F.col("m").isNotNull())
    out = sums.groupBy("g").agg(whole(F.col("w")).cast("long").alias("n"), whole(F.col("m")).alias("d"), above.alias("above"))
    p = F.round(2 * F.least(F.col("above"), 1 - F.col("above")), 4)
    return out.select(F.col("g").alias(system), "n", F.round("d", 4).alias("mean_diff"), p.alias("p"), (p < 0.05).alias("significant"))


def score_table(rows: DataFrame, system: str, key: str, metrics: list[str]) -> DataFrame:
    """(system, metric, n, mean, low, high) of every measure of every system, with hash_bootstrap()'s intervals."""
    tall = rows.select(F.col(key).alias("k"), F.col(system).alias("s"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x"))
    out = hash_bootstrap(tall.select("k", F.concat_ws("|", "x.metric", "s").alias("name"), "x.v"), "name", "k", "v")
    return out.select(F.regexp_extract("name", r"^[^|]*\|(.*)$", 1).alias(system), F.regexp_extract("name", r"^([^|]*)\|", 1).alias("metric"), "n", "mean", "low", "high")


def verdicts(scores: DataFrame, system: str) -> DataFrame:
    """(system, precision, recall, verbose) from score_table() with precision and recall: verbose if precision is below 0.6 of recall."""
    of = lambda m: F.max(F.when(F.col("metric") == m, F.col("mean")))
    by = scores.groupBy(system).agg(of("precision").alias("precision"), of("recall").alias("recall"))
    return by.withColumn("verbose", (F.col("recall") > 0) & (F.col("precision") / F.greatest("recall", F.lit(1e-9)) < 0.6))


def greedy_similarity(a: Column, b: Column, baseline: float = 0.0) -> Column:
    """(precision, recall, f) of two lists of token vectors: each vector with the one of the other list it is closest to, by cosine, shifted so that ``baseline`` is 0."""
    best = lambda xs, ys: F.aggregate(F.transform(xs, lambda x: F.array_max(F.transform(ys, lambda y: cosine(x, y)))), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    p, r = F.try_divide(best(b, a), F.size(b)), F.try_divide(best(a, b), F.size(a))
    scaled = lambda x: (x - baseline) / (1 - baseline)
    return F.struct(scaled(p).alias("precision"), scaled(r).alias("recall"), scaled(F.try_divide(2 * p * r, p + r)).alias("f"))


def group_means(rows: DataFrame, fields: list[str], value: str, key: str) -> DataFrame:
    """(field, level, n, mean, low, high): a measure by each field on its own, nulls as 'unknown', with hash_bootstrap()'s intervals."""
    tall = rows.select(F.col(key).alias("k"), F.col(value).alias("v"), F.explode(F.array(*[F.concat_ws("|", F.lit(f), F.coalesce(F.col(f), F.lit("unknown"))) for f in fields])).alias("name"))
    out = hash_bootstrap(tall, "name", "k", "v")
    return out.select(F.substring_index("name", "|", 1).alias("field"), F.regexp_extract("name", r"^[^|]*\|(.*)$", 1).alias("level"), "n", "mean", "low", "high")


def seed_spread(rows: DataFrame, system: str, seed: str, value: str) -> DataFrame:
    """(system, seeds, mean, sd): mean and sample deviation over the means of the seeds."""
    per = rows.groupBy(F.col(system).alias("system"), F.col(seed).alias("seed")).agg(F.avg(value).alias("m"))
    return per.groupBy("system").agg(F.count("*").alias("seeds"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_samp("m"), 6).alias("sd"))
