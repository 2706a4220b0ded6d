"""Column-level data quality profile of a table that arrives in loads (problem 6).

Every non-null value is reduced to its shape: runs of capitals, small letters and digits as one sign each. Over the
distinct values of a column a set of expressions is induced by minimum description length: a shape becomes an
expression of the column if writing the expression once costs less than what its values then need no longer be spelled
out. Values of the other shapes are exceptions: rows that don't conform. Coverage by the expressions is compared
between loads, beside nulls, distinct values, ranges, declared rules and the values' distribution.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketforge.session import cut, merged

#: Names of a declared domain, at most: they are written into the plan.
MOST_NAMES = 10_000
#: Bits of a character that is spelled out, of a letter and a digit whose class is known, and of a run's length.
SPELLED, LETTER, DIGIT, RUN = 8.0, math.log2(26), math.log2(10), 4.0
BUCKETS = 64
#: Expressions of a column that a report shows.
SHOWN = 100


@dataclass(frozen=True)
class Rule:
    """A declared rule of a column: the condition of a valid value, and whether it bounds a range or names a domain."""

    valid: Column
    kind: str = "pattern"
    domain: tuple[str, ...] = ()


def shape_of(value: Column) -> Column:
    """Runs of small letters, capitals and digits as a, A and 9, whatever their number."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\p{Ll}+", "a"), r"\p{Lu}+", "A"), r"[0-9]+", "9")


def expression_of(shape: Column) -> Column:
    """The regular expression of a shape."""
    t = F.regexp_replace(shape, r"([^\w\s])", r"\\$1")
    for sign, run in (("9", "[0-9]+"), ("A", r"\\p{Lu}+"), ("a", r"\\p{Ll}+")):
        t = F.regexp_replace(t, sign, run)
    return t


def pays(shape: Column, n: Column, chars: Column, total: Column) -> Column:
    """Whether writing a shape's expression once costs fewer bits than its values then need no longer be spelled out.

    n: its distinct values, chars: their characters, total: the column's distinct values.
    """
    runs = F.length(F.regexp_replace(shape, "[^aA9]", ""))
    fixed = F.length(shape) - runs
    free = F.greatest(F.lit(0.0), chars - fixed * n)
    digits = F.length(F.regexp_replace(shape, "[^9]", "")) / F.greatest(F.lit(1), runs)
    branch = -F.log2(F.greatest(n, F.lit(0.5)) / F.greatest(total, F.lit(1.0)))
    described = free * (digits * DIGIT + (1 - digits) * LETTER) + n * (runs * RUN + branch)
    # The expression's length: a run takes 6 signs, another character itself and, unless it is a letter, digit or blank, a backslash.
    written = 6 * runs + fixed + F.length(F.regexp_replace(shape, r"[\w\s]", ""))
    return described + SPELLED * written + branch < SPELLED * chars + 2 * n * F.log2(1 + chars / F.greatest(n, F.lit(1.0)))


def shapes_by_load(df: DataFrame, load: str, columns: list[str]) -> DataFrame:
    """(load, i, shape, rows, values, chars, buckets): rows and distinct values of each shape of column number i."""
    text = [F.col(c).cast("string") for c in columns]
    one = lambda i: F.struct(F.lit(i).alias("i"), F.xxhash64(text[i]).alias("h"), shape_of(text[i]).alias("shape"), F.length(text[i]).alias("chars"), text[i].isNotNull().alias("there"))
    long = df.select(F.col(load).alias("load"), F.explode(F.array(*[one(i) for i in range(len(columns))])).alias("x")).select("load", "x.*").where("there")
    values = long.groupBy("load", "i", "shape", "h").agg(F.count("*").alias("n"), F.first("chars").alias("chars"))
    bucket = F.pmod("h", F.lit(BUCKETS)).cast("int")
    # Values of a bucket first, so that what follows is small whatever a column holds.
    part = values.groupBy("load", "i", "shape", bucket.alias("bucket")).agg(F.sum("n").alias("rows"), F.count("*").alias("values"), F.sum("chars").alias("chars"))
    return part


def expressions(part: DataFrame) -> DataFrame:
    """(i, shape, values): the shapes that pay as expressions of column number i, from shapes_by_load(). Every shape of every distinct value is tried."""
    by = part.groupBy("i", "shape").agg(F.sum("values").cast("double").alias("values"), F.sum("chars").cast("double").alias("chars"))
    total = by.groupBy("i").agg(F.sum("values").alias("total"))
    return by.join(total, "i").where(pays(F.col("shape"), F.col("values"), F.col("chars"), F.col("total"))).select("i", "shape", "values")


def profile(df: DataFrame, load: str, columns: list[str] | None = None, rules: dict[str, Rule] | None = None) -> DataFrame:
    """One row for each load and column: (load_id, column_name, n_rows, nulls, null_rate, distinct_values, min_value,
    max_value, invalid, invalid_rate, nonconforming, coverage, expressions, median, and what changed since the
    preceding load: null_rate_change, coverage_change, distribution_change, value_share_change, median_ratio).

    Columns default to all but the load. ``invalid`` counts non-null values that break the column's rule and is null
    without one. coverage is the share of non-null rows that an induced expression matches, distribution_change the total
    variation between the loads' hashed values, value_share_change the largest change in a domain value's share among
    valid values, median_ratio the change of the valid values' median of a range. Changes are null for the first load
    and where either load has no value. A null load is a load of its own, before all others. Repeated rows count as
    often as they occur; an empty table gives an empty result; a column without values has coverage null.
    """
    columns = columns or [c for c in df.columns if c != load]
    rules = rules or {}
    keyed = df.withColumn("__load", F.col(f"`{load}`"))
    text = {c: F.col(f"`{c}`").cast("string") for c in columns}
    aggs = [F.count("*").alias("n_rows")]
    for i, c in enumerate(columns):
        number = dict(df.dtypes)[c] in ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz") or dict(df.dtypes)[c].startswith("decimal")
        low = F.col(f"`{c}`") if number else text[c]
        aggs += [F.count(text[c]).alias(f"there_{i}"), F.min(low).cast("string").alias(f"low_{i}"), F.max(low).cast("string").alias(f"high_{i}")]
        if c in rules:
            there = text[c].isNotNull()
            aggs.append(F.count_if(there & ~F.coalesce(rules[c].valid, F.lit(False))).alias(f"bad_{i}"))
            if rules[c].kind == "range":
                aggs.append(F.percentile(F.when(rules[c].valid, F.col(f"`{c}`")), F.lit(0.5)).alias(f"median_{i}"))
            aggs += [F.count_if(rules[c].valid & (text[c] == v)).alias(f"value_{i}_{k}") for k, v in enumerate(rules[c].domain)]
    # One row a load from here on.
    wide = keyed.groupBy("__load").agg(*aggs)

    def one(i: int, c: str) -> Column:
        rule = rules.get(c)
        null = F.lit(None)
        good = (F.col(f"there_{i}") - F.col(f"bad_{i}")) if rule else null
        part = [F.when(good > 0, F.col(f"value_{i}_{k}") / good) for k in range(len(rule.domain))] if rule else []
        return F.struct(
            F.lit(i).alias("i"), F.lit(c).alias("column_name"), F.col(f"there_{i}").alias("there"), F.col(f"low_{i}").alias("min_value"), F.col(f"high_{i}").alias("max_value"),
            (F.col(f"bad_{i}") if rule else null).cast("long").alias("invalid"), (F.col(f"median_{i}") if rule and rule.kind == "range" else null).cast("double").alias("median"),
            (F.array(*part) if part else F.array().cast("array<double>")).alias("value_shares"),
        )

    tall = wide.select("__load", "n_rows", F.explode(F.array(*[one(i, c) for i, c in enumerate(columns)])).alias("c")).select(F.col("__load").alias("load"), "n_rows", "c.*")
    part = cut(shapes_by_load(keyed, "__load", columns), "profile-shapes")
    induced = cut(expressions(part), "profile-expressions")
    spark = df.sparkSession
    judged = part.join(merged(induced.select("i", "shape", F.lit(True).alias("known"))), ["i", "shape"], "left")
    shaped = judged.groupBy("load", "i").agg(F.sum("values").alias("distinct_values"), F.sum("rows").alias("present"), F.sum(F.when(F.col("known").isNull(), F.col("rows")).otherwise(0)).alias("nonconforming"))
    spread_over = judged.groupBy("load", "i", "bucket").agg(F.sum("rows").alias("rows")).groupBy("load", "i").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "rows"))).alias("histogram"))
    # The report shows a column's expressions from the one with the most values on, SHOWN at most; all of them count.
    place = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("values"), "shape"))
    shown = induced.withColumn("place", place).where(F.col("place") <= SHOWN).groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", expression_of(F.col("shape")).alias("e")))), lambda x: x["e"]).alias("expressions"))
    texts = spark.range(len(columns)).select(F.col("id").cast("int").alias("i")).join(merged(shown), "i", "left").select("i", F.coalesce("expressions", F.array().cast("array<string>")).alias("expressions"))
    joined = tall.alias("t")
    for name, other in (("s", shaped), ("h", spread_over)):
        o = other.withColumnsRenamed({"load": f"{name}_load", "i": f"{name}_i"})
        joined = joined.join(o, F.col("load").eqNullSafe(F.col(f"{name}_load")) & (F.col("i") == F.col(f"{name}_i")), "left").drop(f"{name}_load", f"{name}_i")
    joined = joined.join(merged(texts), "i")
    rows = joined.withColumn("null_rate", 1 - F.col("there") / F.col("n_rows")).withColumn("coverage", F.when(F.col("there") > 0, 1 - F.coalesce("nonconforming", F.lit(0)) / F.col("there")))
    w = Window.partitionBy("i").orderBy(F.asc_nulls_first("load"))
    before = lambda c: F.lag(c).over(w)
    rows = rows.withColumns({f"was_{c}": before(c) for c in ("null_rate", "coverage", "histogram", "there", "value_shares", "median")})
    share = lambda h, n: lambda b: F.coalesce(F.element_at(h, b), F.lit(0)) / F.col(n)
    now, was = share(F.col("histogram"), "there"), share(F.col("was_histogram"), "was_there")
    change = F.aggregate(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), F.lit(0.0), lambda a, b: a + F.abs(now(b) - was(b))) / 2
    moved = F.array_max(F.zip_with("value_shares", "was_value_shares", lambda a, b: F.abs(a - b)))
    return rows.select(
        F.col("load").alias("load_id"), "column_name", "n_rows", (F.col("n_rows") - F.col("there")).alias("nulls"), "null_rate", F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"), "min_value", "max_value",
        "invalid", F.when(F.col("there") > 0, F.col("invalid") / F.col("there")).alias("invalid_rate"), F.coalesce("nonconforming", F.lit(0)).alias("nonconforming"), "coverage", "expressions", "median",
        (F.col("null_rate") - F.col("was_null_rate")).alias("null_rate_change"), (F.col("coverage") - F.col("was_coverage")).alias("coverage_change"),
        F.when((F.col("there") > 0) & (F.col("was_there") > 0), change).alias("distribution_change"),
        moved.alias("value_share_change"), F.when(F.col("was_median") > 0, F.col("median") / F.col("was_median")).alias("median_ratio"),
    )


#: The question types.
QUESTION_TYPES = ("facts", "procedural", "legal_principle", "holding", "outcome")
BAD_SHARE, NULL_CHANGE, SHARE_CHANGE, MEDIAN_CHANGE = 0.01, 0.10, 0.15, 1.6


def pair_rules(subjects: DataFrame) -> dict[str, Rule]:
    """The declared rules of the pair table. The subjects are a domain whose names are written into the plan; more than MOST_NAMES are refused."""
    names = tuple(sorted(r[0] for r in subjects.select("subject").where("subject IS NOT NULL").distinct().limit(MOST_NAMES + 1).collect()))
    if len(names) > MOST_NAMES:
        raise ValueError(f"a declared domain has at most {MOST_NAMES} names")
    return {
        "question_type": Rule(F.col("question_type").isin(*QUESTION_TYPES), "pattern", QUESTION_TYPES),
        "category": Rule(F.col("category").isin(*names), "pattern", names),
        "span_start": Rule((F.col("span_start") >= 0) & (F.col("span_start") < F.col("span_end")), "range"),
    }


def pair_profile(pairs: DataFrame, subjects: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The profile of the pair table by load."""
    return profile(pairs, "load_id", columns, pair_rules(subjects))


def found(pairs: DataFrame, subjects: DataFrame) -> DataFrame:
    """p6_found: (load_id, column_name, issue) of the three checked columns."""
    p = pair_profile(pairs, subjects, ["question_type", "category", "span_start"])
    kind = F.when(F.col("column_name") == "span_start", F.lit("value_range")).otherwise(F.lit("pattern"))
    shifted = (F.col("value_share_change") > SHARE_CHANGE) | (F.col("median_ratio") > MEDIAN_CHANGE) | (F.col("median_ratio") < 1 / MEDIAN_CHANGE)
    issues = F.array(F.when(F.col("invalid_rate") >= BAD_SHARE, kind), F.when(F.abs("null_rate_change") > NULL_CHANGE, F.lit("null_rate")), F.when(shifted, F.lit("distribution")))
    return p.select("load_id", "column_name", F.explode(issues).alias("issue")).where("issue IS NOT NULL")
