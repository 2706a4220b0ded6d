"""Mixing sources to target weights by Pareto order sampling (problem 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketforge.llm.tokens import TOKENIZERS, with_tokens
from docketforge.session import cut, spread

#: Parts of the rank axis in one refinement; two refinements leave a part of about 1 / PARTS^2 of a source.
PARTS = 4096
#: Steps of the size histogram for each doubling of a document's tokens.
STEPS = 64
MAX_SOURCES = 100_000


def _scale(histogram: list[tuple[float, float, float]], wanted: float) -> float:
    """c such that documents drawn with probability min(1, c * tokens) have ``wanted`` tokens on average.

    histogram: (mean tokens, sum of tokens, sum of squared tokens) of each step.
    """
    lo, hi = 0.0, 1.0 / max(1e-9, min(h[0] for h in histogram))
    expected = lambda c: sum(h[1] if c * h[0] >= 1 else c * h[2] for h in histogram)
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if expected(mid) < wanted else (lo, mid)
    return hi


def mix(
    documents: DataFrame,
    targets: DataFrame,
    total_tokens: int | None = None,
    seed: int = 7,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    folder: str = TOKENIZERS,
) -> DataFrame:
    """(source, doc_id, tokens, copies) of each document used, such that sources have their target share of all tokens.

    The total is ``total_tokens``, or at most what lets every source that has tokens reach its share with no document
    used more than max_repeats times. A source needs r copies of its tokens: every document gets floor(r) certain
    copies, and the rest is a Pareto order sample. Documents have inclusion odds from a probability in proportion to
    their tokens, are ranked by random odds over inclusion odds, and are taken in that order up to the tokens wanted.
    A document that crosses the mark is taken if the sum then lies nearer to it. The mark is found by histograms of
    bounded size, so a source may hold any share of the rows. Sources without target, null sources, and documents
    without tokens get no copies and don't appear; a target without documents stays unmet. Repeated rows are documents
    of their own. The same seed gives the same result in any partitioning.
    """
    goals = targets.groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most")).where("source IS NOT NULL AND share > 0 AND most > 0").limit(MAX_SOURCES + 1).collect()
    if len(goals) > MAX_SOURCES:
        raise ValueError("mix() holds the targets on the driver; there are too many")
    spark = documents.sparkSession
    sized = with_tokens(spread(documents.select(F.col(source).alias("source"), F.col(key).alias("doc_id"), F.col(text).alias("text"))), "text", ["source", "doc_id"], folder)
    sized = cut(sized.where("source IS NOT NULL AND tokens > 0"), "p9-sizes")
    step = F.floor(F.log2("tokens") * STEPS)
    bars: dict[str, list] = {}
    big = F.col("tokens").cast("double")
    for r in sized.groupBy("source", step.alias("step")).agg(F.avg(big).alias("mean"), F.sum(big).alias("sum"), F.sum(big * big).alias("squares")).collect():
        bars.setdefault(r["source"], []).append((r["mean"], r["sum"], r["squares"]))
    have = {s: sum(h[1] for h in hs) for s, hs in bars.items()}
    goals = [g for g in goals if g["source"] in have]
    if not goals:
        return sized.select("source", "doc_id", "tokens", F.lit(0).alias("copies")).limit(0)
    most = min(g["most"] * have[g["source"]] / g["share"] for g in goals)
    total = min(most, total_tokens) if total_tokens is not None else most
    plan = []
    for g in goals:
        s = g["source"]
        need = min(g["share"] * total, g["most"] * have[s])
        whole = min(int(need // have[s] + 1e-12), g["most"])
        wanted = max(0.0, need - whole * have[s])
        plan.append((s, whole, float(wanted), float(_scale(bars[s], wanted)) if wanted >= 1 else 0.0))
    plans = spark.createDataFrame(plan, "source string, whole int, wanted double, c double")
    u = (F.pmod(F.xxhash64("source", "doc_id", "tokens", F.lit(seed)), F.lit((1 << 53) - 1)).cast("double") + 1) / float(1 << 53)
    p = F.least(F.lit(1.0), F.col("c") * F.col("tokens"))
    odds = u / (1 - u)
    rank = F.when(p >= 1, F.lit(0.0)).otherwise(odds / (p / (1 - p)))
    ranked = sized.join(F.broadcast(plans), "source").withColumn("rank", F.when(F.col("c") > 0, rank / (1 + rank)))
    ranked = ranked.withColumn("part", F.least(F.floor(F.col("rank") * PARTS), F.lit(PARTS - 1)).cast("int"))
    ranked = ranked.withColumn("fine", F.least(F.floor((F.col("rank") * PARTS - F.col("part")) * PARTS), F.lit(PARTS - 1)).cast("int"))
    wanted = {x[0]: x[2] for x in plan}

    def mark(rows: list, at: str, start: dict[str, float]) -> dict[str, tuple[int, float]]:
        """The part in which each source's running sum reaches what is wanted, and the sum before it."""
        out, by = {}, {}
        for r in rows:
            by.setdefault(r["source"], []).append((r[at], r["t"]))
        for s, xs in by.items():
            run = start[s]
            for i, t in sorted(xs):
                if run + t >= wanted[s]:
                    out[s] = (i, run)
                    break
                run += t
        return out

    drawn = ranked.where("rank IS NOT NULL")
    coarse = mark(drawn.groupBy("source", "part").agg(F.sum("tokens").alias("t")).collect(), "part", dict.fromkeys(wanted, 0.0))
    marks = spark.createDataFrame([(s, i) for s, (i, _) in coarse.items()] or [("", -1)], "source string, mark int")
    at_mark = drawn.join(F.broadcast(marks), "source")
    finer = mark(at_mark.where("part = mark").groupBy("source", "fine").agg(F.sum("tokens").alias("t")).collect(), "fine", {s: x[1] for s, x in coarse.items()})
    bounds = [(s, coarse[s][0], finer[s][0], finer[s][1]) for s in coarse if s in finer]
    bounds = spark.createDataFrame(bounds or [("", -1, -1, 0.0)], "source string, mark int, fine_mark int, before double")
    ranked = ranked.join(F.broadcast(bounds), "source", "left")
    below = (F.col("mark").isNull()) | (F.col("part") < F.col("mark")) | ((F.col("part") == F.col("mark")) & (F.col("fine") < F.col("fine_mark")))
    edge = (F.col("part") == F.col("mark")) & (F.col("fine") == F.col("fine_mark"))
    rows = ranked.withColumn("place", F.when(F.col("rank").isNull(), 0).when(below, 1).when(edge, 2).otherwise(0))
    taken = rows.where("place < 2").select("source", "doc_id", "tokens", (F.col("whole") + F.col("place")).alias("copies"))
    # What lies at the mark is about a PARTS^2-th part of a source.
    w = Window.partitionBy("source").orderBy("rank", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    last = rows.where("place = 2").withColumn("run", F.sum("tokens").over(w) + F.col("before"))
    extra = F.when(F.col("run") - F.col("tokens") / 2 <= F.col("wanted"), 1).otherwise(0)
    last = last.select("source", "doc_id", "tokens", (F.col("whole") + extra).alias("copies"))
    return taken.unionByName(last).where("copies > 0").select("source", "doc_id", "tokens", F.col("copies").cast("int").alias("copies"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, docs, tokens, most_copies) of a mix, one row for each target."""
    by = mixed.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.col("tokens").cast("long") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    total = by.agg(F.sum("tokens").alias("total"))
    return (
        targets.select("source", "target_share").join(F.broadcast(by), "source", "left").crossJoin(F.broadcast(total))
        .select("source", "target_share", F.round(F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)), 6).alias("actual_share"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
    )
