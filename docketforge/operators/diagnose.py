"""What keeps a quotation from being found: gaps between its verbatim pieces, classes and suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketforge.functions import text as T
from docketforge.functions import udfs
from docketforge.operators import windows as W

# What page furniture, citations and encoding faults look like.
FURNITURE = r"Cite as:|Opinion of the Court|OPINION OF THE COURT|——|(?m:^\s*[0-9]{1,3}\s*$)|\b[A-Z][A-Z.&' ]+ v\. [A-Z]|Syllabus|SUPREME COURT OF THE UNITED STATES"
FOOTNOTE = r"\n\s*[0-9]{1,3} (?:[A-Z]|See|The|In|This|Id)"
CITATION = (
    r"(?i)\bU\. ?S\.|\bF\. ?(?:[0-9]?d|Supp)|S\. ?Ct\.|L\. ?Ed\.|\bsupra\b|\bid\.|\bIbid\b|\bStat\.|\bApp\.|\bslip op\b|\bn\. [0-9]|\bat [0-9]|§|\bet seq\b|\bv\. |\bcert\. denied|\([0-9]{4}\)|\bCFR\b|\bU\. ?S\. ?C\.|\bFed\. ?Appx|\bquoting\b|\bcitation"
)
ENCODING = r"[\x{80}-\x{9F}]|Ã|Ô|â€|&amp;|&[a-z]+;"


def gap_kind(gap: Column) -> Column:
    """What stands between two verbatim pieces of a quotation."""
    signs = lambda x: F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))
    return (
        F.when(F.contains(gap, F.lit("[")) & (signs(F.regexp_replace(gap, r"\[[^\]]{0,40}\]", "")) <= 6), "editorial_brackets").when(gap.rlike(ENCODING) & (signs(gap) <= 6), "encoding_artefact")
        .when(gap.rlike(FURNITURE) | gap.rlike(FOOTNOTE), "page_furniture").when(gap.rlike(CITATION) & (F.length(gap) < 400), "citation_omitted").otherwise("prose_omitted")
    )


def suggestion(kinds: Column, lost: Column, span: Column) -> Column:
    """The class a reviewer should start from."""
    marked = F.size(F.regexp_extract_all(span, F.lit(r"\.[ ]*\.[ ]*\.|…"), F.lit(0)))
    prose = F.size(F.filter(kinds, lambda k: k == "prose_omitted")) - marked
    has = lambda k: F.array_contains(kinds, k)
    return (
        F.when(lost > 12, "review_possible_fabrication").when(prose > 0, "unmarked_omission_of_prose").when(has("citation_omitted"), "citation_omitted").when(has("page_furniture"), "page_furniture")
        .when(has("encoding_artefact"), "encoding_artefact").when(has("editorial_brackets"), "editorial_brackets").otherwise("matcher_gap_other")
    )


def failed(pairs: DataFrame, opinions: DataFrame) -> DataFrame:
    """(pair_id, span, window, document) of the spans that neither stand verbatim nor normalised in their window."""
    win = W.windows(opinions).select("cluster_id", "chunk_index", F.col("text").alias("window"))
    docs = opinions.select("cluster_id", F.col("text").alias("document"))
    rows = pairs.where("supporting_span IS NOT NULL").select("pair_id", "cluster_id", "chunk_index", F.col("supporting_span").alias("span")).distinct()
    both = rows.join(win, ["cluster_id", "chunk_index"])
    missed = both.where(~F.contains(F.col("window"), F.col("span")) & ~F.contains(T.normalised(F.col("window")), T.normalised(F.col("span"))))
    return missed.join(docs, "cluster_id").select("pair_id", "span", "window", "document")


#: Least share of a span's words in common blocks with its window, and the class that begins there.
SHARES = ((0.99, "matcher_gap"), (0.75, "near_miss"), (0.40, "paraphrase"))


def classes(pairs: DataFrame, opinions: DataFrame) -> DataFrame:
    """(pair_id, failure, share): why each failed span wasn't found in its window.

    empty without words; cross_chunk if the document has it; span_exceeds_chunk if it has more words than its window;
    else by the share of its words that the window has in common blocks, which is null for the classes before.
    """
    rows = failed(pairs, opinions).withColumns({"mine": T.words(F.col("span")), "theirs": T.words(F.col("window"))})
    rows = rows.withColumn("elsewhere", udfs.located(F.when(F.size("mine") > 0, F.col("span")), "document")["start"].isNotNull()).drop("document")
    early = F.when(F.size("mine") == 0, "empty").when(F.col("elsewhere"), "cross_chunk").when(F.size("mine") > F.size("theirs"), "span_exceeds_chunk")
    rows = rows.withColumn("early", early)
    rows = rows.withColumn("share", udfs.overlap_share(F.when(F.col("early").isNull(), F.col("mine")), F.when(F.col("early").isNull(), F.col("theirs"))))
    by_share = F.lit("fabricated")
    for least, name in reversed(SHARES):
        by_share = F.when(F.col("share") >= least, name).otherwise(by_share)
    return rows.select("pair_id", F.coalesce("early", by_share).alias("failure"), F.round("share", 6).alias("share"))


def divergences(pairs: DataFrame, opinions: DataFrame, step: int = 10, most: int = 400, around: int = 60) -> DataFrame:
    """(pair_id, agree, span_rest, source_rest): how many leading characters of a span, in steps from twice ``step`` up to ``most``, its opinion has in a row, and what follows there on both sides.

    Pairs whose whole span is found or whose opinion is missing are left out; source_rest is null if not even the first
    step is found.
    """
    p = pairs.where(T.blank(F.col("supporting_span")) != "").select("pair_id", "cluster_id", F.col("supporting_span").alias("span"))
    both = p.join(opinions.select("cluster_id", "text"), "cluster_id").where(~F.contains("text", "span"))
    lengths = F.filter(F.sequence(F.lit(2 * step), F.lit(most), F.lit(step)), lambda n: n <= F.length("span"))
    # A prefix is found only if every shorter one is, so the first miss ends the search.
    reach = F.aggregate(lengths, F.lit(0), lambda a, n: F.when((a == n - step) | ((a == 0) & (n == 2 * step)), F.when(F.contains(F.col("text"), F.substring(F.col("span"), F.lit(1), n)), n).otherwise(a)).otherwise(a))
    rows = both.withColumn("agree", reach)
    at = F.instr(F.col("text"), F.substring(F.col("span"), F.lit(1), F.col("agree")))
    return rows.select(
        "pair_id", "agree", F.substring(F.col("span"), F.col("agree") + 1, F.lit(around)).alias("span_rest"),
        F.when(F.col("agree") > 0, F.substring(F.col("text"), at + F.col("agree"), F.lit(around))).alias("source_rest"),
    )


def between(spans: DataFrame, opinions: DataFrame) -> DataFrame:
    """(cluster_id, gap_start, gap_end, gap): the source text between each recorded span and the next one of its document that begins behind it; gaps of up to 2 characters are none."""
    from pyspark.sql.window import Window

    p = spans.where("span_start >= 0 AND span_end > span_start AND cluster_id IS NOT NULL").select("cluster_id", "span_start", "span_end").distinct()
    w = Window.partitionBy("cluster_id").orderBy("span_start", "span_end")
    p = p.withColumn("next", F.lead("span_start").over(w)).where("next - span_end > 2")
    both = p.join(opinions.select("cluster_id", "text"), "cluster_id").where(F.col("next") <= F.length("text"))
    return both.select("cluster_id", F.col("span_end").alias("gap_start"), F.col("next").alias("gap_end"), F.substring(F.col("text"), (F.col("span_end") + 1).cast("int"), (F.col("next") - F.col("span_end")).cast("int")).alias("gap"))


def suggestions(pairs: DataFrame, opinions: DataFrame) -> DataFrame:
    """(pair_id, pieces, lost, kinds, suggested, evidence) of each failed span; evidence is a sentence on what was found."""
    rows = failed(pairs, opinions).withColumn("p", udfs.pieced("span", "window"))
    between_ = F.transform(F.sequence(F.lit(1), F.size("p.pieces") - 1), lambda i: F.struct(F.element_at("p.pieces", i)["end"].alias("a"), F.element_at("p.pieces", i + 1)["start"].alias("b")))
    gaps = F.when(F.size("p.pieces") > 1, F.transform(F.filter(between_, lambda g: g["b"] - g["a"] > 2), lambda g: F.substring(F.col("window"), g["a"] + 1, g["b"] - g["a"]))).otherwise(F.array().cast("array<string>"))
    kinds = F.transform(gaps, gap_kind)
    evidence = F.format_string("%d pieces in order, %d signs in none; between them: %s", F.size("p.pieces"), F.col("p.lost"), F.when(F.size(kinds) > 0, F.array_join(kinds, ", ")).otherwise("nothing"))
    return rows.select("pair_id", F.size("p.pieces").alias("pieces"), F.col("p.lost").alias("lost"), kinds.alias("kinds"), suggestion(kinds, F.col("p.lost"), F.col("span")).alias("suggested"), evidence.alias("evidence"))


# The classes a reviewer may give, and those of an unfaithful quotation.
REVIEW_CLASSES = ("fabrication", "misquotation", "from_memory", "unmarked_omission", "citation_omitted", "page_furniture", "encoding_artefact")
UNFAITHFUL = ("fabrication", "misquotation", "from_memory")


def labelled(rows: DataFrame, manual: DataFrame, key: str = "pair_id", classes: tuple[str, ...] = REVIEW_CLASSES) -> DataFrame:
    """rows (key, suggested, ...) with ``classification`` and ``classified_by``: the class a person gave, else the suggested one.

    manual: (key, label). A blank label counts as none. A label outside ``classes`` fails the query when it is run.
    """
    given = manual.where(F.trim(T.blank(F.col("label"))) != "").groupBy(key).agg(F.min(F.trim("label")).alias("label"))
    checked = F.when(F.col("label").isNull() | F.col("label").isin(*classes), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("unknown class: "), F.col("label"))))
    out = rows.join(given, key, "left").withColumn("label", checked)
    return out.withColumn("classification", F.coalesce("label", "suggested")).withColumn("classified_by", F.when(F.col("label").isNotNull(), "person").otherwise("suggestion")).drop("label")


def review_rates(rows: DataFrame, total: int, groups: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(label, n, pct, low, high): rates of groups of classes among ``total`` candidates, only if every row is classified; else no row."""
    groups = groups or {"fabrication": ("fabrication",), "unfaithful_quotation": UNFAITHFUL, "unmarked_omission": ("unmarked_omission",)}
    one = rows.agg(F.count_if(F.col("classification").isNull()).alias("open"), *[F.count_if(F.col("classification").isin(*c)).alias(g) for g, c in groups.items()]).where("open = 0")
    tall = one.select(F.explode(F.array(*[F.struct(F.lit(g).alias("label"), F.col(g).alias("n")) for g in groups])).alias("x")).select("x.*")
    return _with_interval(tall, total)


def _with_interval(by: DataFrame, total: int) -> DataFrame:
    out = by.withColumn("ci", udfs.exact_interval("n", F.lit(total)))
    return out.select("label", "n", F.round(100 * F.col("n") / total, 4).alias("pct"), F.round(100 * F.col("ci.low"), 4).alias("low"), F.round(100 * F.col("ci.high"), 4).alias("high"))


def class_rates(rows: DataFrame, label: str, total: int) -> DataFrame:
    """(label, n, pct, low, high): each class's rate among ``total`` candidates with its exact binomial interval in percent."""
    return _with_interval(rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")), total)
