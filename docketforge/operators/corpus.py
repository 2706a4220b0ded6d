"""Building and gating the corpus: keyed loads, fallback joins, cleaning gates, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketforge.functions import text as T
from docketforge.functions.udfs import section_summary

# Opinion types that state the Court's decision.
PRIMARY_TYPES = ("010combined", "015unamimous", "020lead", "025plurality")
# Issue areas by code.
AREAS = {
    "1": "criminal_procedure", "2": "civil_rights", "3": "first_amendment", "4": "due_process", "5": "privacy", "6": "attorneys", "7": "unions",
    "8": "economic_activity", "9": "judicial_power", "10": "federalism", "11": "interstate_relations", "12": "federal_taxation", "13": "miscellaneous", "14": "private_action",
}
# Wordings of a text that isn't a decision on the merits.
NOT_MERITS = "(?i)petition for (?:a )?writ of certiorari is denied|application for (?:a )?stay|dissenting from the denial|respecting the denial|Statement of JUSTICE|Differences exist between documents"
LEAST_WORDS, MOST_WORDS, GAP_DAYS, HEAD = 500, 80_000, 60, 3000
ISO = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def keep_one(df: DataFrame, key: str | list[str], order: list) -> DataFrame:
    """The first row of each key by ``order``; rows with a null key are left out."""
    keys = [key] if isinstance(key, str) else key
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def area_name(code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in AREAS.items() for x in kv]), F.trim(code))


def authority(cases: DataFrame, by: str, order: str = "caseid") -> DataFrame:
    """The authority rows by 'citation' or 'name' key, of equal keys the first by ``order``: its caseid, or its place in the file it came from."""
    key = T.citation_key(F.col("uscite")) if by == "citation" else F.nullif(T.name_key(F.col("casename")), F.lit(""))
    rows = cases.select(key.alias("key"), "caseid", area_name(F.col("issuearea")).alias("area"), "term", F.col(order).alias("__o"))
    return keep_one(rows, "key", ["__o"]).drop("__o")


def annotate(clusters: DataFrame, cases: DataFrame, lenient: bool = True) -> DataFrame:
    """(cluster_id, caseid, area, matched): the authority row of each cluster by citation, else by name.

    Lenient: the name is tried whenever the citation finds nothing. Strict: only if there is no citation to parse, and
    clusters without a match are left out. matched is 'citation', 'case_name' or null. Neither join expands a row.
    """
    rows = clusters.select("cluster_id", T.citation_key(F.col("citation")).alias("ck"), F.nullif(T.name_key(F.col("case_name")), F.lit("")).alias("nk"))
    by_cite = authority(cases, "citation").select(F.col("key").alias("ck"), F.col("caseid").alias("c_id"), F.col("area").alias("c_area"))
    by_name = authority(cases, "name").select(F.col("key").alias("nk"), F.col("caseid").alias("n_id"), F.col("area").alias("n_area"))
    both = rows.join(by_cite, "ck", "left").join(by_name, "nk", "left")
    allowed = F.lit(True) if lenient else F.col("ck").isNull()
    by_c = F.col("c_id").isNotNull()
    by_n = ~by_c & allowed & F.col("n_id").isNotNull()
    out = both.select(
        "cluster_id", F.when(by_c, F.col("c_id")).when(by_n, F.col("n_id")).alias("caseid"), F.when(by_c, F.col("c_area")).when(by_n, F.col("n_area")).alias("area"),
        F.when(by_c, "citation").when(by_n, "case_name").alias("matched"),
    )
    return out if lenient else out.where("matched IS NOT NULL")


def latest_clusters(clusters: DataFrame) -> DataFrame:
    """One row for each cluster: the last delivery."""
    return keep_one(clusters, "cluster_id", [F.desc("ingested_at"), "case_name"])


def sub_opinions(opinions: DataFrame) -> DataFrame:
    """(cluster_id, sub_opinions): each cluster's opinions with text as an array ordered by opinion_id; exact copies of an opinion count once, words are counted anew."""
    parts = opinions.where(T.blank(F.col("text")) != "").dropDuplicates(["cluster_id", "opinion_id"])
    one = F.struct("opinion_id", F.trim("opinion_type").alias("type"), F.nullif(F.trim("author"), F.lit("")).alias("author"), "text", T.word_count(F.col("text")).alias("word_count"))
    return parts.groupBy("cluster_id").agg(F.array_sort(F.collect_list(one)).alias("sub_opinions"))


def with_opinions(clusters: DataFrame, opinions: DataFrame) -> DataFrame:
    """Clusters with their sub-opinions; clusters without text are left out."""
    return latest_clusters(clusters).join(sub_opinions(opinions), "cluster_id")


def mapped(clusters: DataFrame, opinions: DataFrame) -> DataFrame:
    """Clusters as records of the corpus: names, courts and citations trimmed, empty ones null, flags as booleans, the sub-opinions that have a text with their own word counts."""
    tidy = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")).alias(c)
    flags = opinions.groupBy("cluster_id").agg(F.coalesce(F.bool_or("per_curiam"), F.lit(False)).alias("per_curiam"), F.coalesce(F.bool_or("extracted_by_ocr"), F.lit(False)).alias("extracted_by_ocr"))
    rows = with_opinions(clusters, opinions).join(flags, "cluster_id")
    return rows.select("cluster_id", tidy("case_name"), tidy("date_filed"), tidy("court"), tidy("citation"), tidy("scdb_id"), tidy("judges"), "per_curiam", "extracted_by_ocr", "sub_opinions")


def first_official(citations: Column) -> Column:
    """The first of parallel citations that begins as an official one, trimmed; null if none does."""
    hits = F.filter(citations, lambda c: c.rlike(r"^\s*[0-9]+\s+U\.\s?S\.\s+[0-9]+"))
    return F.trim(F.get(hits, 0))


def written_citation(citations: Column) -> Column:
    """'volume reporter page' of the first of an array of citation structs; null without one."""
    first = F.get(citations, 0)
    return F.when(first.isNotNull(), F.concat_ws(" ", first["volume"].cast("string"), first["reporter"], first["page"].cast("string")))


def author_of(name: Column, id: Column) -> Column:
    """The author's name, else the id as text; null if there is neither."""
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(id.cast("string"), F.lit("0")))


def revisions(name: Column) -> Column:
    """Whether a name announces a revision of something posted before."""
    return F.coalesce(name.rlike(r"(?i)\bRevisions?\s*:"), F.lit(False))


def without_category(rows: DataFrame, group: str = "cluster_id", most: int | None = None) -> DataFrame:
    """(groups, lacking): how many groups there are and how many have no category in any row. With ``most``, the query fails if more lack one."""
    per = rows.groupBy(group).agg(F.max(F.nullif(F.col("category"), F.lit(""))).alias("c"))
    out = per.agg(F.count("*").alias("groups"), F.count_if(F.col("c").isNull()).alias("lacking"))
    if most is None:
        return out
    return out.withColumn("lacking", F.when(F.col("lacking") <= most, F.col("lacking")).otherwise(F.raise_error(F.format_string("%d groups have no category", F.col("lacking"))).cast("long")))


def primary(subs: str = "sub_opinions") -> Column:
    """The longest primary opinion, of equally long ones the first; null if there is none."""
    main = F.filter(subs, lambda x: x["type"].isin(*PRIMARY_TYPES))
    ranked = F.array_sort(F.transform(main, lambda x, i: F.struct((-x["word_count"]).alias("n"), i.alias("i"), x.alias("x"))))
    return F.try_element_at(ranked, F.lit(1))["x"]


def gate(duplicate: Column, missing: Column, binding: Column, words: Column, date: Column, unsound: Column) -> Column:
    """The first gate a record fails, or 'kept': duplicate, no_primary, no_binding, low_confidence, too_short, too_long, missing_date, failed_validation."""
    return (
        F.when(duplicate, "duplicate").when(missing, "no_primary").when(binding < 1, "no_binding").when(binding > 1, "low_confidence").when(words < LEAST_WORDS, "too_short").when(words > MOST_WORDS, "too_long")
        .when(T.blank(date) == "", "missing_date").when(unsound, "failed_validation").otherwise("kept")
    )


def gates(clusters: DataFrame, opinions: DataFrame) -> DataFrame:
    """(cluster_id, reason, words, kept_words) of every delivered cluster with text: the first of gate()'s reasons, or 'kept'.

    A later delivery of a cluster is a duplicate. Sections are found by the segmenter in each cluster's first delivery;
    words are those of the primary opinion, kept_words those of its binding sections; a record is unsound without a name
    or a court, or with a date that isn't ISO.
    """
    parts = sub_opinions(opinions)
    n = F.row_number().over(Window.partitionBy("cluster_id").orderBy("ingested_at", "case_name"))
    rows = clusters.where("cluster_id IS NOT NULL").withColumn("again", n > 1).join(parts, "cluster_id").select("cluster_id", "again", "case_name", "court", "date_filed", primary().alias("p"))
    missing = F.col("p").isNull()
    rows = rows.withColumn("words", F.when(~F.col("again"), F.col("p.word_count"))).withColumn("s", section_summary(F.when(~F.col("again") & ~missing, T.clean_text(F.col("p.text")))))
    binding = F.coalesce(F.col("s.kinds")["majority"], F.lit(0)) + F.coalesce(F.col("s.kinds")["per_curiam"], F.lit(0))
    kept = F.when(~F.col("again") & ~missing, T.word_count(F.col("s.binding_text"))).otherwise(0)
    unsound = (T.blank(F.col("case_name")) == "") | (T.blank(F.col("court")) == "") | ~F.coalesce(F.col("date_filed").rlike(ISO), F.lit(False))
    return rows.select("cluster_id", gate(F.col("again"), missing, binding, kept, F.col("date_filed"), unsound).alias("reason"), F.coalesce("words", F.lit(0)).alias("words"), kept.alias("kept_words"))


def removed_share(gated: DataFrame) -> DataFrame:
    """(removed, source_words, pct): words that left the records which reached segmentation, and their share of the kept records' words."""
    removed = F.sum(F.when(~F.col("reason").isin("duplicate", "no_primary"), F.greatest(F.lit(0), F.col("words") - F.col("kept_words"))))
    kept = F.sum(F.when(F.col("reason") == "kept", F.col("words")))
    return gated.agg(removed.alias("removed"), kept.alias("source_words"), F.round(F.try_divide(100 * removed, kept), 1).alias("pct"))


def record_problems(cleaned: DataFrame) -> DataFrame:
    """(cluster_id, problems): every problem of a cleaned record: missing fields, a date that isn't ISO, a word count off by more than one, a primary opinion that is a separate writing."""
    need = ["case_name", "date_filed", "court", "primary_type", "text"]
    checks = [F.when(T.blank(F.col(c)) == "", F.lit(f"missing {c}")) for c in need]
    checks += [
        F.when((T.blank(F.col("date_filed")) != "") & ~F.col("date_filed").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit("date not ISO")),
        F.when(F.abs(F.coalesce("word_count", F.lit(0)) - T.word_count(F.col("text"))) > 1, F.lit("word count")),
        F.when((T.blank(F.col("primary_type")) != "") & ~F.col("primary_type").isin(*PRIMARY_TYPES), F.lit("separate writing")),
    ]
    return cleaned.select("cluster_id", F.array_compact(F.array(*checks)).alias("problems"))


def audit(cleaned: DataFrame, cases: DataFrame) -> DataFrame:
    """(cluster_id, reasons): why a record shouldn't be in the corpus: wrong_case (filed more than GAP_DAYS from its case's decision), not_merits (by its first HEAD characters), unsegmented (one majority section though there are separate writings)."""
    dates = keep_one(cases.select(F.col("caseid").alias("scdb_id"), F.try_to_date("datedecision", "M/d/yyyy").alias("decided")), "scdb_id", [F.desc_nulls_last("decided")])
    rows = cleaned.join(dates, "scdb_id", "left")
    gap = F.abs(F.datediff(F.try_to_date("date_filed", "yyyy-MM-dd"), F.col("decided")))
    checks = F.array(
        F.when(gap > GAP_DAYS, "wrong_case"), F.when(F.substring("text", 1, HEAD).rlike(NOT_MERITS), "not_merits"),
        F.when((F.map_keys("section_kinds") == F.array(F.lit("majority"))) & (F.col("n_secondary") > 0), "unsegmented"),
    )
    return rows.select("cluster_id", F.array_compact(checks).alias("reasons"))


def trimmed(cleaned: DataFrame, audited: DataFrame, cuts: DataFrame) -> DataFrame:
    """(cluster_id, reasons, cut_at, text, words_kept, words_removed) of every record: sound ones end at their cut.

    cuts: (cluster_id, cut_at). A record with reasons isn't cut; one that keeps fewer than LEAST_WORDS words gets the
    reason below_min_words_after_trim instead and keeps its text, as do records without a cut. Spaces before the cut go.
    """
    rows = cleaned.select("cluster_id", "text").join(audited, "cluster_id").join(cuts, "cluster_id", "left")
    sound = F.coalesce(F.size("reasons") == 0, F.lit(True)) & F.col("cut_at").isNotNull()
    head = F.regexp_replace(F.substring("text", F.lit(1), F.col("cut_at").cast("int")), f"{T.SPACE}+$", "")
    rows = rows.withColumn("head", F.when(sound, head)).withColumn("kept", F.when(sound, T.word_count(F.col("head"))))
    short = sound & (F.col("kept") < LEAST_WORDS)
    tail = F.substring("text", F.col("cut_at").cast("int") + 1, F.length("text"))
    return rows.select(
        "cluster_id", F.when(short, F.array(F.lit("below_min_words_after_trim"))).otherwise(F.col("reasons")).alias("reasons"), F.when(sound & ~short, F.col("cut_at")).alias("cut_at"),
        F.when(sound & ~short, F.col("head")).otherwise(F.col("text")).alias("text"), F.col("kept").alias("words_kept"), F.when(sound, T.word_count(tail)).alias("words_removed"),
    )


def excluded(audited: DataFrame, reasons: list[str]) -> DataFrame:
    """The records of which any reason is among ``reasons``."""
    return audited.where(F.arrays_overlap("reasons", F.array(*[F.lit(r) for r in reasons])))


def kind_counts(kinds: Column) -> Column:
    """A list of kinds as a map from kind to its number."""
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k)))))


def examples(rows: DataFrame, label: str, key: str, k: int = 5) -> DataFrame:
    """At most k rows of each label, the first by key; tasks keep k rows of a label before anything is shuffled."""
    n = F.row_number().over(Window.partitionBy(label).orderBy(key))
    return rows.withColumn("__n", n).where(F.col("__n") <= k).withColumnRenamed("__n", "example")


def by_position(rows: DataFrame, order: list[str], verdicts: DataFrame) -> DataFrame:
    """rows with ``verdict``: verdicts (position, verdict) name a row by its place in ``order``, from 0. Rows without a verdict keep null.

    Places are counted by ranked() over hashed days of the order, so the rows meet in no single task.
    """
    from docketforge.operators.splitting import placed

    return placed(rows, order).join(verdicts, "position", "left")


def drop_excluded_pairs(pairs: DataFrame, audited: DataFrame, cuts: DataFrame) -> DataFrame:
    """Pairs of sound documents that end at or before their document's cut. cuts: (cluster_id, cut_at)."""
    bad = audited.where(F.size("reasons") > 0).select("cluster_id")
    kept = pairs.join(bad, "cluster_id", "left_anti").join(cuts, "cluster_id", "left")
    return kept.where(F.col("cut_at").isNull() | (F.col("span_end") <= F.col("cut_at"))).drop("cut_at")


def passage(start: Column, end: Column, text: Column, around: int = 900) -> Column:
    """The text from ``around`` before a span to ``around`` behind it; without offsets its first 2 * around characters."""
    low, high = F.greatest(F.lit(0), start - around), F.least(F.length(text), end + around)
    return F.when(start.isNull() | end.isNull(), F.substring(text, 1, 2 * around)).otherwise(F.substring(text, (low + 1).cast("int"), (high - low).cast("int")))


def extractive_answer(text: Column, words: int = 40) -> Column:
    """Leading sentences until there are at least ``words`` words, the last one whole."""
    sentences = F.split(T.squeeze(T.blank(text)), "(?<=[.!?]) ")
    acc = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))
    step = lambda a, s: F.when(a["n"] >= words, a).otherwise(F.struct((a["n"] + T.word_count(s)).alias("n"), F.array_append(a["out"], s).alias("out")))
    return F.array_join(F.aggregate(sentences, acc, step, lambda a: a["out"]), " ")
