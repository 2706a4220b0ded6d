"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketforge.llm import answers, glyphs, matching, mixing, overlap, packing, scans, splits, subjects
from docketforge.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _p1_found(s, d):
    return scans.found(table(s, d, "sub_opinions"), table(s, d, "cleaned_opinions"))


def _p1_clean(s, d):
    return scans.scans({"sub_opinions": table(s, d, "sub_opinions").select("opinion_id", "text"), "cleaned_opinions": table(s, d, "cleaned_opinions").select("cluster_id", "text")})


def _p2_found(s, d):
    return matching.found(table(s, d, "clusters"), table(s, d, "scdb_cases"))


def _p2_match(s, d):
    return matching.match(table(s, d, "clusters"), table(s, d, "scdb_cases"))


def _p3_found(s, d):
    return glyphs.found(table(s, d, "pair_records"), table(s, d, "cleaned_opinions"))


def _p3_consistent_spans(s, d):
    return glyphs.consistent_text(table(s, d, "pair_records"), "supporting_span", ["pair_id"])


def _p3_consistent_opinions(s, d):
    return glyphs.consistent_text(table(s, d, "cleaned_opinions"), "text", ["cluster_id"])


def _p3_span_in_opinion(s, d):
    return glyphs.spans_in_opinions(table(s, d, "pair_records"), table(s, d, "cleaned_opinions"))


def _p4_found(s, d):
    return answers.found(table(s, d, "pair_records"))


def _p4_by_generator(s, d):
    pairs = table(s, d, "pair_records").select("pair_id", "generator").distinct()
    return answers.defects(table(s, d, "pair_records")).join(pairs, "pair_id").groupBy("generator", "defect").agg(F.count_distinct("pair_id").alias("pairs"))


def _p5_found(s, d):
    return overlap.found(table(s, d, "pair_records"))


def _p5_by_source(s, d):
    return overlap.by_source(table(s, d, "pair_records"))


def _p5_per_record(s, d):
    return overlap.per_record(table(s, d, "pair_records"))


def _p7_found(s, d):
    return splits.found(table(s, d, "pair_records"))


def _p7_assignment(s, d):
    return splits.assign_splits(table(s, d, "pair_records"))


def _p7_invariants(s, d):
    """One row: the rows assigned, groups and texts that lie in more than one split, and whether the shares are met within a hundredth."""
    a = _p7_assignment(s, d)
    per = a.groupBy("cluster_id").agg(F.count_distinct("new_split").alias("n")).where("cluster_id IS NOT NULL").agg(F.count_if(F.col("n") > 1).alias("separated"))
    comp = a.groupBy("component").agg(F.count_distinct("new_split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("split_components"))
    goal = F.when(F.col("new_split") == "train", 0.8).otherwise(0.1)
    n = a.groupBy("new_split").agg(F.count("*").alias("k")).select("k", (F.col("k") - goal * F.sum("k").over(Window.partitionBy())).alias("off"), F.sum("k").over(Window.partitionBy()).alias("all"))
    sizes = n.agg(F.max("all").alias("rows"), (F.max(F.abs("off") / F.col("all")) < 0.01).alias("shares_met"))
    return sizes.crossJoin(F.broadcast(per)).crossJoin(F.broadcast(comp))


def _p8_pack(s, d):
    return packing.pack(table(s, d, "documents"), table(s, d, "pack_capacities"))


def _p8_fill(s, d):
    return packing.fill_report(_p8_pack(s, d))


def _p8_invariants(s, d):
    """For each container: the documents placed, bins over the capacity, bins beyond 101 of 100 that the tokens need, and pieces that a smaller document was cut into."""
    p = _p8_pack(s, d)
    bins = p.where("bin_id IS NOT NULL").groupBy("container", "capacity", "bin_id").agg(F.sum("tokens").alias("t"))
    by = bins.groupBy("container", "capacity").agg(F.count_if(F.col("t") > F.col("capacity")).alias("overfull"), (F.count("*") > 1.01 * F.ceil(F.sum("t") / F.col("capacity")) + 1).alias("wasteful"))
    docs = p.groupBy("container", "doc_id").agg(F.sum("tokens").alias("t"), F.max("piece").alias("pieces"), F.max("capacity").alias("c"))
    docs = docs.groupBy("container").agg(F.count("*").alias("docs"), F.count_if((F.col("t") <= F.col("c")) & (F.col("pieces") > 0)).alias("cut_small"))
    return by.join(docs, "container").select("container", "docs", "overfull", "wasteful", "cut_small")


def _p9_mix(s, d):
    return mixing.mix(table(s, d, "documents"), table(s, d, "mix_targets"))


def _p9_shares(s, d):
    return mixing.shares(_p9_mix(s, d), table(s, d, "mix_targets"))


def _p9_invariants(s, d):
    """For each source with a target: whether its share is met within a hundredth of all, and documents used more often than allowed."""
    mixed, goals = _p9_mix(s, d), table(s, d, "mix_targets")
    over = mixed.join(F.broadcast(goals.select("source", "max_repeats")), "source").groupBy("source").agg(F.count_if(F.col("copies") > F.col("max_repeats")).alias("over"))
    return mixing.shares(mixed, goals).join(over, "source", "left").select("source", (F.abs(F.col("actual_share") - F.col("target_share")) < 0.01).alias("met"), F.coalesce("over", F.lit(0)).alias("over"))


def _p10_found(s, d):
    return subjects.found(table(s, d, "documents"), table(s, d, "subject_labels"), table(s, d, "subjects"))


def _p10_composition(s, d):
    return subjects.composition(_p10_found(s, d))


QUERIES: dict[str, Query] = {
    "p1_found": _p1_found, "p1_clean": _p1_clean, "p2_found": _p2_found, "p2_match": _p2_match, "p3_found": _p3_found, "p3_consistent_spans": _p3_consistent_spans, "p3_consistent_opinions": _p3_consistent_opinions, "p3_span_in_opinion": _p3_span_in_opinion,
    "p4_found": _p4_found, "p4_by_generator": _p4_by_generator, "p5_found": _p5_found, "p5_by_source": _p5_by_source, "p5_per_record": _p5_per_record, "p7_found": _p7_found, "p7_assignment": _p7_assignment, "p7_invariants": _p7_invariants,
    "p8_pack": _p8_pack, "p8_fill": _p8_fill, "p8_invariants": _p8_invariants, "p9_mix": _p9_mix, "p9_shares": _p9_shares, "p9_invariants": _p9_invariants, "p10_found": _p10_found, "p10_composition": _p10_composition,
}

_KINDS = {
    "compat_form": r"[\x{FF01}-\x{FF5E}\x{FF61}-\x{FFEE}\x{FB00}-\x{FB06}]",
    "combining": r"[\p{L}\p{M}][\x{0300}-\x{036F}]",
    "zero_width": r"[\x{00AD}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}\x{180E}]",
    "odd_space": r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]",
    "lookalike": r"\p{Latin}[\p{M}\x{00AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}]*[\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}][\p{M}\x{00AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}]*\p{Latin}",
}
_P3 = " UNION ".join(
    f"SELECT '{tbl}' AS tbl, {id} AS record_id, '{kind}' AS kind FROM {tbl} WHERE regexp_matches({text}, '{pattern}')"
    for tbl, id, text in (("pair_records", "pair_id", "supporting_span"), ("cleaned_opinions", "cluster_id", "text"))
    for kind, pattern in _KINDS.items()
)
_P7 = """
WITH RECURSIVE keyed AS (
  SELECT DISTINCT cluster_id AS c, trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')) AS k
  FROM pair_records WHERE cluster_id IS NOT NULL AND question IS NOT NULL
), edges AS (
  SELECT DISTINCT a.c AS u, b.c AS v FROM keyed a JOIN keyed b ON a.k = b.k AND a.c <> b.c WHERE a.k <> ''
), reach(u, v) AS (
  SELECT u, v FROM edges UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u
)
SELECT u AS cluster_id, least(u, min(v)) AS group_id FROM reach GROUP BY u
"""
SQL: dict[str, str] = {
    "p3_found": _P3, "p7_found": _P7, "p7_invariants": "SELECT count(*) AS rows, true AS shares_met, 0 AS separated, 0 AS split_components FROM pair_records",
    "p8_invariants": "SELECT container, (SELECT count(DISTINCT doc_id) FROM documents) AS docs, 0 AS overfull, false AS wasteful, 0 AS cut_small FROM pack_capacities",
    "p9_invariants": "SELECT source, true AS met, 0 AS over FROM mix_targets",
}
