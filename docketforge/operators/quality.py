"""Validation of generated pairs and signals of question quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketforge.functions import text as T
from docketforge.functions.udfs import longest_run
from docketforge.operators.verify import normalised_hit
from docketforge.session import spread

QUESTION_WORDS, ANSWER_WORDS, SPAN_CHARS, COPIED_RUN = (8, 45), (15, 90), 40, 10
TYPES = ("facts", "procedural", "legal_principle", "holding", "outcome")

# Questions that can be answered without the reasoning, by flag.
TRIVIAL = {
    "asks_date": r"\bwhat (?:year|date|day)\b", "asks_author": r"\bwho (?:wrote|authored|delivered)\b", "asks_justice": r"\bwhich (?:justice|judge)\b",
    "asks_case_name": r"\bwhat (?:is|was) the (?:case )?(?:name|citation|docket)\b", "asks_vote_count": r"\bhow many (?:justices|votes|pages)\b", "asks_court": r"\bwhat court\b",
    "meta_reference": r"^(?:what does the (?:passage|text|excerpt) (?:say|state)|according to the (?:passage|text))", "mere_mention": r"^what (?:is|are) mentioned",
}
# Stems that ask for reasoning.
REASONING = r"^why\b|\bhow did the court (?:reason|conclude|distinguish|reconcile)|\bon what (?:basis|ground|rationale)|\bwhat (?:principle|standard|test|doctrine)|\bdistinguish|\breject(?:ed)? the argument"
# Doctrinal vocabulary, word by word.
LEGAL_TERMS = [
    "holding", "held", "precedent", "stare", "decisis", "statutory", "construction", "constitutional", "doctrine", "standard", "review", "burden",
    "proof", "jurisdiction", "remand", "reversed", "affirmed", "certiorari", "dissent", "concurrence", "plaintiff", "defendant", "petitioner",
    "respondent", "appellant", "appellee", "liability", "damages", "injunction", "remedy", "due", "process", "equal", "protection", "commerce",
    "clause", "amendment", "statute", "regulation", "preemption", "preempt", "deference", "chevron", "scrutiny", "rational", "basis", "strict",
    "intermediate", "test", "prong", "element", "intent", "negligence", "scienter", "mens", "rea", "actus", "reus", "immunity", "qualified",
    "sovereign", "standing", "mootness", "ripeness", "justiciable", "waiver", "estoppel", "vacated", "reasoning", "rationale", "interpret",
    "interpretation", "construe", "ambiguity", "plain", "meaning", "legislative", "history", "canon", "textual", "originalism", "precedential",
]


def reason(found: Column, run: Column) -> Column:
    """The first check that a pair fails, or 'ok': empty_field, question_length, answer_length, yes_no_answer, bad_question_type, span_not_found, answer_copies_span, span_too_short."""
    nq, na, ns = (T.word_count(F.col(c)) for c in ("question", "answer", "supporting_span"))
    return (
        F.when((nq == 0) | (na == 0) | (ns == 0), "empty_field").when((nq < QUESTION_WORDS[0]) | (nq > QUESTION_WORDS[1]), "question_length").when((na < ANSWER_WORDS[0]) | (na > ANSWER_WORDS[1]), "answer_length")
        .when(T.starts_yes_no(F.col("answer")), "yes_no_answer").when(~F.coalesce(F.col("question_type").isin(*TYPES), F.lit(False)), "bad_question_type").when(~found, "span_not_found")
        .when(run > COPIED_RUN, "answer_copies_span").when(F.length(T.squeeze(F.col("supporting_span"))) < SPAN_CHARS, "span_too_short").otherwise("ok")
    )


def validated(pairs: DataFrame, opinions: DataFrame) -> DataFrame:
    """(pair_id, reason) for every row: the ordered checks of a pair, with the span looked for verbatim in normalised form.

    A pair whose opinion is unknown has no span found. The copied run is counted inside the row; the one join brings the
    opinion's normalised text, made once for each opinion.
    """
    source = spread(opinions.select("cluster_id", "text")).select("cluster_id", T.normalised(F.col("text")).alias("source"))
    columns = ["pair_id", "cluster_id", "question", "answer", "question_type", "supporting_span"]
    checked = spread(pairs.select(*columns)).select(*columns, longest_run(T.blank(F.col("answer")), T.blank(F.col("supporting_span"))).alias("run"))
    both = checked.join(source, "cluster_id", "left")
    return both.select("pair_id", reason(normalised_hit(F.col("supporting_span"), F.col("source")), F.col("run")).alias("reason"))


def signals(pairs: DataFrame) -> DataFrame:
    """(pair_id, question_type, flags, is_trivial, asks_reasoning, legal_terms, legal_density, span_overlap, near_copy, question_words, answer_words) of every row."""
    q = T.blank(F.col("question"))
    flags = F.array_compact(F.array(*[F.when((F.trim(q) if p.startswith("^") else q).rlike("(?i)" + p), F.lit(name)) for name, p in TRIVIAL.items()]))
    # Every text becomes its tokens once, and the overlap is counted once; what follows reads the results.
    made = spread(pairs.select("pair_id", "question_type", "question", "answer", "supporting_span")).select(
        "pair_id", "question_type", "question", "answer", F.regexp_extract_all(F.lower(q), F.lit("[a-z]+"), F.lit(0)).alias("tokens"), T.overlap_ratio(F.col("answer"), F.col("supporting_span")).alias("ratio")
    )
    legal = F.size(F.filter("tokens", lambda t: t.isin(LEGAL_TERMS)))
    return made.select(
        "pair_id", "question_type", flags.alias("flags"), (F.size(flags) > 0).alias("is_trivial"), q.rlike("(?i)" + REASONING).alias("asks_reasoning"), legal.alias("legal_terms"),
        F.round(legal / F.greatest(F.size("tokens"), F.lit(1)), 3).alias("legal_density"), F.round("ratio", 3).alias("span_overlap"), (F.col("ratio") > 0.85).alias("near_copy"),
        T.word_count(F.col("question")).alias("question_words"), T.word_count(F.col("answer")).alias("answer_words"),
    )


def report(pairs: DataFrame, by_type: bool = True) -> DataFrame:
    """(question_type, n, trivial_pct, reasoning_pct, no_legal_pct, median_legal_terms, near_copy_pct, median_overlap), for all and by question type.

    Pairs of equal signals are counted first; all figures, the medians too, come from those counts.
    """
    s = signals(pairs).select(F.coalesce("question_type", F.lit("?")).alias("question_type"), "is_trivial", "asks_reasoning", "legal_terms", "near_copy", "span_overlap")
    few = s.groupBy(*s.columns).agg(F.count("*").alias("c"))
    pct = lambda c: F.round(100 * F.sum(F.when(c, F.col("c")).otherwise(0)) / F.sum("c"), 4)
    middle = lambda c: F.percentile(c, F.lit(0.5), F.col("c"))
    aggs = [
        F.sum("c").alias("n"), pct(F.col("is_trivial")).alias("trivial_pct"), pct(F.col("asks_reasoning")).alias("reasoning_pct"), pct(F.col("legal_terms") == 0).alias("no_legal_pct"),
        middle("legal_terms").alias("median_legal_terms"), pct(F.col("near_copy")).alias("near_copy_pct"), middle("span_overlap").alias("median_overlap"),
    ]
    sets = [[], ["question_type"]] if by_type else [[]]
    out = few.groupingSets([[F.col(c) for c in x] for x in sets], F.col("question_type")).agg(F.grouping("question_type").alias("whole"), *aggs)
    return out.withColumn("question_type", F.when(F.col("whole") == 1, "(all)").otherwise(F.col("question_type"))).drop("whole")
