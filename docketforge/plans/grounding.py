"""Registered queries of verification, windows and pair quality, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketforge.functions import seams
from docketforge.functions import text as T
from docketforge.operators import diagnose, quality, verify, windows
from docketforge.plans import sqltext as S
from docketforge.sources.tables import table

pairs = lambda s, d: table(s, d, "pair_records")
opinions = lambda s, d: table(s, d, "cleaned_opinions")


def _verify(method):
    return lambda s, d: verify.hits(pairs(s, d), opinions(s, d)).select("pair_id", F.col(method).alias("hit"))


def _failure_rates(s, d):
    return verify.step_rates(verify.first_method(pairs(s, d), opinions(s, d)))


def _artefact(s, d):
    return verify.step_rates(verify.first_method(pairs(s, d), opinions(s, d), artefact=True), verify.METHODS)


def _word_offsets(s, d):
    return windows.word_offsets(opinions(s, d)).groupBy("row", "cluster_id").agg(F.count("*").alias("n_words"), F.max("start").alias("last_start"), F.sum("start").alias("start_sum")).drop("row")


def _chunk_windows(s, d):
    return windows.windows(opinions(s, d), snap=False, text=False)


def _chunk_bands(s, d):
    return s.range(1, 201).select(F.col("id").cast("int").alias("n_chunks")).withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1))).select("n_chunks", "chunk_index", windows.band(F.col("chunk_index"), F.col("n_chunks")).alias("position"))


def _grounding_totals(s, d):
    return T.share_of_all(verify.grounding(pairs(s, d), opinions(s, d)).groupBy("status").agg(F.count("*").alias("n")))


def _shared_run(s, d):
    return verify.longest_shared_run(pairs(s, d))


def _copy_filter(s, d):
    return verify.longest_shared_run(pairs(s, d)).select("pair_id", (F.col("longest_run") > quality.COPIED_RUN).alias("copies"))


def _reasons(s, d):
    return quality.validated(pairs(s, d), opinions(s, d)).groupBy("reason").agg(F.count("*").alias("n"))


def _elided(s, d):
    # A long span with its middle left out, as a writer would mark it; a short one as it is.
    span = T.blank(F.col("supporting_span"))
    cut = F.when(F.length(span) > 80, F.concat(F.substring(span, 1, 30), F.lit(" . . . "), F.substring(span, -30, 30))).otherwise(span)
    return verify.hits(pairs(s, d).withColumn("supporting_span", cut), opinions(s, d)).select("pair_id", F.col("word").alias("hit"))


def _elided_parts(s, d):
    span = F.concat(T.blank(F.col("supporting_span")), F.lit(" . . . "), T.blank(F.col("answer")))
    return pairs(s, d).select("pair_id", T.elided_parts(span).alias("parts"))


def _counterfactual(s, d):
    # A quotation with its sense changed must not be found by any of the methods, the tolerant one included.
    rows = pairs(s, d).where(T.blank(F.col("supporting_span")) != "").withColumn("supporting_span", verify.counterfactual(F.col("supporting_span")))
    return verify.first_method(rows, opinions(s, d), artefact=True).groupBy((F.col("step") < 4).alias("accepted")).agg(F.count("*").alias("n"))


def _altered(s, d):
    return pairs(s, d).where(T.blank(F.col("supporting_span")) != "").select("pair_id", verify.counterfactual(F.col("supporting_span")).alias("altered"))


def _flag_counts(s, d):
    return quality.signals(pairs(s, d)).select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def _signals(s, d):
    return quality.signals(pairs(s, d)).drop("flags")


def _thin_documents(s, d):
    n = windows.sizes(opinions(s, d)).groupBy("cluster_id").agg(F.sum(windows.number(F.col("total"), windows.WindowConfig())).cast("long").alias("chunks"))
    p = pairs(s, d).groupBy("cluster_id").agg(F.count("*").alias("pairs"))
    return n.join(p, "cluster_id", "left").withColumn("pairs", F.coalesce("pairs", F.lit(0))).where("chunks >= 3 AND pairs < 0.5 * chunks")


def _existing_quality(s, d):
    p = pairs(s, d)
    return p.agg(
        F.count("*").alias("n"), F.count_if(T.blank(F.trim("supporting_span")) == "").alias("missing_spans"), F.count_if(F.col("category").isNull()).alias("missing_category"),
        (F.count("*") - F.count_distinct(F.struct("cluster_id", "question"))).alias("duplicate_questions"),
    )


def _type_shares(s, d):
    by = pairs(s, d).groupBy("question_type").agg(F.count("*").alias("n"))
    out = T.share_of_all(by)
    return out.withColumn("warning", F.when((F.col("question_type") == "holding") & (F.col("pct") < 14), "few holdings").when(F.col("pct") > 70, "dominant"))


def _verification_report(s, d):
    """How each method fails, how pairs are validated, and how many failed pairs await review, as one tall table."""
    rates = verify.step_rates(verify.first_method(pairs(s, d), opinions(s, d))).select(F.concat(F.lit("failures "), F.col("method")).alias("figure"), F.col("failures").alias("n"))
    reasons = _reasons(s, d).select(F.concat(F.lit("validated "), F.col("reason")).alias("figure"), "n")
    review = rates.where("figure = 'failures word'").select(F.lit("review rows").alias("figure"), "n")
    return rates.unionByName(reasons).unionByName(review)


def _candidate_windows(s, d):
    w = windows.windows(opinions(s, d), snap=False, text=False)
    return pairs(s, d).select("pair_id", "cluster_id", "chunk_index").join(w, ["cluster_id", "chunk_index"]).select("pair_id", "chunk_index", "start_word", "end_word", "position")


def _divergence(s, d):
    return diagnose.divergences(pairs(s, d), opinions(s, d)).select("pair_id", "agree", "span_rest", "source_rest")


def _prompts(s, d):
    w = windows.windows(opinions(s, d)).join(opinions(s, d).select("cluster_id", "case_name", "date_filed", "citation"), "cluster_id")
    return w.select("cluster_id", "chunk_index", F.length(seams.pair_prompt(w)).alias("chars"), F.length("text").alias("passage_chars"), seams.preferred_types(F.col("position")).alias("types"))


def _baseline_prompts(s, d):
    return seams.baseline_prompts(pairs(s, d), opinions(s, d)).select("pair_id", "system", F.md5(F.col("prompt").cast("binary")).alias("prompt"))


def _span_answer_ratio(s, d):
    r = pairs(s, d).select(F.try_divide(T.word_count(F.col("supporting_span")), T.word_count(F.col("answer"))).alias("r")).where("r IS NOT NULL")
    return r.agg(
        F.count("*").alias("n"), *[F.round(T.at_share("r", x), 6).alias(f"p{round(100 * x)}") for x in (0.1, 0.5, 0.9)], F.round(F.avg("r"), 6).alias("mean"), F.round(F.avg((F.col("r") < 0.5).cast("int")), 6).alias("below_half")
    )


def _failure_classes(s, d):
    return diagnose.classes(pairs(s, d), opinions(s, d)).groupBy("failure").agg(F.count("*").alias("n"))


def _suggestions(s, d):
    return diagnose.suggestions(pairs(s, d), opinions(s, d)).select("pair_id", "pieces", "lost", "suggested")


def _class_rates(s, d):
    total = pairs(s, d).select("pair_id").distinct().count()
    return diagnose.class_rates(diagnose.classes(pairs(s, d), opinions(s, d)), "failure", total)


def _gap_kinds(s, d):
    return diagnose.between(pairs(s, d), opinions(s, d)).select("cluster_id", "gap_start", "gap_end", diagnose.gap_kind(F.col("gap")).alias("kind"))


def _reviewed(s, d):
    # Every tenth failed quotation was looked at by a person.
    rows = diagnose.suggestions(pairs(s, d), opinions(s, d))
    manual = rows.where("pair_id % 10 = 0").select("pair_id", F.lit("misquotation").alias("label")).distinct()
    return diagnose.labelled(rows, manual)


def _review_rates(s, d):
    total = pairs(s, d).select("pair_id").distinct().count()
    return diagnose.review_rates(_reviewed(s, d), total)


def _label_counts(s, d):
    # The labels of the checked step by themselves: what a person gave, else what the pair's own columns suggest.
    rows = pairs(s, d).select("pair_id", F.coalesce("question_type", F.lit("?")).alias("suggested"))
    manual = pairs(s, d).where("pair_id % 7 = 0").select("pair_id", F.lit("misquotation").alias("label")).distinct()
    return diagnose.labelled(rows, manual).groupBy("classification", "classified_by").agg(F.count("*").alias("n"))


def _dry_run(s, d):
    # Windows through the generator seam and the checks, end to end, with the quoting stand-in.
    made = seams.generate(windows.windows(opinions(s, d)), seams.QuotingGenerator()).withColumn("pair_id", F.xxhash64("cluster_id", "chunk_index"))
    return quality.validated(made, opinions(s, d)).groupBy("reason").agg(F.count("*").alias("n"))


def _chunk_snapped(s, d):
    return windows.windows(opinions(s, d), text=False)


QUERIES = {
    "verify_failure_rates": _failure_rates, "verify_exact": _verify("exact"), "verify_normalised": _verify("normalised"), "verify_word_sequence": _verify("word"), "verify_elided": _elided, "verify_artefact": _artefact, "verify_counterfactual": _counterfactual,
    "span_offsets": lambda s, d: verify.offsets(pairs(s, d), opinions(s, d)), "grounding_status": lambda s, d: verify.grounding(pairs(s, d), opinions(s, d)), "grounding_totals": _grounding_totals,
    "word_offsets": _word_offsets, "chunk_windows": _chunk_windows, "chunk_snapped": _chunk_snapped, "chunk_bands": _chunk_bands, "coverage_report": lambda s, d: windows.coverage_report(opinions(s, d)), "band_share": lambda s, d: windows.band_share(opinions(s, d)),
    "longest_shared_run": _shared_run, "copy_filter": _copy_filter, "validate_reasons": _reasons, "quality_signals": _signals, "quality_by_type": lambda s, d: quality.report(pairs(s, d)), "trivial_flags": _flag_counts,
    "yes_no_guard": lambda s, d: pairs(s, d).select("pair_id", T.starts_yes_no(F.col("answer")).alias("yes_no")), "overlap_ratio": lambda s, d: pairs(s, d).select("pair_id", F.round(T.overlap_ratio(F.col("answer"), F.col("supporting_span")), 6).alias("ratio")),
    "thin_documents": _thin_documents, "existing_quality": _existing_quality, "span_answer_ratio": _span_answer_ratio,
    "elided_parts": _elided_parts, "counterfactual_spans": _altered, "question_type_shares": _type_shares, "verification_report": _verification_report, "candidate_windows": _candidate_windows, "divergence_points": _divergence, "generation_prompts": _prompts, "baseline_prompts": _baseline_prompts,
    "review_rates": _review_rates, "reviewed_labels": _label_counts, "provenance_chain": lambda s, d: verify.provenance(pairs(s, d), opinions(s, d)), "marked_spans": lambda s, d: verify.marked(pairs(s, d), opinions(s, d)).select("pair_id", F.md5(F.col("marked").cast("binary")).alias("marked")),
    "failure_class": _failure_classes, "gap_suggestions": _suggestions, "failure_class_rates": _class_rates, "gap_kind": _gap_kinds, "generation_dry_run": _dry_run,
}

_BOTH = "pair_records p LEFT JOIN cleaned_opinions o USING (cluster_id)"
_SP = "coalesce(p.supporting_span, '')"
_WORDS = lambda x: f"' ' || array_to_string({S.words(x)}, ' ') || ' '"
# Opinions in their forms, made once: a correlated form would be made again for each pair.
_FORMS = f"forms AS MATERIALIZED (SELECT cluster_id, text, {S.normalised('text')} AS tn, {_WORDS('text')} AS tw, {S.ascii_stream('text')} AS ts FROM cleaned_opinions)"
_EXACT = f"coalesce({_SP} <> '' AND contains(f.text, {_SP}), false)"
_NORM = f"coalesce({S.normalised(_SP)} <> '' AND contains(f.tn, {S.normalised(_SP)}), false)"
_WORD = f"coalesce(len({S.words(_SP)}) > 0 AND contains(f.tw, {_WORDS(_SP)}), false)"
_HITS = f"WITH {_FORMS}, h AS (SELECT p.pair_id, {_EXACT} AS e, {_NORM} AS n, {_WORD} AS w FROM pair_records p LEFT JOIN forms f USING (cluster_id))"
_STATUS = f"""
WITH {_FORMS}, r AS (
  SELECT p.pair_id, f.text, f.ts, p.supporting_span AS sp, {S.ascii_stream('p.supporting_span')} AS b,
         CASE WHEN p.span_start >= 0 AND p.span_end > p.span_start THEN substring(f.text, CAST(p.span_start + 1 AS BIGINT), CAST(p.span_end - p.span_start AS BIGINT)) END AS piece
  FROM pair_records p LEFT JOIN forms f USING (cluster_id)
), g AS (
  SELECT pair_id, CASE WHEN text IS NULL THEN 'no opinion' WHEN piece = sp THEN 'exact'
    WHEN {S.ascii_stream('piece')} <> '' AND b <> '' AND (contains({S.ascii_stream('piece')}, b) OR contains(b, {S.ascii_stream('piece')})) THEN 'located'
    WHEN b <> '' AND contains(ts, substring(b, 1, 200)) THEN 'found' ELSE 'missing' END AS status FROM r
)"""
_DOCS = f"docs AS MATERIALIZED (SELECT cluster_id, regexp_replace(coalesce(text, ''), '^{T.SPACE}+|{T.SPACE}+$', '', 'g') AS text FROM cleaned_opinions), dw AS MATERIALIZED (SELECT cluster_id, length(text) AS chars, {S.word_count('text')} AS total FROM docs)"
_BAND = "CASE WHEN n_chunks = 1 THEN 'late' WHEN n_chunks = 2 THEN CASE WHEN chunk_index = 0 THEN 'early' ELSE 'late' END WHEN chunk_index < greatest(1, round_even(n_chunks * 0.15::DOUBLE, 0)) THEN 'early' WHEN chunk_index >= n_chunks - greatest(2, round_even(n_chunks * 0.20::DOUBLE, 0)) THEN 'late' ELSE 'middle' END"
_CHUNKS = f"""{_DOCS}, raw AS (SELECT cluster_id, total, CASE WHEN total <= 900 THEN 1 ELSE CAST(ceil((total - 900) / 750.0) AS INTEGER) + 1 END AS raw FROM dw WHERE total > 0),
n AS (SELECT cluster_id, total, CASE WHEN raw > 1 AND total - (raw - 1) * 750 < 200 THEN raw - 1 ELSE raw END AS n_chunks FROM raw),
c AS (SELECT cluster_id, total, n_chunks, CAST(unnest(range(n_chunks)) AS INTEGER) AS chunk_index FROM n),
b AS (SELECT cluster_id, total, n_chunks, chunk_index, chunk_index * 750 AS start_word, CASE WHEN chunk_index = n_chunks - 1 THEN total ELSE chunk_index * 750 + 900 END AS end_word, {_BAND} AS position FROM c)"""
# One row a word: its place, where it begins and how long it is. The words themselves are dropped at once.
_TOK = f"tk AS (SELECT cluster_id, unnest(regexp_extract_all(text, '{T.SOLID}+{T.SPACE}*')) AS t, unnest(range(len(regexp_extract_all(text, '{T.SOLID}+{T.SPACE}*')))) AS i FROM docs), tl AS (SELECT cluster_id, i, length(t) AS n, length(regexp_extract(t, '{T.SOLID}+')) AS w FROM tk), st AS MATERIALIZED (SELECT cluster_id, i, w, sum(n) OVER (PARTITION BY cluster_id ORDER BY i) - n AS off FROM tl)"
_RUN = f"""
WITH r AS (SELECT pair_id, row_number() OVER () AS u, {S.words('answer')} AS wa, {S.words('supporting_span')} AS wb FROM pair_records),
a AS (SELECT u, unnest(wa) AS w, unnest(range(len(wa))) AS i FROM r), b AS (SELECT u, unnest(wb) AS w, unnest(range(len(wb))) AS j FROM r),
m AS (SELECT a.u, i - j AS d, i FROM a JOIN b ON a.u = b.u AND a.w = b.w), s AS (SELECT u, d, i - row_number() OVER (PARTITION BY u, d ORDER BY i) AS g FROM m),
x AS (SELECT u, max(n) AS n FROM (SELECT u, d, g, count(*) AS n FROM s GROUP BY ALL) GROUP BY u), runs AS (SELECT r.pair_id, r.u, coalesce(x.n, 0) AS longest_run FROM r LEFT JOIN x USING (u))"""
_Q = "coalesce(question, '')"
_FLAGS = {k: f"regexp_matches({'trim(' + _Q + ')' if v.startswith('^') else _Q}, '(?i){v}')" for k, v in quality.TRIVIAL.items()}
_LEGAL = "len(list_filter(" + S.alpha("question") + ", lambda t: list_contains([" + ", ".join(f"'{w}'" for w in quality.LEGAL_TERMS) + "], t)))"
_SIGNALS = f"""sig AS (SELECT pair_id, question_type, ({' OR '.join(_FLAGS.values())}) AS is_trivial, regexp_matches({_Q}, '(?i){quality.REASONING}') AS asks_reasoning, {_LEGAL} AS legal_terms,
  round({_LEGAL} / greatest(len({S.alpha('question')}), 1), 3) AS legal_density, round({S.overlap_ratio('answer', 'supporting_span')}, 3) AS span_overlap, {S.overlap_ratio('answer', 'supporting_span')} > 0.85 AS near_copy,
  {S.word_count('question')} AS question_words, {S.word_count('answer')} AS answer_words FROM pair_records)"""
_REPORT = "count(*) AS n, round(100 * avg(is_trivial::INT), 4) AS trivial_pct, round(100 * avg(asks_reasoning::INT), 4) AS reasoning_pct, round(100 * avg((legal_terms = 0)::INT), 4) AS no_legal_pct, median(legal_terms) AS median_legal_terms, round(100 * avg(near_copy::INT), 4) AS near_copy_pct, median(span_overlap) AS median_overlap"
_CUT = f"CASE WHEN length({_SP}) > 80 THEN substring({_SP}, 1, 30) || ' . . . ' || right({_SP}, 30) ELSE {_SP} END"
# The first part anywhere, the second from the blank behind the first on.
_ELIDED = f"""WITH {_FORMS}, c AS (SELECT p.pair_id, length({_SP}) > 80 AS cut, {_WORDS(_CUT)} AS whole, {_WORDS(f'substring({_SP}, 1, 30)')} AS a, {_WORDS(f'right({_SP}, 30)')} AS b, f.tw FROM pair_records p LEFT JOIN forms f USING (cluster_id)),
q AS (SELECT *, instr(tw, a) AS pos FROM c)
SELECT pair_id, coalesce((trim(whole) <> '' AND contains(tw, whole)) OR (cut AND trim(a) <> '' AND trim(b) <> '' AND pos > 0 AND contains(substring(tw, pos + length(a) - 1), b)), false) AS hit FROM q"""
_PARTS = f"list_filter(list_transform(regexp_split_to_array({_SP} || ' . . . ' || coalesce(p.answer, ''), '\\.[ ]*\\.[ ]*\\.|…'), lambda x: {S.squeeze('x')}), lambda x: x <> '')"
_ALTER = lambda w: f"substring({_SP}, 1, instr({_SP}, '{w}') - 1) || ' ' || substring({_SP}, instr({_SP}, '{w}') + {len(w)})"
_MID = f"greatest(1, CAST(floor(len(string_split({S.squeeze(_SP)}, ' ')) / 2) AS BIGINT))"
_ALTERED = f"CASE WHEN contains({_SP}, ' not ') THEN {_ALTER(' not ')} WHEN contains({_SP}, ' no ') THEN {_ALTER(' no ')} ELSE array_to_string(list_concat(list_append(string_split({S.squeeze(_SP)}, ' ')[1:{_MID}], 'never'), string_split({S.squeeze(_SP)}, ' ')[{_MID} + 1:]), ' ') END"
_GAPS = """p AS (SELECT DISTINCT cluster_id, span_start, span_end FROM pair_records WHERE span_start >= 0 AND span_end > span_start AND cluster_id IS NOT NULL), n AS (SELECT *, lead(span_start) OVER (PARTITION BY cluster_id ORDER BY span_start, span_end) AS nx FROM p),
g AS (SELECT n.cluster_id, span_end AS gap_start, nx AS gap_end, substring(text, span_end + 1, nx - span_end) AS gap FROM n JOIN cleaned_opinions USING (cluster_id) WHERE nx - span_end > 2 AND nx <= length(text))"""
_SIGNS = lambda x: f"length(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
_Q1 = lambda x: x.replace("'", "''")
_KIND = f"""CASE WHEN contains(gap, '[') AND {_SIGNS("regexp_replace(gap, '\\[[^\\]]{0,40}\\]', '', 'g')")} <= 6 THEN 'editorial_brackets' WHEN regexp_matches(gap, '{diagnose.ENCODING}') AND {_SIGNS('gap')} <= 6 THEN 'encoding_artefact'
WHEN regexp_matches(gap, '{_Q1(diagnose.FURNITURE)}') OR regexp_matches(gap, '{diagnose.FOOTNOTE}') THEN 'page_furniture' WHEN regexp_matches(gap, '{diagnose.CITATION}') AND length(gap) < 400 THEN 'citation_omitted' ELSE 'prose_omitted' END"""
_STEPS = f"h2 AS (SELECT pair_id, CASE WHEN e THEN 0 WHEN n THEN 1 WHEN w THEN 2 ELSE 3 END AS step FROM h)"
_BLANK = f"p.supporting_span IS NOT NULL AND p.supporting_span <> ''"
_PROV = f"""WITH {_FORMS}, a AS (SELECT p.pair_id, p.cluster_id, o.case_name, o.citation, o.text, f.tn, f.tw, p.span_start AS st, coalesce(p.span_end, p.span_start) AS en, p.supporting_span AS sp, {_ALTERED} AS alt FROM pair_records p JOIN cleaned_opinions o USING (cluster_id) JOIN forms f USING (cluster_id) WHERE o.text IS NOT NULL),
b AS (SELECT *, CASE WHEN st >= 0 AND st < en AND en <= length(text) THEN substring(text, CAST(st + 1 AS BIGINT), CAST(en - st AS BIGINT)) END AS slice FROM a)
SELECT pair_id, cluster_id, case_name, citation, length(text) AS text_chars, {S.word_count('text')} AS text_words, round(100 * st / greatest(length(text), 1), 4) AS depth_pct, CASE WHEN st IS NOT NULL THEN greatest(0, st - 450) END AS window_start, CASE WHEN st IS NOT NULL THEN least(length(text), en + 450) END AS window_end, slice, coalesce(slice = sp, false) AS slice_is_span,
CASE WHEN coalesce(sp, '') <> '' AND contains(text, sp) THEN 0 WHEN coalesce({S.normalised('sp')} <> '' AND contains(tn, {S.normalised('sp')}), false) THEN 1 WHEN len({S.words('sp')}) > 0 AND contains(tw, {_WORDS('sp')}) THEN 2 ELSE 3 END AS found_step,
coalesce(coalesce(sp, '') <> '' AND instr(text, sp) > 0 AND instr(text, sp) - 1 = st AND instr(text, sp) - 1 + length(sp) = en, false) AS offsets_hold,
coalesce(coalesce(sp, '') <> '' AND (contains(text, alt) OR ({S.normalised('alt')} <> '' AND contains(tn, {S.normalised('alt')})) OR (len({S.words('alt')}) > 0 AND contains(tw, {_WORDS('alt')}))), false) AS altered_found,
contains(text, '{verify.FABRICATED}') OR contains(tn, '{verify.FABRICATED}') OR contains(tw, {_WORDS(f"'{verify.FABRICATED}'")}) AS fabricated_found FROM b"""
_DIV = f"""WITH c AS (SELECT p.pair_id, p.supporting_span AS sp, o.text FROM pair_records p JOIN cleaned_opinions o USING (cluster_id) WHERE {_BLANK} AND NOT contains(o.text, p.supporting_span)),
r AS (SELECT *, coalesce(list_max(list_filter(range(20, 401, 10), lambda n: n <= length(sp) AND contains(text, substring(sp, 1, n)))), 0) AS agree FROM c)
SELECT pair_id, CAST(agree AS INTEGER) AS agree, substring(sp, agree + 1, 60) AS span_rest, CASE WHEN agree > 0 THEN substring(text, instr(text, substring(sp, 1, agree)) + agree, 60) END AS source_rest FROM r"""
_TRIM = lambda c: f"coalesce(trim({c}), '')"

SQL = {
    "verify_exact": _HITS + " SELECT pair_id, e AS hit FROM h", "verify_normalised": _HITS + " SELECT pair_id, n AS hit FROM h", "verify_word_sequence": _HITS + " SELECT pair_id, w AS hit FROM h",
    "verify_failure_rates": _HITS + ", t AS (SELECT count(*) AS c, count(*) FILTER (WHERE NOT e) AS a, count(*) FILTER (WHERE NOT (e OR n)) AS b, count(*) FILTER (WHERE NOT (e OR n OR w)) AS d FROM h) "
    "SELECT 'exact' AS method, c AS candidates, a AS failures, round(100 * a / c, 4) AS failure_pct FROM t UNION ALL SELECT 'normalised', c, b, round(100 * b / c, 4) FROM t UNION ALL SELECT 'word', c, d, round(100 * d / c, 4) FROM t",
    "verify_elided": _ELIDED, "elided_parts": f"SELECT pair_id, CASE WHEN len({_PARTS}) > 1 THEN {_PARTS} ELSE [] END AS parts FROM pair_records p", "counterfactual_spans": f"SELECT pair_id, {_ALTERED} AS altered FROM pair_records p WHERE {_BLANK}",
    "gap_kind": f"WITH {_GAPS} SELECT cluster_id, gap_start, gap_end, {_KIND} AS kind FROM g", "provenance_chain": _PROV, "divergence_points": _DIV,
    "marked_spans": "SELECT pair_id, md5(substring(text, 1, CAST(span_start AS BIGINT)) || '>>> ' || substring(text, CAST(span_start + 1 AS BIGINT), CAST(span_end - span_start AS BIGINT)) || ' <<<' || substring(text, CAST(span_end + 1 AS BIGINT))) AS marked FROM pair_records p JOIN cleaned_opinions o USING (cluster_id) WHERE span_start >= 0 AND span_start < span_end AND span_end <= length(text)",
    "reviewed_labels": "SELECT CASE WHEN pair_id % 7 = 0 THEN 'misquotation' ELSE coalesce(question_type, '?') END AS classification, CASE WHEN pair_id % 7 = 0 THEN 'person' ELSE 'suggestion' END AS classified_by, count(*) AS n FROM pair_records GROUP BY 1, 2",
    "question_type_shares": "WITH b AS (SELECT question_type, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM pair_records), 4) AS pct FROM pair_records GROUP BY 1) SELECT *, CASE WHEN question_type = 'holding' AND pct < 14 THEN 'few holdings' WHEN pct > 70 THEN 'dominant' END AS warning FROM b",
    "span_offsets": f"SELECT p.pair_id, CASE WHEN {_SP} <> '' AND instr(o.text, {_SP}) > 0 THEN instr(o.text, {_SP}) - 1 END AS found_start, CASE WHEN {_SP} <> '' AND instr(o.text, {_SP}) > 0 THEN instr(o.text, {_SP}) - 1 + length({_SP}) END AS found_end, "
    "coalesce(p.span_start >= 0 AND p.span_end > p.span_start AND substring(o.text, CAST(p.span_start + 1 AS BIGINT), CAST(p.span_end - p.span_start AS BIGINT)) = p.supporting_span, false) AS offset_holds FROM pair_records p JOIN cleaned_opinions o USING (cluster_id)",
    "grounding_status": _STATUS + " SELECT * FROM g", "grounding_totals": _STATUS + " SELECT status, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM g), 4) AS pct FROM g GROUP BY status",
    "word_offsets": f"WITH {_DOCS}, {_TOK} SELECT cluster_id, count(*) AS n_words, CAST(max(off) AS BIGINT) AS last_start, CAST(sum(off) AS BIGINT) AS start_sum FROM st GROUP BY cluster_id",
    "chunk_windows": f"WITH {_CHUNKS}, {_TOK} SELECT b.cluster_id, chunk_index, n_chunks, start_word, end_word, CASE WHEN n_chunks = 1 THEN 0 ELSE CAST(s.off AS BIGINT) END AS char_start, CASE WHEN end_word >= b.total THEN dw.chars ELSE CAST(e.off AS BIGINT) + e.w END AS char_end, position "
    "FROM b JOIN dw USING (cluster_id) JOIN st s ON s.cluster_id = b.cluster_id AND s.i = start_word JOIN st e ON e.cluster_id = b.cluster_id AND e.i = end_word - 1",
    "chunk_bands": f"WITH c AS (SELECT CAST(n AS INTEGER) AS n_chunks, CAST(unnest(range(n)) AS INTEGER) AS chunk_index FROM range(1, 201) t(n)) SELECT n_chunks, chunk_index, {_BAND} AS position FROM c",
    "band_share": f"WITH {_CHUNKS} SELECT position, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM b), 4) AS pct FROM b GROUP BY position",
    "coverage_report": f"WITH {_CHUNKS}, p AS (SELECT cluster_id, count(*) AS n, max(total) AS words, max(end_word) AS e, count(*) FILTER (WHERE position = 'early') AS ea, count(*) FILTER (WHERE position = 'middle') AS mi, count(*) FILTER (WHERE position = 'late') AS la FROM b GROUP BY cluster_id) "
    "SELECT count(*) AS opinions, sum(n) AS chunks, list_sort(list(n))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median_chunks, max(n) AS max_chunks, sum(ea) AS early, sum(mi) AS middle, sum(la) AS late, sum(words) AS words, round(100 * sum(e) / sum(words), 1) AS coverage_pct FROM p",
    "longest_shared_run": _RUN + " SELECT pair_id, longest_run FROM runs", "copy_filter": _RUN + " SELECT pair_id, longest_run > 10 AS copies FROM runs",
    "validate_reasons": _RUN.replace("FROM pair_records)", ", * EXCLUDE (pair_id) FROM pair_records)", 1).replace("WITH r AS", f"WITH {_FORMS}, r AS", 1)
    + f""", v AS (SELECT CASE WHEN {S.word_count('question')} = 0 OR {S.word_count('answer')} = 0 OR {S.word_count('supporting_span')} = 0 THEN 'empty_field' WHEN {S.word_count('question')} NOT BETWEEN 8 AND 45 THEN 'question_length'
    WHEN {S.word_count('answer')} NOT BETWEEN 15 AND 90 THEN 'answer_length' WHEN {S.starts_yes_no('answer')} THEN 'yes_no_answer' WHEN NOT coalesce(question_type IN ('facts','procedural','legal_principle','holding','outcome'), false) THEN 'bad_question_type'
    WHEN NOT coalesce({S.normalised('supporting_span')} <> '' AND contains(f.tn, {S.normalised('supporting_span')}), false) THEN 'span_not_found' WHEN longest_run > 10 THEN 'answer_copies_span' WHEN length({S.squeeze('supporting_span')}) < 40 THEN 'span_too_short' ELSE 'ok' END AS reason
    FROM r JOIN runs USING (u) LEFT JOIN forms f USING (cluster_id)) SELECT reason, count(*) AS n FROM v GROUP BY reason""",
    "yes_no_guard": f"SELECT pair_id, {S.starts_yes_no('answer')} AS yes_no FROM pair_records", "overlap_ratio": f"SELECT pair_id, round({S.overlap_ratio('answer', 'supporting_span')}, 6) AS ratio FROM pair_records",
    "quality_signals": f"WITH {_SIGNALS} SELECT * FROM sig", "trivial_flags": " UNION ALL ".join(f"SELECT '{k}' AS flag, count(*) AS n FROM pair_records WHERE {v} HAVING count(*) > 0" for k, v in _FLAGS.items()),
    "quality_by_type": f"WITH {_SIGNALS} SELECT '(all)' AS question_type, {_REPORT} FROM sig UNION ALL SELECT coalesce(question_type, '?'), {_REPORT} FROM sig GROUP BY coalesce(question_type, '?')",
    "thin_documents": f"WITH {_CHUNKS}, n2 AS (SELECT cluster_id, count(*) AS chunks FROM b GROUP BY 1), p AS (SELECT cluster_id, count(*) AS pairs FROM pair_records GROUP BY 1) SELECT n2.cluster_id, chunks, coalesce(pairs, 0) AS pairs FROM n2 LEFT JOIN p USING (cluster_id) WHERE chunks >= 3 AND coalesce(pairs, 0) < 0.5 * chunks",
    "existing_quality": f"SELECT count(*) AS n, count(*) FILTER (WHERE {_TRIM('supporting_span')} = '') AS missing_spans, count(*) FILTER (WHERE category IS NULL) AS missing_category, count(*) - (SELECT count(*) FROM (SELECT DISTINCT cluster_id, question FROM pair_records)) AS duplicate_questions FROM pair_records",
    "span_answer_ratio": f"WITH r AS (SELECT {S.word_count('supporting_span')} / nullif({S.word_count('answer')}, 0) AS r FROM pair_records), v AS (SELECT list_sort(list(r)) AS v, count(r) AS n, avg(r) AS m, count(*) FILTER (WHERE r < 0.5) AS low FROM r WHERE r IS NOT NULL) "
    "SELECT n, round(v[CAST(floor(n * 0.1) AS BIGINT) + 1], 6) AS p10, round(v[CAST(floor(n * 0.5) AS BIGINT) + 1], 6) AS p50, round(v[CAST(floor(n * 0.9) AS BIGINT) + 1], 6) AS p90, round(m, 6) AS mean, round(low / n, 6) AS below_half FROM v",
}
SQL["verification_report"] = (
    SQL["validate_reasons"].replace("SELECT reason, count(*) AS n FROM v GROUP BY reason", "", 1).rstrip()
    + f""", h AS (SELECT p.pair_id, {_EXACT} AS e, {_NORM} AS n, {_WORD} AS w FROM pair_records p LEFT JOIN forms f USING (cluster_id)), {_STEPS}
SELECT 'failures exact' AS figure, count(*) FILTER (WHERE step > 0) AS n FROM h2 UNION ALL SELECT 'failures normalised', count(*) FILTER (WHERE step > 1) FROM h2 UNION ALL SELECT 'failures word', count(*) FILTER (WHERE step > 2) FROM h2
UNION ALL SELECT 'review rows', count(*) FILTER (WHERE step > 2) FROM h2 UNION ALL SELECT 'validated ' || reason, count(*) FROM v GROUP BY reason"""
)
SQL["candidate_windows"] = f"WITH {_CHUNKS} SELECT p.pair_id, p.chunk_index, b.start_word, b.end_word, b.position FROM pair_records p JOIN b ON b.cluster_id = p.cluster_id AND b.chunk_index = p.chunk_index"
