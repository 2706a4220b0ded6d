"""Registered queries of corpus building, joins, splits and sampling, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketforge.functions import text as T
from docketforge.functions import udfs
from docketforge.operators import corpus, splitting
from docketforge.plans import sqltext as S
from docketforge.sources.tables import table

clusters = lambda s, d: table(s, d, "clusters")
subs = lambda s, d: table(s, d, "sub_opinions")
cases = lambda s, d: table(s, d, "scdb_cases")
opinions = lambda s, d: table(s, d, "cleaned_opinions")
pairs = lambda s, d: table(s, d, "pair_records")


def _annotated(lenient):
    return lambda s, d: corpus.annotate(corpus.latest_clusters(clusters(s, d)), cases(s, d), lenient)


def _match_share(s, d):
    return T.share_of_all(_annotated(True)(s, d).groupBy(F.coalesce("matched", F.lit("none")).alias("matched")).agg(F.count("*").alias("n")))


def _unmatched_by_year(s, d):
    a = _annotated(True)(s, d).where("matched IS NULL").select("cluster_id")
    return corpus.latest_clusters(clusters(s, d)).join(a, "cluster_id").groupBy(F.substring("date_filed", 1, 4).alias("year")).agg(F.count("*").alias("n"))


def _backfill(s, d):
    hit = _annotated(True)(s, d).select("cluster_id", "area")
    rows = opinions(s, d).join(hit, "cluster_id", "left")
    state = F.when(F.col("area").isNull(), "unresolved").when(F.col("category") == F.col("area"), "already").otherwise("filled")
    return rows.select("cluster_id", F.coalesce("area", "category").alias("category"), state.alias("state"))


def _null_fill(s, d):
    known = opinions(s, d).select("cluster_id", F.col("category").alias("known"))
    return pairs(s, d).join(known, "cluster_id", "left").select("pair_id", F.coalesce(F.nullif(F.col("category"), F.lit("")), F.col("known")).alias("category"))


def _best_per_case(s, d):
    words = subs(s, d).groupBy("cluster_id").agg(F.sum(T.word_count(F.col("text"))).alias("words"))
    rows = _annotated(True)(s, d).where("caseid IS NOT NULL").join(words, "cluster_id").join(corpus.latest_clusters(clusters(s, d)).select("cluster_id", "date_filed"), "cluster_id")
    return corpus.keep_one(rows, "caseid", [F.desc("words"), F.asc_nulls_last("date_filed"), "cluster_id"]).select("caseid", "cluster_id", "words")


def _primary(s, d):
    rows = corpus.with_opinions(clusters(s, d), subs(s, d)).select("cluster_id", corpus.primary().alias("p"))
    return rows.select("cluster_id", F.col("p.opinion_id").alias("opinion_id"), F.col("p.word_count").alias("words"))


def _secondary_types(s, d):
    rows = corpus.with_opinions(clusters(s, d), subs(s, d))
    other = F.filter("sub_opinions", lambda x: ~x["type"].isin(*corpus.PRIMARY_TYPES))
    return rows.select(F.explode(other).alias("x")).groupBy(F.col("x.type").alias("type")).agg(F.count("*").alias("n"))


def _gates(s, d):
    return corpus.gates(clusters(s, d), subs(s, d)).groupBy("reason").agg(F.count("*").alias("n"))


def _removed_share(s, d):
    return corpus.removed_share(corpus.gates(clusters(s, d), subs(s, d)))


def _upper_median(s, d):
    return opinions(s, d).select(T.word_count(F.col("text")).alias("w")).agg(F.min("w").alias("least"), T.upper_median("w").alias("median"), F.max("w").alias("most"))


def _binding_share(s, d):
    return opinions(s, d).agg(F.round(100 * (1 - F.sum("word_count") / F.sum("source_word_count")), 4).alias("non_binding_pct"))


def _clean_text(s, d):
    return subs(s, d).select("opinion_id", T.clean_text(F.col("text")).alias("text"))


def _clean_nfkc(s, d):
    return subs(s, d).select("opinion_id", T.clean_text(udfs.nfkc("text")).alias("text"))


def _passages(s, d):
    p = pairs(s, d).select("pair_id", "cluster_id", "span_start", "span_end").join(opinions(s, d).select("cluster_id", "text"), "cluster_id")
    return p.select("pair_id", corpus.passage(F.col("span_start"), F.col("span_end"), F.col("text")).alias("passage"))


def _sections(s, d):
    rows = subs(s, d).select("opinion_id", "text", F.posexplode(udfs.segmented("text")).alias("i", "s"))
    return rows.select("opinion_id", "i", "s.start", "s.end", "s.kind", "s.author", T.word_count(F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))).alias("words"))


def _boundaries(s, d):
    return opinions(s, d).select("cluster_id", udfs.separate_boundary("text").alias("cut_at"))


def _audited_pairs(s, d):
    cuts = _boundaries(s, d).where("cut_at IS NOT NULL")
    return corpus.drop_excluded_pairs(pairs(s, d), corpus.audit(opinions(s, d), cases(s, d)), cuts).groupBy("split").agg(F.count("*").alias("pairs"))


def _section_kinds(s, d):
    return opinions(s, d).select(F.explode("section_kinds").alias("kind", "n")).groupBy("kind").agg(F.sum("n").alias("n"))


def _deduped(s, d):
    return corpus.keep_one(clusters(s, d), "cluster_id", ["ingested_at", "case_name"]).select("cluster_id", "case_name", "ingested_at")


def _latest(s, d):
    return corpus.latest_clusters(clusters(s, d)).select("cluster_id", "case_name", "ingested_at")


def _resume(s, d):
    done = pairs(s, d).where("load_id < 3").select("cluster_id", "chunk_index").distinct()
    return pairs(s, d).join(done, ["cluster_id", "chunk_index"], "left_anti").select("pair_id", "cluster_id", "chunk_index")


def _members(s, d):
    wanted = opinions(s, d).where("n_secondary > 0").select("cluster_id")
    return pairs(s, d).join(wanted, "cluster_id", "left_semi").select("pair_id")


def _upsert(s, d):
    # Labels of the first load carry over to the rows of later loads with the same document, window and quotation.
    keys = ["cluster_id", "chunk_index", "supporting_span"]
    rows = pairs(s, d).select(*keys, "pair_id", "load_id", "question_type")
    old = corpus.keep_one(rows.where("load_id = 1"), keys, ["pair_id", F.asc_nulls_last("question_type")]).select(*keys, F.col("question_type").alias("label"))
    return rows.where("load_id > 1").join(old, keys, "left").select("pair_id", "load_id", "label")


def _top_categories(s, d):
    by = opinions(s, d).groupBy(F.coalesce("category", F.lit("uncoded")).alias("category")).agg(F.count("*").alias("n"))
    from pyspark.sql.window import Window

    # A category has one row here; the window ranks a handful of them.
    r = by.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "category")))
    return r.groupBy(F.when(F.col("r") <= 6, F.col("category")).otherwise("other").alias("category")).agg(F.sum("n").alias("n"))


def _groups(s, d):
    return splitting.stratified_groups(pairs(s, d), "cluster_id", "category")


def _split_disjoint(s, d):
    g = _groups(s, d)
    part = lambda x: g.where(F.col("split") == x).select("cluster_id")
    both = part("train").intersect(part("val")).union(part("train").intersect(part("test"))).union(part("val").intersect(part("test")))
    return both.agg(F.count("*").alias("shared"))


def _group_leakage(s, d):
    rows = pairs(s, d).join(_groups(s, d).select("cluster_id", F.col("split").alias("new")), "cluster_id")
    train = rows.where("new = 'train'").select("cluster_id").distinct().withColumn("hit", F.lit(1))
    test = rows.where("new = 'test'").join(train, "cluster_id", "left")
    return test.agg(F.count("*").alias("test_pairs"), F.count("hit").alias("leaked"))


def _case_words(s, d):
    return clusters(s, d).where(T.case_matches(["united", "states"], F.col("case_name"), F.col("court"))).select("cluster_id", "ingested_at")


QUERIES = {
    "fallback_join_lenient": _annotated(True), "fallback_join_strict": _annotated(False), "match_share": _match_share, "unmatched_by_year": _unmatched_by_year, "backfill_left": _backfill, "null_only_fill": _null_fill, "best_per_key": _best_per_case,
    "first_wins_dedup": _deduped, "last_wins_dedup": _latest, "resume_anti_join": _resume, "semi_join_members": _members, "review_upsert": _upsert, "primary_argmax": _primary, "secondary_types": _secondary_types,
    "gate_reasons": _gates, "words_removed_share": _removed_share, "record_problems": lambda s, d: corpus.record_problems(opinions(s, d)), "audit_reasons": lambda s, d: corpus.audit(opinions(s, d), cases(s, d)), "audited_pairs": _audited_pairs,
    "upper_median": _upper_median, "binding_share": _binding_share, "year_counts": lambda s, d: opinions(s, d).groupBy(F.substring("date_filed", 1, 4).alias("year")).agg(F.count("*").alias("n")),
    "name_key": lambda s, d: clusters(s, d).select("cluster_id", "ingested_at", T.name_key(F.col("case_name")).alias("name_key")), "citation_key": lambda s, d: clusters(s, d).select("cluster_id", "ingested_at", T.citation_key(F.col("citation")).alias("citation_key")),
    "clean_text": _clean_text, "clean_text_nfkc": _clean_nfkc, "html_text": lambda s, d: table(s, d, "documents").select("doc_id", T.without_tags(F.concat(F.lit("<p class='x'>"), F.col("text"), F.lit("</p><br/>"))).alias("text")),
    "passage_slice": _passages, "extractive_answer": lambda s, d: opinions(s, d).select("cluster_id", corpus.extractive_answer(F.col("text")).alias("answer")), "segment_sections": _sections, "separate_boundary": _boundaries, "section_kind_totals": _section_kinds,
    "topk_other": _top_categories, "stratified_split": _groups, "split_disjoint": _split_disjoint, "split_profile": lambda s, d: splitting.split_profile(pairs(s, d)), "leakage_pair_level": lambda s, d: splitting.leakage(pairs(s, d)), "leakage_group_level": _group_leakage,
    "seeded_sample": lambda s, d: splitting.seeded_sample(pairs(s, d), "pair_id", 100), "floor_assignment": lambda s, d: splitting.floor_assignment(pairs(s, d), "pair_id", "cluster_id"), "case_word_match": _case_words,
}

_LATEST = "lc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY ingested_at DESC, case_name) AS rn FROM clusters) WHERE rn = 1)"
_AREA = "CASE trim(issuearea) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in corpus.AREAS.items()) + " END"
_DIM = lambda name, key: f"{name} AS (SELECT k, caseid, {_AREA} AS area FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY caseid) AS rn FROM (SELECT *, {key} AS k FROM scdb_cases) WHERE k IS NOT NULL) WHERE rn = 1)"
_ANN = f"""{_LATEST}, {_DIM('dc', S.citation_key('uscite'))}, {_DIM('dn', f"nullif({S.name_key('casename')}, '')")},
k AS (SELECT cluster_id, {S.citation_key('citation')} AS ck, nullif({S.name_key('case_name')}, '') AS nk FROM lc),
ann AS (SELECT cluster_id, ck, coalesce(dc.caseid, dn.caseid) AS caseid, CASE WHEN dc.caseid IS NOT NULL THEN dc.area ELSE dn.area END AS area, CASE WHEN dc.caseid IS NOT NULL THEN 'citation' WHEN dn.caseid IS NOT NULL THEN 'case_name' END AS matched
FROM k LEFT JOIN dc ON dc.k = k.ck LEFT JOIN dn ON dn.k = k.nk)"""
_PRIM = "('" + "', '".join(corpus.PRIMARY_TYPES) + "')"
_SUBS = f"{_LATEST}, so AS (SELECT DISTINCT ON (cluster_id, opinion_id) cluster_id, opinion_id, opinion_type, text, {S.word_count('text')} AS words FROM sub_opinions WHERE coalesce(text, '') <> '')"
_MD5 = lambda *x: "md5(concat_ws('#', '42', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in x) + "))"
_GROUPS = f"""g0 AS (SELECT cluster_id, min(coalesce(category, 'uncoded')) AS category FROM pair_records WHERE cluster_id IS NOT NULL GROUP BY 1),
g1 AS (SELECT *, count(*) OVER (PARTITION BY category) AS n, row_number() OVER (PARTITION BY category ORDER BY {_MD5('cluster_id')}, cluster_id) AS r FROM g0),
grp AS (SELECT cluster_id, category, CASE WHEN n < 5 OR r <= round_even(n * 0.8::DOUBLE, 0) THEN 'train' WHEN r <= round_even(n * 0.8::DOUBLE, 0) + round_even(n * 0.1::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM g1)"""
_NEED = {c: f"CASE WHEN coalesce({c}, '') = '' THEN 'missing {c}' END" for c in ("case_name", "date_filed", "court", "primary_type", "text")}

SQL = {
    "fallback_join_lenient": f"WITH {_ANN} SELECT cluster_id, caseid, area, matched FROM ann", "fallback_join_strict": f"WITH {_ANN} SELECT cluster_id, caseid, area, matched FROM ann WHERE matched = 'citation' OR (matched = 'case_name' AND ck IS NULL)",
    "match_share": f"WITH {_ANN} SELECT coalesce(matched, 'none') AS matched, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM ann), 4) AS pct FROM ann GROUP BY 1",
    "unmatched_by_year": f"WITH {_ANN} SELECT substring(date_filed, 1, 4) AS year, count(*) AS n FROM ann JOIN lc USING (cluster_id) WHERE matched IS NULL GROUP BY 1",
    "backfill_left": f"WITH {_ANN} SELECT o.cluster_id, coalesce(area, category) AS category, CASE WHEN area IS NULL THEN 'unresolved' WHEN category = area THEN 'already' ELSE 'filled' END AS state FROM cleaned_opinions o LEFT JOIN ann USING (cluster_id)",
    "null_only_fill": "SELECT p.pair_id, coalesce(nullif(p.category, ''), o.category) AS category FROM pair_records p LEFT JOIN cleaned_opinions o USING (cluster_id)",
    "best_per_key": f"WITH {_ANN}, w AS (SELECT cluster_id, CAST(sum({S.word_count('text')}) AS BIGINT) AS words FROM sub_opinions GROUP BY 1) SELECT caseid, cluster_id, words FROM (SELECT caseid, cluster_id, words, row_number() OVER (PARTITION BY caseid ORDER BY words DESC, date_filed NULLS LAST, cluster_id) AS rn FROM ann JOIN w USING (cluster_id) JOIN lc USING (cluster_id) WHERE caseid IS NOT NULL) WHERE rn = 1",
    "first_wins_dedup": "SELECT cluster_id, case_name, ingested_at FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY ingested_at, case_name) AS rn FROM clusters) WHERE rn = 1", "last_wins_dedup": f"WITH {_LATEST} SELECT cluster_id, case_name, ingested_at FROM lc",
    "resume_anti_join": "SELECT pair_id, cluster_id, chunk_index FROM pair_records p WHERE NOT EXISTS (SELECT 1 FROM pair_records q WHERE q.load_id < 3 AND q.cluster_id = p.cluster_id AND q.chunk_index = p.chunk_index)",
    "semi_join_members": "SELECT pair_id FROM pair_records WHERE cluster_id IN (SELECT cluster_id FROM cleaned_opinions WHERE n_secondary > 0)",
    "review_upsert": "SELECT p.pair_id, p.load_id, o.question_type AS label FROM pair_records p LEFT JOIN (SELECT * FROM (SELECT cluster_id, chunk_index, supporting_span, question_type, row_number() OVER (PARTITION BY cluster_id, chunk_index, supporting_span ORDER BY pair_id, question_type NULLS LAST) AS rn FROM pair_records WHERE load_id = 1 AND cluster_id IS NOT NULL AND chunk_index IS NOT NULL AND supporting_span IS NOT NULL) WHERE rn = 1) o USING (cluster_id, chunk_index, supporting_span) WHERE p.load_id > 1",
    "primary_argmax": f"WITH {_SUBS}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY words DESC, opinion_id) AS rn FROM so WHERE opinion_type IN {_PRIM}) SELECT lc.cluster_id, r.opinion_id, r.words FROM lc JOIN (SELECT DISTINCT cluster_id FROM so) x USING (cluster_id) LEFT JOIN r ON r.cluster_id = lc.cluster_id AND r.rn = 1",
    "secondary_types": f"WITH {_SUBS} SELECT opinion_type AS type, count(*) AS n FROM so JOIN lc USING (cluster_id) WHERE opinion_type NOT IN {_PRIM} GROUP BY 1",
    "record_problems": f"SELECT cluster_id, list_filter([{', '.join(_NEED.values())}, CASE WHEN coalesce(date_filed, '') <> '' AND NOT regexp_matches(date_filed, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN 'date not ISO' END, CASE WHEN abs(coalesce(word_count, 0) - {S.word_count('text')}) > 1 THEN 'word count' END, CASE WHEN coalesce(primary_type, '') <> '' AND primary_type NOT IN {_PRIM} THEN 'separate writing' END], lambda x: x IS NOT NULL) AS problems FROM cleaned_opinions",
    "audit_reasons": f"WITH dd AS (SELECT caseid, max(try_strptime(datedecision, '%-m/%-d/%Y')) AS decided FROM scdb_cases GROUP BY 1) SELECT o.cluster_id, list_filter([CASE WHEN abs(date_diff('day', CAST(decided AS DATE), CAST(try_strptime(date_filed, '%Y-%m-%d') AS DATE))) > 60 THEN 'wrong_case' END, CASE WHEN regexp_matches(substring(text, 1, 3000), '{corpus.NOT_MERITS}') THEN 'not_merits' END, CASE WHEN map_keys(section_kinds) = ['majority'] AND n_secondary > 0 THEN 'unsegmented' END], lambda x: x IS NOT NULL) AS reasons FROM cleaned_opinions o LEFT JOIN dd ON dd.caseid = o.scdb_id",
    "upper_median": f"WITH w AS (SELECT {S.word_count('text')} AS w FROM cleaned_opinions) SELECT min(w) AS least, list_sort(list(w))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median, max(w) AS most FROM w",
    "binding_share": "SELECT round(100 * (1 - sum(word_count) / sum(source_word_count)), 4) AS non_binding_pct FROM cleaned_opinions", "year_counts": "SELECT substring(date_filed, 1, 4) AS year, count(*) AS n FROM cleaned_opinions GROUP BY 1",
    "name_key": f"SELECT cluster_id, ingested_at, {S.name_key('case_name')} AS name_key FROM clusters", "citation_key": f"SELECT cluster_id, ingested_at, {S.citation_key('citation')} AS citation_key FROM clusters",
    "clean_text": f"SELECT opinion_id, {S.clean_text('text')} AS text FROM sub_opinions", "html_text": "SELECT doc_id, " + S.squeeze("regexp_replace(coalesce('<p class=''x''>' || text || '</p><br/>', ''), '<[^>]+>', ' ', 'g')") + " AS text FROM documents",
    "passage_slice": "SELECT p.pair_id, CASE WHEN p.span_start IS NULL OR p.span_end IS NULL THEN substring(o.text, 1, 1800) ELSE substring(o.text, CAST(greatest(0, p.span_start - 900) + 1 AS BIGINT), CAST(greatest(0, least(length(o.text), p.span_end + 900) - greatest(0, p.span_start - 900)) AS BIGINT)) END AS passage FROM pair_records p JOIN cleaned_opinions o USING (cluster_id)",
    "section_kind_totals": "SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest(map_keys(section_kinds)) AS kind, unnest(map_values(section_kinds)) AS n FROM cleaned_opinions) GROUP BY 1",
    "topk_other": "WITH b AS (SELECT coalesce(category, 'uncoded') AS category, count(*) AS n FROM cleaned_opinions GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, category) AS r FROM b) SELECT CASE WHEN r <= 6 THEN category ELSE 'other' END AS category, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1",
    "stratified_split": f"WITH {_GROUPS} SELECT * FROM grp", "split_disjoint": f"WITH {_GROUPS} SELECT count(*) AS shared FROM (SELECT cluster_id FROM grp GROUP BY 1 HAVING count(DISTINCT split) > 1)",
    "split_profile": "SELECT split, CASE WHEN grouping(qt) = 0 THEN qt END AS question_type, CASE WHEN grouping(cat) = 0 THEN cat END AS category, count(*) AS pairs, count(DISTINCT cluster_id) AS groups FROM (SELECT split, coalesce(question_type, 'uncoded') AS qt, coalesce(category, 'uncoded') AS cat, cluster_id FROM pair_records) GROUP BY GROUPING SETS ((split), (split, qt), (split, cat))",
    "leakage_pair_level": "WITH b AS (SELECT DISTINCT pair_id AS k, cluster_id AS g FROM pair_records), r AS (SELECT t AS trial, g, ('0x' || substring(md5('42#' || t || '#' || k), 1, 8))::UBIGINT / 4294967296.0::DOUBLE < 0.1 AS is_test FROM b, range(20) x(t)), p AS (SELECT trial, g, count(*) FILTER (WHERE is_test) AS t, count(*) FILTER (WHERE NOT is_test) AS r FROM r GROUP BY ALL) SELECT CAST(trial AS INTEGER) AS trial, CAST(sum(t) AS BIGINT) AS test_pairs, CAST(sum(CASE WHEN g IS NOT NULL AND r > 0 THEN t ELSE 0 END) AS BIGINT) AS leaked, round(sum(CASE WHEN g IS NOT NULL AND r > 0 THEN t ELSE 0 END) / sum(t), 6) AS share FROM p GROUP BY 1",
    "leakage_group_level": f"WITH {_GROUPS} SELECT count(*) AS test_pairs, count(*) FILTER (WHERE cluster_id IN (SELECT cluster_id FROM grp WHERE split = 'train')) AS leaked FROM pair_records JOIN grp USING (cluster_id) WHERE grp.split = 'test'",
    "seeded_sample": f"SELECT pair_id FROM (SELECT DISTINCT pair_id FROM pair_records) ORDER BY {_MD5('pair_id')}, pair_id LIMIT 100",
    "floor_assignment": f"WITH r AS (SELECT DISTINCT pair_id, cluster_id FROM pair_records), o AS (SELECT pair_id, coalesce(lead(pair_id) OVER w, first_value(pair_id) OVER w) AS other FROM r WINDOW w AS (PARTITION BY cluster_id ORDER BY {_MD5('pair_id')}, pair_id)) SELECT pair_id, CASE WHEN other <> pair_id THEN other END AS other FROM o",
    "case_word_match": r"SELECT cluster_id, ingested_at FROM clusters WHERE regexp_matches(lower(coalesce(case_name, '') || ' ' || coalesce(court, '')), '\bunited\b') AND regexp_matches(lower(coalesce(case_name, '') || ' ' || coalesce(court, '')), '\bstates\b')",
    # Sentences are counted up in their order; the one that reaches the words is the last.
    "extractive_answer": rf"WITH s AS (SELECT cluster_id, unnest(string_split(regexp_replace({S.squeeze("coalesce(text, '')")}, '([.!?]) ', '\1' || chr(1), 'g'), chr(1))) AS x, generate_subscripts(string_split(regexp_replace({S.squeeze("coalesce(text, '')")}, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), 1) AS i FROM cleaned_opinions), r AS (SELECT *, sum({S.word_count('x')}) OVER (PARTITION BY cluster_id ORDER BY i) - {S.word_count('x')} AS before FROM s) SELECT cluster_id, string_agg(x, ' ' ORDER BY i) FILTER (WHERE before < 40) AS answer FROM r GROUP BY 1",
}
