"""Registered queries of readers, sinks and small steps between them, on files written from the fixtures, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T_

from docketforge.functions import seams, udfs
from docketforge.functions import text as T
from docketforge.operators import corpus, splitting
from docketforge.plans import sqltext as S
from docketforge.session import scratch
from docketforge.sources import paged, readers
from docketforge.sources.tables import table
from docketforge.streaming import incremental

clusters = lambda s, d: table(s, d, "clusters")
subs = lambda s, d: table(s, d, "sub_opinions")
cases = lambda s, d: table(s, d, "scdb_cases")
opinions = lambda s, d: table(s, d, "cleaned_opinions")
pairs = lambda s, d: table(s, d, "pair_records")

_PAIR = "pair_id long, question string, answer string, split string"


def _schema(ddl: str) -> T_.StructType:
    return T_.StructType.fromDDL(ddl)


def _broken_lines(s, d) -> str:
    """The pairs as JSON lines among blank and broken ones."""
    one = F.to_json(F.struct("pair_id", "question", "answer", "split", F.lit("x").alias("unknown")), {"ignoreNullFields": "false"})
    lines = pairs(s, d).select(F.explode(F.array(one, F.when(F.col("pair_id") % 5 == 0, F.concat(F.substring(one, 1, 20), F.lit(" ..."))).otherwise(""))).alias("value"))
    path = scratch(s, "lines")
    lines.write.text(path)
    return path


def _jsonl_scan(s, d):
    return readers.read_jsonl(s, _broken_lines(s, d), _schema(_PAIR))


def _required(s, d):
    rows = readers.read_jsonl(s, _broken_lines(s, d), _schema(_PAIR))
    return readers.require_columns(rows, ("pair_id", "answer")).agg(F.count("*").alias("n"))


def _optional(s, d):
    path = _broken_lines(s, d)
    both = readers.read_optional(s, path, _schema(_PAIR)).unionByName(readers.read_optional(s, path + "-missing", _schema(_PAIR)))
    return both.agg(F.count("*").alias("n"))


def _round_trip(s, d):
    path = scratch(s, "round-trip")
    readers.write_jsonl(pairs(s, d).select("pair_id", "supporting_span", "span_start", "generator_temperature"), path)
    return readers.read_jsonl(s, path, _schema("pair_id long, supporting_span string, span_start long, generator_temperature double"), strict=True)


def _resumed_append(s, d):
    # A run that ended after the even keys, taken up again twice.
    path, rows = scratch(s, "append"), pairs(s, d).select("cluster_id", "question").where("question IS NOT NULL AND cluster_id IS NOT NULL").distinct()
    readers.append_missing(rows.where("cluster_id % 2 = 0"), path, ["cluster_id", "question"])
    for _ in range(2):
        readers.append_missing(rows, path, ["cluster_id", "question"])
    return readers.read_jsonl(s, path, _schema("cluster_id long, question string"))


def _authority(s, d, years=None):
    path = scratch(s, "authority")
    names = {"caseid": "caseId", "casename": "caseName", "uscite": "usCite", "issuearea": "issueArea", "datedecision": "dateDecision", "term": "term"}
    cases(s, d).withColumnsRenamed(names).select(*names.values()).orderBy("caseId").write.option("header", "true").option("encoding", "ISO-8859-1").option("escape", '"').csv(path)
    return readers.read_authority_csv(s, path, years=years, positions=True)


def _authority_first(s, d):
    return corpus.authority(_authority(s, d).withColumnRenamed("usCite", "uscite").withColumnRenamed("caseId", "caseid"), "citation", "__position").select("key", "caseid", "area")


def _authority_years(s, d):
    return _authority(s, d, (1980, 1999)).select("caseId", "dateDecision")


def _authority_by_id(s, d):
    # Every third id comes again with blanks around it and another name; the last of a key stands.
    a = _authority(s, d)
    again = a.where(F.col("caseId") >= "1980").select(F.concat(F.lit(" "), F.col("caseId")).alias("caseId"), F.lit("again").alias("caseName"), F.struct(F.lit("~").alias("file"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("line")).alias("__position"))
    both = a.select("caseId", "caseName", "__position").unionByName(again)
    return readers.by_id(both).groupBy((F.col("caseName") == "again").alias("replaced")).agg(F.count("*").alias("n"))


def _targets(s, d):
    return readers.targets(_authority(s, d), (1900, 2100))


def _parts(s, d):
    base, c = scratch(s, "parts"), clusters(s, d)
    for i, path in enumerate(readers.part_paths(base, 3)):
        part = c.where(F.pmod("cluster_id", F.lit(3)) == i)
        (part.drop("judges") if i == 2 else part).write.parquet(path)
    rows = readers.read_parts(s, readers.part_paths(base, 3))
    supreme = F.lower("court").like("%supreme court of the united%") & F.col("date_filed").between("1900-01-01", "2100-12-31")
    return rows.where(supreme).orderBy("date_filed").select("cluster_id", "case_name", "date_filed", "court", "citation", "judges", "docket_id", "ingested_at")


def _probe(s, d):
    names = {"bigint": "BIGINT", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "int": "INTEGER", "boolean": "BOOLEAN"}
    kinds = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return readers.probe(subs(s, d)).select("column_name", F.element_at(kinds, F.col("column_type")).alias("column_type"))


def _category_index(s, d):
    rows = opinions(s, d).select("cluster_id", "category", F.lit(None).cast("string").alias("scdb_category"), F.lit("0").alias("p"))
    later = clusters(s, d).select("cluster_id", F.lit(None).cast("string").alias("category"), "scdb_category", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("p"))
    return readers.category_index(rows.unionByName(later), "cluster_id", "p")


def _nested(s, d):
    path = scratch(s, "nested")
    one = F.to_json(F.struct("cluster_id", "case_name", "sub_opinions", F.lit(1).alias("unknown")))
    corpus.with_opinions(clusters(s, d), subs(s, d)).select(one.alias("value")).write.text(path)
    schema = "cluster_id long, case_name string, syllabus string, sub_opinions array<struct<opinion_id: long, type: string, word_count: int, missing: string>>"
    rows = readers.read_jsonl(s, path, _schema(schema))
    return rows.select("cluster_id", F.col("syllabus").isNull().alias("filled"), F.explode("sub_opinions").alias("o")).select("cluster_id", "filled", "o.opinion_id", "o.type", "o.word_count")


def _report(s, d):
    path = f"{scratch(s, 'report')}/splits.json"
    readers.write_report(pairs(s, d).groupBy("split").agg(F.count("*").alias("pairs"), F.count_distinct("cluster_id").alias("groups")).orderBy("split"), path)
    return readers.read_report(s, path, _schema("split string, pairs long, groups long"))


def _rewritten(s, d):
    path = f"{scratch(s, 'rewrite')}/t"
    opinions(s, d).select("cluster_id", "category").write.parquet(path)
    for label in ("first", "second"):
        readers.rewrite(s, s.read.parquet(path).withColumn("category", F.coalesce("category", F.lit(label))), path)
    return s.read.parquet(path).groupBy(F.coalesce("category", F.lit("none")).alias("category")).agg(F.count("*").alias("n")).withColumn("kept", F.lit(s.read.parquet(f"{path}.bak").where("category IS NULL").count()))


def _split_files(s, d):
    base = scratch(s, "splits")
    readers.write_splits_with_report(pairs(s, d).select("pair_id", "cluster_id", "split"), base)
    data = s.read.schema("pair_id long, cluster_id long, split string").json(f"{base}/data").groupBy("split").agg(F.count("*").alias("rows"))
    return data.join(readers.read_report(s, f"{base}/report.json", _schema("split string, pairs long, groups long")), "split")


def _export(s, d):
    path = scratch(s, "export")
    known = opinions(s, d).select("cluster_id", F.col("case_name").alias("o_name"), F.col("date_filed").alias("o_date"), "text")
    both = pairs(s, d).where("split = 'test'").join(known, "cluster_id")
    first = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))
    rows = both.select("pair_id", "load_id", first("case_name", "o_name").alias("case_name"), first("date_filed", "o_date").alias("date_filed"), corpus.passage(F.col("span_start"), F.col("span_end"), F.col("text")).alias("passage"))
    readers.write_jsonl(rows, path)
    return readers.read_jsonl(s, path, _schema("pair_id long, load_id long, case_name string, date_filed string, passage string"))


def _paged(s, d, hide=None, **options):
    pages = paged.ParquetPages(f"{d}/cleaned_opinions.parquet", "cluster_id", "date_filed", ("cluster_id", "date_filed", "case_name"), hide)
    return paged.read_paged(s, pages, "cluster_id long, date_filed string, case_name string", paged.year_windows("1900-06-01", "2100-02-01"), size="7", **options)


def _lookup(s, d):
    # As a lookup answers: for a citation every cluster that has it, with its opinions.
    n = subs(s, d).select("cluster_id", "opinion_id").distinct().groupBy("cluster_id").agg(F.count("*").alias("n"))
    rows = corpus.latest_clusters(clusters(s, d)).join(n, "cluster_id").select(T.citation_key(F.col("citation")).alias("key"), "cluster_id", "n")
    return paged.best_of_lookup(rows, "key", "cluster_id", F.col("n"))


def _access_paths(s, d):
    rows = [(n, batched, *paged.access_path(n, batched)) for n in (1, 8, 9, 50, 400, 5000) for batched in (False, True)]
    return s.createDataFrame(rows, "wanted long, batched boolean, path string, calls long")


def _year_windows(s, d):
    return s.createDataFrame(paged.year_windows("1998-03-05", "2003-11-30"), "first string, last string")


def _mapped(s, d):
    m = corpus.mapped(clusters(s, d), subs(s, d))
    return m.select("cluster_id", "case_name", "court", "citation", "per_curiam", F.size("sub_opinions").alias("opinions"), F.aggregate("sub_opinions", F.lit(0), lambda a, x: a + x["word_count"]).alias("words"))


def _citations(s, d):
    parallel = F.array(F.lit("93 S. Ct. 705"), F.col("citation"), F.lit("35 L. Ed. 2d 147"))
    parts = F.array(F.struct(F.regexp_extract("citation", "([0-9]+)", 1).alias("volume"), F.lit("U.S.").alias("reporter"), F.lit(7).alias("page")))
    written = F.when(F.col("citation").isNotNull(), corpus.written_citation(parts))
    return clusters(s, d).select("cluster_id", "ingested_at", corpus.first_official(parallel).alias("official"), written.alias("written"), corpus.author_of(F.col("judges"), F.col("docket_id")).alias("author"))


def _first_telling(s, d):
    fields = {"plain_text": F.substring("text", 1, 120), "html": F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>"))}
    return subs(s, d).select("opinion_id", F.md5(T.first_telling(fields).cast("binary")).alias("text"))


def _revisions(s, d):
    name = F.when(F.col("cluster_id") % 4 == 0, F.concat(F.lit("Revision : "), "case_name")).otherwise(F.col("case_name"))
    return clusters(s, d).withColumn("case_name", name).where(~corpus.revisions(F.col("case_name"))).select("cluster_id", "ingested_at")


def _gate_chain(s, d):
    """The gates on records that know their sections already."""
    from pyspark.sql.window import Window

    again = F.row_number().over(Window.partitionBy("citation").orderBy("cluster_id")) > 1
    k = lambda x: F.coalesce(F.col("section_kinds")[x], F.lit(0))
    o = opinions(s, d).withColumn("again", F.col("citation").isNotNull() & again)
    unsound = (T.blank(F.col("case_name")) == "") | ~F.coalesce(F.col("date_filed").rlike(corpus.ISO), F.lit(False))
    reason = corpus.gate(F.col("again"), F.col("primary_type").isNull(), k("majority") + k("per_curiam"), F.col("word_count"), F.col("date_filed"), unsound)
    return o.select("cluster_id", reason.alias("reason"), F.col("source_word_count").alias("words"), F.col("word_count").alias("kept_words"))


def _cuts(s, d):
    """A cut of each document by its recorded spans: behind the last one."""
    return pairs(s, d).where("span_end > 0").groupBy("cluster_id").agg(F.max("span_end").alias("cut_at"))


def _trim(s, d):
    t = corpus.trimmed(opinions(s, d), corpus.audit(opinions(s, d), cases(s, d)), _cuts(s, d))
    return t.select("cluster_id", "reasons", "cut_at", F.md5(F.col("text").cast("binary")).alias("text"), "words_kept", "words_removed")


def _audited_documents(s, d):
    cuts = opinions(s, d).select("cluster_id", udfs.separate_boundary("text").alias("cut_at"))
    t = corpus.trimmed(opinions(s, d), corpus.audit(opinions(s, d), cases(s, d)), cuts)
    return t.select(F.when(F.size("reasons") > 0, "excluded").when(F.col("cut_at").isNotNull(), "trimmed").otherwise("whole").alias("state")).groupBy("state").agg(F.count("*").alias("n"))


def _cut_pairs(s, d):
    half = _cuts(s, d).select("cluster_id", F.floor(F.col("cut_at") / 2).alias("cut_at"))
    return corpus.drop_excluded_pairs(pairs(s, d), corpus.audit(opinions(s, d), cases(s, d)), half).select("pair_id", "load_id")


def _summaries(s, d):
    return subs(s, d).select("opinion_id", udfs.section_summary("text").alias("s")).select("opinion_id", "s.n_sections", "s.binding_words", "s.total_words", "s.confident", F.map_entries("s.kinds").alias("kinds"))


def _matcher_words(s, d):
    w = T.words(F.col("text"))
    return opinions(s, d).select("cluster_id", F.size(w).alias("n"), F.md5(F.array_join(w, " ").cast("binary")).alias("words"))


def _json_replies(s, d):
    """Replies as models give them: fenced, with prose around, cut short, without the list, without an object."""
    one = F.to_json(F.struct(F.array(F.struct("question", "answer", "question_type", "supporting_span")).alias("qa_pairs")), {"ignoreNullFields": "false"})
    kind = F.col("pair_id") % 5
    reply = F.when(kind == 0, F.concat(F.lit("Here it is:\n```json\n"), one, F.lit("\n```"))).when(kind == 1, F.concat(one, F.lit("\nThat's all."))).when(kind == 2, F.concat(F.lit('{"qa_pairs": [{"question": '), F.to_json(F.struct("question")))).when(kind == 3, F.lit('{"pairs": []}')).otherwise("I found nothing.")
    replies = seams.parsed(pairs(s, d).select("pair_id", reply.alias("reply")))
    return replies.select("pair_id", "state", F.try_element_at("pairs", F.lit(1))["question"].alias("question"), F.try_element_at("pairs", F.lit(1))["supporting_span"].alias("supporting_span"))


def _positions(s, d):
    rows = opinions(s, d).select("cluster_id", "case_name")
    verdicts = s.range(0, 40, 3).select(F.col("id").alias("position"), F.concat(F.lit("v"), "id").alias("verdict"))
    return corpus.by_position(rows, ["cluster_id"], verdicts).select("cluster_id", "position", "verdict")


def _sheets(s, d):
    sheet = lambda low, high, by: pairs(s, d).where(F.col("load_id").between(low, high)).select("pair_id", "load_id", F.lit(by).alias("sheet"))
    return sheet(1, 2, "first").unionByName(sheet(3, 4, "second")).groupBy("sheet").agg(F.count("*").alias("n"), F.count_distinct("pair_id").alias("pairs"))


def _examples(s, d):
    rows = pairs(s, d).select(F.coalesce("question_type", F.lit("?")).alias("question_type"), "pair_id").distinct()
    return corpus.examples(rows, "question_type", "pair_id").select("question_type", "pair_id", "example")


def _cover(s, d):
    g = splitting.stratified_groups(pairs(s, d), "cluster_id", "category")
    parts = [g.where(F.col("split") == x).select("cluster_id") for x in ("train", "val", "test")]
    return splitting.uncovered(parts, pairs(s, d).select("cluster_id").where("cluster_id IS NOT NULL").distinct())


def _excluded(s, d):
    return corpus.excluded(corpus.audit(opinions(s, d), cases(s, d)), ["wrong_case", "not_merits"]).select("cluster_id")


def _kind_counts(s, d):
    return opinions(s, d).select("cluster_id", F.explode(corpus.kind_counts(F.col("secondary_types"))).alias("kind", "n"))


def _valve(s, d):
    return incremental.safety_valve(subs(s, d), 50).agg(F.count("*").alias("n"))


QUERIES = {
    "jsonl_scan": _jsonl_scan, "required_fields": _required, "optional_scan": _optional, "jsonl_round_trip": _round_trip, "jsonl_resumed_append": _resumed_append, "authority_first_wins": _authority_first, "authority_years": _authority_years, "authority_by_id": _authority_by_id, "authority_targets": _targets,
    "parts_scan": _parts, "schema_probe": _probe, "top_groups": lambda s, d: readers.top_groups(clusters(s, d), ["court", "precedential_status", "scdb_category"]), "category_index": _category_index, "nested_scan": _nested, "json_report": _report, "rewritten_table": _rewritten, "split_files": _split_files, "release_export": _export,
    "paged_scan": lambda s, d: _paged(s, d), "paged_refetch": lambda s, d: _paged(s, d, "case_name", text="case_name", id="cluster_id"), "lookup_best": _lookup, "access_paths": _access_paths, "year_windows": _year_windows, "cluster_mapping": _mapped, "citation_forms": _citations, "first_telling_text": _first_telling, "revision_filter": _revisions,
    "missing_categories": lambda s, d: corpus.without_category(pairs(s, d)), "gate_chain": _gate_chain, "gated_words_removed": lambda s, d: corpus.removed_share(_gate_chain(s, d)), "audit_trim": _trim, "audited_documents": _audited_documents, "cut_pairs": _cut_pairs, "segment_summary": _summaries,
    "sanitised_text": lambda s, d: subs(s, d).select("opinion_id", F.md5(T.sanitised(F.concat("text", F.lit("\u0001￾"))).cast("binary")).alias("text")), "blanked_marks": lambda s, d: opinions(s, d).select("cluster_id", F.md5(T.blanked(F.col("text")).cast("binary")).alias("text")),
    "char_stream": lambda s, d: opinions(s, d).select("cluster_id", F.md5(T.stream(F.col("text")).cast("binary")).alias("stream")), "matcher_words": _matcher_words, "json_replies": _json_replies, "position_verdicts": _positions, "verdict_sheets": _sheets, "class_examples": _examples,
    "inner_val_split": lambda s, d: splitting.inner_val(pairs(s, d).where("split = 'train'"), "cluster_id"), "splits_cover": _cover, "missing_documents": lambda s, d: pairs(s, d).select("cluster_id").subtract(opinions(s, d).select("cluster_id")), "excluded_documents": _excluded, "kind_counts": _kind_counts,
    "stream_staged_join": incremental.staged_opinions, "stream_guard": incremental.guarded_pairs, "safety_valve": _valve,
}

_LATEST = "lc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY ingested_at DESC, case_name) AS rn FROM clusters) WHERE rn = 1)"
_SO = f"so AS (SELECT DISTINCT ON (cluster_id, opinion_id) cluster_id, opinion_id, nullif(trim(opinion_type), '') AS type, {S.word_count('text')} AS word_count FROM sub_opinions WHERE coalesce(text, '') <> '')"
_AREA = "CASE trim(issuearea) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in corpus.AREAS.items()) + " END"
_AUDIT = f"dd AS (SELECT caseid, max(try_strptime(datedecision, '%-m/%-d/%Y')) AS decided FROM scdb_cases GROUP BY 1), au AS (SELECT o.cluster_id, list_filter([CASE WHEN abs(date_diff('day', CAST(decided AS DATE), CAST(try_strptime(date_filed, '%Y-%m-%d') AS DATE))) > 60 THEN 'wrong_case' END, CASE WHEN regexp_matches(substring(text, 1, 3000), '{corpus.NOT_MERITS}') THEN 'not_merits' END, CASE WHEN map_keys(section_kinds) = ['majority'] AND n_secondary > 0 THEN 'unsegmented' END], lambda x: x IS NOT NULL) AS reasons FROM cleaned_opinions o LEFT JOIN dd ON dd.caseid = o.scdb_id)"
_CUTS = "cu AS (SELECT cluster_id, max(span_end) AS cut_at FROM pair_records WHERE span_end > 0 GROUP BY 1)"
_TIDY = lambda c: f"nullif(trim({c}), '')"
_GATES = """gt AS (SELECT cluster_id, CASE WHEN citation IS NOT NULL AND row_number() OVER (PARTITION BY citation ORDER BY cluster_id) > 1 THEN 'duplicate' WHEN primary_type IS NULL THEN 'no_primary'
WHEN coalesce(section_kinds['majority'], 0) + coalesce(section_kinds['per_curiam'], 0) < 1 THEN 'no_binding' WHEN coalesce(section_kinds['majority'], 0) + coalesce(section_kinds['per_curiam'], 0) > 1 THEN 'low_confidence' WHEN word_count < 500 THEN 'too_short' WHEN word_count > 80000 THEN 'too_long'
WHEN coalesce(date_filed, '') = '' THEN 'missing_date' WHEN coalesce(case_name, '') = '' OR NOT coalesce(regexp_matches(date_filed, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'), false) THEN 'failed_validation' ELSE 'kept' END AS reason, source_word_count AS words, word_count AS kept_words FROM cleaned_opinions)"""
_TIDY_TEXT = lambda x: rf"regexp_replace(regexp_replace(regexp_replace({x}, '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{T.SPACE}+|{T.SPACE}+$', '', 'g')"
_CITE = r"([0-9]+) *U\.?S\.? *([0-9]+)"
_ORDER = lambda c: f"md5(concat_ws('#', '42', CAST({c} AS VARCHAR)))"
_KIND5 = "pair_id % 5"

SQL = {
    "jsonl_scan": "SELECT pair_id, question, answer, split FROM pair_records", "required_fields": "SELECT count(*) AS n FROM pair_records", "optional_scan": "SELECT count(*) AS n FROM pair_records",
    "jsonl_round_trip": "SELECT pair_id, supporting_span, span_start, generator_temperature FROM pair_records", "jsonl_resumed_append": "SELECT DISTINCT cluster_id, question FROM pair_records WHERE question IS NOT NULL AND cluster_id IS NOT NULL",
    "authority_first_wins": f"SELECT key, caseid, area FROM (SELECT {S.citation_key('uscite')} AS key, caseid, {_AREA} AS area, row_number() OVER (PARTITION BY {S.citation_key('uscite')} ORDER BY caseid) AS rn FROM scdb_cases) WHERE key IS NOT NULL AND rn = 1",
    "authority_years": "SELECT caseid AS \"caseId\", datedecision AS \"dateDecision\" FROM scdb_cases WHERE try_cast(regexp_extract(coalesce(datedecision, ''), '/([0-9]{4})$', 1) AS INTEGER) BETWEEN 1980 AND 1999",
    "authority_by_id": "SELECT caseid >= '1980' AS replaced, count(*) AS n FROM scdb_cases WHERE trim(coalesce(caseid, '')) <> '' GROUP BY 1",
    "authority_targets": f"WITH r AS (SELECT caseid, replace(coalesce(uscite, ''), 'U. S.', 'U.S.') AS c, try_cast(regexp_extract(coalesce(datedecision, ''), '/([0-9]{{4}})$', 1) AS INTEGER) AS year, trim(issuearea) AS area FROM scdb_cases) SELECT caseid, regexp_extract(c, '{_CITE}', 1) || ' U.S. ' || regexp_extract(c, '{_CITE}', 2) AS us_cite, year, area FROM r WHERE regexp_matches(c, '{_CITE}') AND year BETWEEN 1900 AND 2100",
    "parts_scan": "SELECT cluster_id, case_name, date_filed, court, citation, CASE WHEN cluster_id % 3 <> 2 THEN judges END AS judges, docket_id, ingested_at FROM clusters WHERE lower(court) LIKE '%supreme court of the united%' AND date_filed BETWEEN '1900-01-01' AND '2100-12-31'",
    "schema_probe": "SELECT column_name, column_type FROM (DESCRIBE sub_opinions)", "top_groups": "SELECT court, precedential_status, scdb_category, count(*) AS n FROM clusters GROUP BY ALL ORDER BY n DESC, court NULLS FIRST, precedential_status NULLS FIRST, scdb_category NULLS FIRST LIMIT 15",
    "category_index": "WITH r AS (SELECT cluster_id, nullif(category, '') AS category, TIMESTAMP '1900-01-01' AS p FROM cleaned_opinions UNION ALL SELECT cluster_id, nullif(scdb_category, ''), ingested_at FROM clusters) SELECT cluster_id, category FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY p DESC, category DESC) AS rn FROM r WHERE category IS NOT NULL AND cluster_id IS NOT NULL) WHERE rn = 1",
    "nested_scan": f"WITH {_LATEST}, {_SO} SELECT cluster_id, true AS filled, opinion_id, type, word_count FROM so JOIN lc USING (cluster_id)", "json_report": "SELECT split, count(*) AS pairs, count(DISTINCT cluster_id) AS groups FROM pair_records GROUP BY 1",
    "rewritten_table": "SELECT coalesce(category, 'first') AS category, count(*) AS n, (SELECT count(*) FROM cleaned_opinions WHERE category IS NULL) AS kept FROM cleaned_opinions GROUP BY 1", "split_files": "SELECT split, count(*) AS rows, count(*) AS pairs, count(DISTINCT cluster_id) AS groups FROM pair_records GROUP BY 1",
    "release_export": "SELECT p.pair_id, p.load_id, coalesce(nullif(p.case_name, ''), o.case_name) AS case_name, coalesce(nullif(p.date_filed, ''), o.date_filed) AS date_filed, CASE WHEN p.span_start IS NULL OR p.span_end IS NULL THEN substring(o.text, 1, 1800) ELSE substring(o.text, CAST(greatest(0, p.span_start - 900) + 1 AS BIGINT), CAST(greatest(0, least(length(o.text), p.span_end + 900) - greatest(0, p.span_start - 900)) AS BIGINT)) END AS passage FROM pair_records p JOIN cleaned_opinions o USING (cluster_id) WHERE p.split = 'test'",
    "paged_scan": "SELECT cluster_id, date_filed, case_name FROM cleaned_opinions WHERE date_filed BETWEEN '1900-06-01' AND '2100-02-01'", "paged_refetch": "SELECT cluster_id, date_filed, case_name FROM cleaned_opinions WHERE date_filed BETWEEN '1900-06-01' AND '2100-02-01'",
    "lookup_best": f"WITH {_LATEST}, n AS (SELECT cluster_id, count(DISTINCT opinion_id) AS n FROM sub_opinions GROUP BY 1), r AS (SELECT {S.citation_key('citation')} AS key, cluster_id, n FROM lc JOIN n USING (cluster_id)) SELECT key, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, cluster_id) AS rn FROM r WHERE key IS NOT NULL) q WHERE rn = 1",
    "access_paths": "WITH w AS (SELECT CAST(n AS BIGINT) AS wanted, b AS batched FROM (VALUES (1), (8), (9), (50), (400), (5000)) a(n), (VALUES (true), (false)) c(b)), x AS (SELECT *, CAST(CASE WHEN batched THEN ceil(wanted / 20) ELSE wanted END AS BIGINT) AS l, greatest(8, CAST(ceil(3 * wanted / 20) AS BIGINT)) AS s FROM w) SELECT wanted, batched, CASE WHEN l <= s THEN 'lookup' ELSE 'scan' END AS path, least(l, s) AS calls FROM x",
    "year_windows": "SELECT greatest('1998-03-05', y || '-01-01') AS first, least('2003-11-30', y || '-12-31') AS last FROM range(1998, 2004) t(y)",
    "cluster_mapping": f"WITH {_LATEST}, {_SO}, f AS (SELECT cluster_id, coalesce(bool_or(per_curiam), false) AS per_curiam FROM sub_opinions GROUP BY 1), n AS (SELECT cluster_id, count(*) AS opinions, sum(word_count) AS words FROM so GROUP BY 1) SELECT cluster_id, {_TIDY('case_name')} AS case_name, {_TIDY('court')} AS court, {_TIDY('citation')} AS citation, per_curiam, opinions, words FROM lc JOIN n USING (cluster_id) JOIN f USING (cluster_id)",
    "citation_forms": r"SELECT cluster_id, ingested_at, CASE WHEN regexp_matches(citation, '^\s*[0-9]+\s+U\.\s?S\.\s+[0-9]+') THEN trim(citation) END AS official, CASE WHEN citation IS NOT NULL THEN regexp_extract(citation, '([0-9]+)', 1) || ' U.S. 7' END AS written, coalesce(nullif(judges, ''), nullif(CAST(docket_id AS VARCHAR), '0')) AS author FROM clusters",
    "first_telling_text": f"WITH t AS (SELECT opinion_id, {_TIDY_TEXT('''substring(coalesce(text, ''), 1, 120)''')} AS a, {_TIDY_TEXT('''regexp_replace('<p>' || text || '</p>', '<[^>]+>', ' ', 'g')''')} AS b FROM sub_opinions) SELECT opinion_id, md5(CASE WHEN {S.word_count('a')} >= 50 THEN a WHEN {S.word_count('b')} >= 50 THEN b ELSE '' END) AS text FROM t",
    "revision_filter": "SELECT cluster_id, ingested_at FROM clusters WHERE NOT (cluster_id % 4 = 0 AND case_name IS NOT NULL)", "missing_categories": "SELECT count(*) AS groups, count(*) FILTER (WHERE c IS NULL) AS lacking FROM (SELECT cluster_id, max(nullif(category, '')) AS c FROM pair_records GROUP BY 1)",
    "gate_chain": f"WITH {_GATES} SELECT * FROM gt", "gated_words_removed": f"WITH {_GATES} SELECT CAST(sum(greatest(0, words - kept_words)) FILTER (WHERE reason NOT IN ('duplicate', 'no_primary')) AS BIGINT) AS removed, CAST(sum(words) FILTER (WHERE reason = 'kept') AS BIGINT) AS source_words, round(100 * removed / source_words, 1) AS pct FROM gt",
    "audit_trim": f"""WITH {_AUDIT}, {_CUTS}, r AS (SELECT o.cluster_id, text, reasons, cut_at, len(reasons) = 0 AND cut_at IS NOT NULL AS sound, regexp_replace(substring(text, 1, cut_at), '{T.SPACE}+$', '') AS head FROM cleaned_opinions o JOIN au USING (cluster_id) LEFT JOIN cu USING (cluster_id)),
q AS (SELECT *, CASE WHEN sound THEN {S.word_count('head')} END AS kept, coalesce(sound AND {S.word_count('head')} < 500, false) AS short FROM r) SELECT cluster_id, CASE WHEN short THEN ['below_min_words_after_trim'] ELSE reasons END AS reasons, CASE WHEN sound AND NOT short THEN cut_at END AS cut_at, md5(CASE WHEN sound AND NOT short THEN head ELSE text END) AS text, kept AS words_kept, CASE WHEN sound THEN {S.word_count('substring(text, cut_at + 1)')} END AS words_removed FROM q""",
    "cut_pairs": f"WITH {_AUDIT}, {_CUTS} SELECT pair_id, load_id FROM pair_records p LEFT JOIN au USING (cluster_id) LEFT JOIN cu USING (cluster_id) WHERE coalesce(len(reasons), 0) = 0 AND (cut_at IS NULL OR span_end <= floor(cut_at / 2))",
    "sanitised_text": f"SELECT opinion_id, md5({S.sanitised('text || chr(1) || chr(65534)')}) AS text FROM sub_opinions", "blanked_marks": f"SELECT cluster_id, md5({S.blanked('text')}) AS text FROM cleaned_opinions", "char_stream": f"SELECT cluster_id, md5({S.stream('text')}) AS stream FROM cleaned_opinions",
    "matcher_words": f"SELECT cluster_id, len({S.words('text')}) AS n, md5(array_to_string({S.words('text')}, ' ')) AS words FROM cleaned_opinions",
    "json_replies": f"SELECT pair_id, CASE WHEN {_KIND5} IN (0, 1) THEN 'ok' WHEN {_KIND5} = 3 THEN 'no_pairs' ELSE 'broken' END AS state, CASE WHEN {_KIND5} IN (0, 1) THEN question END AS question, CASE WHEN {_KIND5} IN (0, 1) THEN supporting_span END AS supporting_span FROM pair_records",
    "position_verdicts": "WITH r AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) - 1 AS position FROM cleaned_opinions) SELECT cluster_id, position, CASE WHEN position < 40 AND position % 3 = 0 THEN 'v' || position END AS verdict FROM r",
    "verdict_sheets": "SELECT CASE WHEN load_id <= 2 THEN 'first' ELSE 'second' END AS sheet, count(*) AS n, count(DISTINCT pair_id) AS pairs FROM pair_records WHERE load_id BETWEEN 1 AND 4 GROUP BY 1",
    "class_examples": "SELECT question_type, pair_id, CAST(example AS INTEGER) AS example FROM (SELECT *, row_number() OVER (PARTITION BY question_type ORDER BY pair_id) AS example FROM (SELECT DISTINCT coalesce(question_type, '?') AS question_type, pair_id FROM pair_records)) WHERE example <= 5",
    "inner_val_split": f"WITH g AS (SELECT DISTINCT cluster_id FROM pair_records WHERE split = 'train' AND cluster_id IS NOT NULL) SELECT cluster_id, CASE WHEN row_number() OVER (ORDER BY {_ORDER('cluster_id')}, cluster_id) <= greatest(1, floor((SELECT count(*) FROM g) * 0.05::DOUBLE)) THEN 'val' ELSE 'train' END AS inner_split FROM g",
    "missing_documents": "SELECT cluster_id FROM pair_records EXCEPT SELECT cluster_id FROM cleaned_opinions", "excluded_documents": f"WITH {_AUDIT} SELECT cluster_id FROM au WHERE list_has_any(reasons, ['wrong_case', 'not_merits'])",
    "kind_counts": "SELECT cluster_id, kind, count(*) AS n FROM (SELECT cluster_id, unnest(secondary_types) AS kind FROM cleaned_opinions) GROUP BY ALL",
    "stream_staged_join": "SELECT cluster_id, count(*) AS opinions, sum(word_count) AS words FROM (SELECT DISTINCT cluster_id, opinion_id, word_count FROM sub_opinions) WHERE cluster_id IN (SELECT cluster_id FROM clusters) GROUP BY 1", "safety_valve": "SELECT least(300, count(*)) AS n FROM sub_opinions",
}
SQL["splits_cover"] = "SELECT count(*) FILTER (WHERE n = 0) AS missing, 0 AS extra FROM (SELECT cluster_id, count(*) AS n FROM pair_records WHERE cluster_id IS NOT NULL GROUP BY 1)"
