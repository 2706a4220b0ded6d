"""Registered queries of evaluation and reporting, with their SQL.

The systems scored here answer with the quotation ('quote'), with the question ('echo') and with the quotation's first
ten words ('lead'); the reference is each pair's answer.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from docketforge.functions import seams
from docketforge.functions import text as T
from docketforge.operators import corpus, evaluate, splitting
from docketforge.plans import sqltext as S
from docketforge.sources.tables import table
from docketforge.streaming import incremental

SYSTEMS = ("quote", "echo", "lead")


def _predictions(s, d, split: str = "test"):
    """(system, key, pair_id, reference, prediction, question_type, category) over one delivery of each pair of a split."""
    p = corpus.keep_one(table(s, d, "pair_records").where(F.col("split") == split), "pair_id", ["load_id", "loaded_at", "question"])
    lead = F.array_join(F.slice(F.split(T.squeeze(T.blank(F.col("supporting_span"))), " "), 1, 10), " ")
    each = F.array(*[F.struct(F.lit(n).alias("system"), x.alias("prediction")) for n, x in zip(SYSTEMS, (F.col("supporting_span"), F.col("question"), lead))])
    rows = p.select("pair_id", F.col("answer").alias("reference"), "question_type", "category", F.explode(each).alias("e"))
    return rows.select("e.system", F.concat_ws(":", "e.system", "pair_id").alias("key"), "pair_id", "reference", "e.prediction", "question_type", "category")


def _with_f1(s, d):
    return evaluate.rouge1(_predictions(s, d), "key", "reference", "prediction", ("system", "pair_id", "prediction", "question_type", "category"))


def _floors(s, d):
    """Each prediction against another item's reference, the score that any text of the domain gets."""
    p = _predictions(s, d)
    other = splitting.floor_assignment(p, "pair_id", "system").withColumnRenamed("pair_id", "pid")
    # One step around the system's order is the same for every system: the order goes by pair.
    refs = p.select("pair_id", "reference").distinct().withColumnsRenamed({"pair_id": "other", "reference": "other_reference"})
    one = p.join(other.select(F.col("pid").alias("pair_id"), "other").distinct(), "pair_id").join(refs, "other")
    floor = evaluate.rouge1(one, "key", "other_reference", "prediction").select("key", F.col("f1").alias("floor"))
    both = _with_f1(s, d).join(floor, "key")
    by = both.groupBy("system").agg(F.round(F.avg("f1"), 4).alias("mean"), F.round(F.avg("floor"), 4).alias("floor"))
    return by.withColumn("above_floor", F.round(F.col("mean") - F.col("floor"), 4))


def _cosine_pairs(s, d):
    e = table(s, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"), F.col("label").alias("other_label"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(evaluate.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"), (F.col("label") == F.col("other_label")).alias("same_label"))


def _cosine_floor(s, d):
    c = _cosine_pairs(s, d).groupBy("same_label").agg(F.count("*").alias("n"), F.round(F.avg("cosine"), 4).alias("mean"))
    return c


def _greedy(s, d):
    # Four vectors in a row stand for the tokens of a text, compared with the text after it.
    e = table(s, d, "embeddings").select("vec_id", F.expr("vec_id div 4").alias("t"), "embedding")
    texts = e.groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("vectors"))
    both = texts.join(texts.select((F.col("t") - 1).alias("t"), F.col("vectors").alias("other")), "t").select("t", evaluate.greedy_similarity(F.col("vectors"), F.col("other"), 0.1).alias("s"))
    return both.select("t", *[F.round(f"s.{c}", 5).alias(c) for c in ("precision", "recall", "f")])


def _scores(s, d):
    return evaluate.score_table(_with_f1(s, d), "system", "pair_id", ["precision", "recall", "f1"])


def _judge_sample(s, d):
    return seams.judged(table(s, d, "pair_records"), seams.LengthJudge())


def _judged(s, d):
    # Verdicts as a judge returns them, from what is known of a pair: 1 to 5 by the answer's length.
    words = F.least(F.lit(5), F.greatest(F.lit(1), F.floor(T.word_count(F.col("answer")) / 10))).cast("int")
    raw = F.concat(F.lit("Verdict: "), F.to_json(F.struct(words.alias("faithful"), F.lit(4).alias("useful"))))
    v = table(s, d, "pair_records").select("pair_id", F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), "faithful double, useful double").alias("v"))
    return v.agg(F.count("v.faithful").alias("n"), F.round(F.avg("v.faithful"), 4).alias("faithful"), F.round(100 * F.avg((F.col("v.faithful") >= 4).cast("int")), 4).alias("pct_4_up"), F.count_if((F.col("v.faithful") + F.col("v.useful")) / 2 <= 2.5).alias("worst"))


def _empty_runs(s, d):
    p = table(s, d, "pair_records").select("load_id", "pair_id", "loaded_at", (T.word_count(F.col("answer")) == 0).alias("e"))
    hour = F.date_trunc("hour", "loaded_at")
    every = splitting.ranked(p, "load_id", hour, ["loaded_at", "pair_id", "e"]).withColumnRenamed("rank", "r").drop("size").where("e")
    return splitting.ranked(every, "load_id", hour, ["loaded_at", "pair_id"]).withColumn("g", F.col("r") - F.col("rank")).groupBy("load_id", "g").agg(F.count("*").alias("n"), F.min("r").alias("first"))


def _consecutive_empty(s, d):
    return _empty_runs(s, d).groupBy("load_id").agg(F.max("n").alias("longest_empty_run"))


def _abort_points(s, d):
    # Where a run would stop that bears no empty answer: the row of the first one.
    most = 1
    return _empty_runs(s, d).where(F.col("n") >= most).groupBy("load_id").agg(F.min(F.col("first") + most - 1).cast("long").alias("abort_at"))


def _projection(s, d):
    n = table(s, d, "cleaned_opinions").agg(F.sum(F.ceil(F.col("word_count") / 750)).alias("chunks"))
    return n.select("chunks", (F.col("chunks") * 3).alias("candidates"), F.round(F.col("chunks") * 3 * 0.8, 1).alias("accepted"), F.round(F.col("chunks") * 3.5 / 3600, 2).alias("hours"), (F.col("chunks") * 2200).alias("tokens"))


def _generation_shares(s, d):
    return T.share_of_all(table(s, d, "pair_records").groupBy("generator").agg(F.count("*").alias("n")), digits=1)


QUERIES = {
    "rouge1": lambda s, d: _with_f1(s, d).select("key", "precision", "recall", "f1"), "rouge_l": lambda s, d: evaluate.scored(_predictions(s, d), "key", "reference", "prediction"), "above_floor": _floors,
    "diagnostics": lambda s, d: evaluate.diagnostics(_predictions(s, d), "system", "reference", "prediction"), "group_breakdown": lambda s, d: evaluate.group_means(_with_f1(s, d), ["question_type", "category", "system"], "f1", "pair_id"),
    "bootstrap_ci": lambda s, d: evaluate.hash_bootstrap(_with_f1(s, d), "system", "pair_id", "f1"), "score_table": _scores, "score_verdicts": lambda s, d: evaluate.verdicts(_scores(s, d), "system"), "aligned_systems": lambda s, d: evaluate.aligned(_with_f1(s, d).where("system <> 'lead' OR pair_id % 3 > 0"), "system", "pair_id", "quote"), "greedy_similarity": _greedy, "judge_sample": _judge_sample, "abort_points": _abort_points,
    "paired_bootstrap": lambda s, d: evaluate.paired(_with_f1(s, d), "system", "pair_id", "f1", "quote"),
    "seed_mean_sd": lambda s, d: evaluate.seed_spread(_with_f1(s, d), "system", "question_type", "f1"), "cosine_pairs": _cosine_pairs, "cosine_above_floor": _cosine_floor, "judge_summary": _judged, "consecutive_empty": _consecutive_empty, "generation_projection": _projection,
    "generator_shares": _generation_shares, "stream_resume": incremental.resumed_pairs, "stream_dedup": incremental.deduplicated_clusters, "stream_event_windows": incremental.windowed_events,
}

_P = f"""p1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY load_id, loaded_at, question) AS rn FROM pair_records WHERE split = 'test') WHERE rn = 1),
p AS (SELECT system, system || ':' || pair_id AS key, pair_id, answer AS reference, CASE system WHEN 'quote' THEN supporting_span WHEN 'echo' THEN question ELSE array_to_string(string_split({S.squeeze("coalesce(supporting_span, '')")}, ' ')[1:10], ' ') END AS prediction, question_type, category FROM p1, (VALUES ('quote'), ('echo'), ('lead')) v(system))"""
_TOK = lambda c: f"regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"


def _f1(src: str, ref: str, name: str) -> str:
    return f"""{name}t AS (SELECT key, {_TOK(ref)} AS a, {_TOK('prediction')} AS b FROM {src}),
{name}c AS (SELECT key, len(a) AS na, len(b) AS nb, CAST(list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w))))) AS BIGINT) AS c FROM {name}t),
{name} AS (SELECT key, round(CASE WHEN nb > 0 THEN coalesce(c, 0) / nb ELSE 0.0 END, 6) AS precision, round(CASE WHEN na > 0 THEN coalesce(c, 0) / na ELSE 0.0 END, 6) AS recall, round(CASE WHEN c > 0 THEN 2 * (c / nb) * (c / na) / (c / nb + c / na) ELSE 0.0 END, 6) AS f1 FROM {name}c)"""


_F = f"WITH {_P}, {_f1('p', 'reference', 'f')}, s AS (SELECT p.*, f.f1 FROM p JOIN f USING (key))"
# The same hash family: residues of each resample and of each key, and Poisson weights by the polynomial's value.
_RES = lambda t, i: f"CAST(('0x' || substring(md5('42#' || {t}), {i}, 8))::UBIGINT % 2147483647 AS BIGINT)"
_H = "CAST(('0x' || substring(md5(CAST(k AS VARCHAR)), 1, 8))::UBIGINT % 2147483647 AS BIGINT)"
_COEF = f"co AS MATERIALIZED (SELECT t, {_RES('t', 1)} AS a, {_RES('t', 9)} AS b, {_RES('t', 17)} AS c FROM range(2000) x(t))"
_W = "CASE " + " ".join(f"WHEN x < {int(math.ceil(step * evaluate.PRIME))} THEN {i}" for i, step in enumerate(evaluate.STEPS)) + f" ELSE {len(evaluate.STEPS)} END"


def _boot(src: str) -> str:
    """bm: the mean of each group of src (g, k, v) in each resample; bg: n and mean of each group."""
    return f"""bh AS MATERIALIZED (SELECT g, v, {_H} AS h FROM {src} WHERE g IS NOT NULL AND v IS NOT NULL), {_COEF},
bw AS (SELECT g, t, v, {_W} AS w FROM (SELECT g, t, v, ((a * h + b) % 2147483647 * h + c) % 2147483647 AS x FROM bh, co)),
bm AS (SELECT g, t, sum(w * v) / sum(w) AS m FROM bw GROUP BY ALL HAVING sum(w) > 0), bg AS (SELECT g, count(*) AS n, avg(v) AS mean FROM bh GROUP BY 1)"""


_CI = "n, round(mean, 4) AS mean, round(low, 4) AS low, round(high, 4) AS high FROM bg JOIN (SELECT g, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM bm GROUP BY 1) USING (g)"
_SCORES = f"WITH {_P}, {_f1('p', 'reference', 'f')}, src AS (SELECT metric || '|' || system AS g, pair_id AS k, v FROM (SELECT system, pair_id, unnest(['precision', 'recall', 'f1']) AS metric, unnest([f.precision, f.recall, f.f1]) AS v FROM p JOIN f USING (key))), {_boot('src')}, sc AS (SELECT string_split(g, '|')[2] AS system, string_split(g, '|')[1] AS metric, {_CI})"

SQL = {
    "rouge1": f"WITH {_P}, {_f1('p', 'reference', 'f')} SELECT key, precision, recall, f1 FROM f",
    "above_floor": f"""{_F}, r AS (SELECT DISTINCT pair_id, reference FROM p), o AS (SELECT pair_id, coalesce(lead(pair_id) OVER w, first_value(pair_id) OVER w) AS other FROM (SELECT DISTINCT pair_id FROM p) WINDOW w AS (ORDER BY md5('42#' || pair_id), pair_id)),
q AS (SELECT p.key, p.prediction, r.reference AS oref FROM p JOIN o USING (pair_id) JOIN r ON r.pair_id = o.other), {_f1('q', 'oref', 'g')}, b AS (SELECT system, round(avg(s.f1), 4) AS mean, round(avg(g.f1), 4) AS floor FROM s JOIN g USING (key) GROUP BY 1) SELECT *, round(mean - floor, 4) AS above_floor FROM b""",
    "diagnostics": f"""WITH {_P}, b AS (SELECT system, count(*) AS n, count(*) FILTER (WHERE trim(coalesce(prediction, ''), ' ') = '') AS empty, avg({S.word_count('prediction')}) AS mw, avg({S.word_count('reference')}) AS rw, count(*) - count(DISTINCT coalesce(prediction, '')) AS duplicates FROM p GROUP BY 1)
SELECT system, n, empty, round(mw, 4) AS mean_words, round(mw / rw, 4) AS length_ratio, duplicates, list_filter([CASE WHEN mw / rw > 2.0 THEN 'verbose' END, CASE WHEN mw / rw < 0.5 THEN 'terse' END, CASE WHEN duplicates > 0.1 * n THEN 'duplicates' END, CASE WHEN empty > 0 THEN 'empty' END], lambda x: x IS NOT NULL) AS warnings FROM b""",
    "group_breakdown": f"{_F}, src AS (" + " UNION ALL ".join(f"SELECT '{c}|' || coalesce({c}, 'unknown') AS g, pair_id AS k, f1 AS v FROM s" for c in ("question_type", "category", "system")) + f"), {_boot('src')} SELECT string_split(g, '|')[1] AS field, string_split(g, '|')[2] AS level, {_CI}",
    "bootstrap_ci": f"{_F}, src AS (SELECT system AS g, pair_id AS k, f1 AS v FROM s), {_boot('src')} SELECT g AS system, {_CI}",
    "paired_bootstrap": f"{_F}, src AS (SELECT a.system AS g, a.pair_id AS k, a.f1 - b.f1 AS v FROM s a JOIN s b ON a.pair_id = b.pair_id AND b.system = 'quote' WHERE a.system <> 'quote'), {_boot('src')}, q AS (SELECT g, count(*) FILTER (WHERE m > 0) / count(*) AS above FROM bm GROUP BY 1), z AS (SELECT g AS system, n, round(mean, 4) AS mean_diff, round(2 * least(above, 1 - above), 4) AS p FROM bg JOIN q USING (g)) SELECT *, p < 0.05 AS significant FROM z",
    "score_table": _SCORES + " SELECT * FROM sc", "score_verdicts": _SCORES + ", v AS (SELECT system, max(mean) FILTER (WHERE metric = 'precision') AS precision, max(mean) FILTER (WHERE metric = 'recall') AS recall FROM sc GROUP BY 1) SELECT *, recall > 0 AND precision / greatest(recall, 1e-9) < 0.6 AS verbose FROM v",
    "aligned_systems": f"WITH {_P}, x AS (SELECT system, pair_id FROM p WHERE system <> 'lead' OR pair_id % 3 > 0), b AS (SELECT pair_id FROM x WHERE system = 'quote'), y AS (SELECT system, count(*) AS items, count(b.pair_id) AS common FROM x LEFT JOIN b USING (pair_id) WHERE system <> 'quote' GROUP BY 1), z AS (SELECT system, items, (SELECT count(*) FROM b) - common AS missing, items - common AS extra FROM y) SELECT *, missing = 0 AND extra = 0 AS aligned FROM z",
    "greedy_similarity": "WITH t AS (SELECT vec_id, vec_id // 4 AS t, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT a.t, a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.e, b.e) AS c FROM t a JOIN t b ON b.t = a.t + 1), r AS (SELECT t, avg(m) AS r FROM (SELECT t, i, max(c) AS m FROM c GROUP BY ALL) GROUP BY 1), p AS (SELECT t, avg(m) AS p FROM (SELECT t, j, max(c) AS m FROM c GROUP BY ALL) GROUP BY 1) SELECT t, round((p - 0.1) / 0.9, 5) AS precision, round((r - 0.1) / 0.9, 5) AS recall, round((2 * p * r / (p + r) - 0.1) / 0.9, 5) AS f FROM p JOIN r USING (t)",
    "judge_sample": f"SELECT pair_id, CAST(least(5, greatest(1, {S.word_count('answer')} // 10)) AS DOUBLE) AS faithful, 4.0::DOUBLE AS useful FROM pair_records",
    "seed_mean_sd": f"{_F}, m AS (SELECT system, question_type, avg(f1) AS m FROM s GROUP BY ALL) SELECT system, count(*) AS seeds, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd FROM m GROUP BY 1",
    "cosine_pairs": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, a.label = b.label AS same_label FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "cosine_above_floor": "SELECT a.label = b.label AS same_label, count(*) AS n, round(avg(round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)), 4) AS mean FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 GROUP BY 1",
    "judge_summary": f"WITH v AS (SELECT CAST(least(5, greatest(1, floor({S.word_count('answer')} / 10))) AS DOUBLE) AS f FROM pair_records) SELECT count(*) AS n, round(avg(f), 4) AS faithful, round(100 * avg((f >= 4)::INT), 4) AS pct_4_up, count(*) FILTER (WHERE (f + 4) / 2 <= 2.5) AS worst FROM v",
    "consecutive_empty": f"WITH p AS (SELECT load_id, pair_id, loaded_at, {S.word_count('answer')} = 0 AS e FROM pair_records), r AS (SELECT *, row_number() OVER (PARTITION BY load_id ORDER BY loaded_at, pair_id, e) - row_number() OVER (PARTITION BY load_id, e ORDER BY loaded_at, pair_id, e) AS g FROM p) SELECT load_id, max(n) AS longest_empty_run FROM (SELECT load_id, g, count(*) AS n FROM r WHERE e GROUP BY ALL) GROUP BY 1",
    "abort_points": f"WITH p AS (SELECT load_id, pair_id, loaded_at, {S.word_count('answer')} = 0 AS e FROM pair_records), r AS (SELECT *, row_number() OVER (PARTITION BY load_id ORDER BY loaded_at, pair_id, e) AS r, row_number() OVER (PARTITION BY load_id ORDER BY loaded_at, pair_id, e) - row_number() OVER (PARTITION BY load_id, e ORDER BY loaded_at, pair_id, e) AS g FROM p), q AS (SELECT load_id, g, count(*) AS n, min(r) AS f FROM r WHERE e GROUP BY ALL) SELECT load_id, min(f) AS abort_at FROM q WHERE n >= 1 GROUP BY 1",
    "generation_projection": "WITH n AS (SELECT CAST(sum(ceil(word_count / 750)) AS BIGINT) AS chunks FROM cleaned_opinions) SELECT chunks, chunks * 3 AS candidates, round(chunks * 3 * 0.8, 1) AS accepted, round(chunks * 3.5 / 3600, 2) AS hours, chunks * 2200 AS tokens FROM n",
    "generator_shares": "SELECT generator, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM pair_records), 1) AS pct FROM pair_records GROUP BY 1",
    "stream_resume": "SELECT pair_id, cluster_id, chunk_index FROM pair_records p WHERE NOT EXISTS (SELECT 1 FROM pair_records q WHERE q.load_id < 3 AND q.cluster_id = p.cluster_id AND q.chunk_index = p.chunk_index)",
    "stream_dedup": "SELECT DISTINCT cluster_id FROM clusters",
    "stream_event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
