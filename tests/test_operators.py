"""Operators on small tables: nulls, ties, repeated rows, empty tables, clashing columns."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docketforge import config, session
from docketforge.functions import seams
from docketforge.functions import text as T
from docketforge.operators import components, corpus, diagnose, evaluate, profile, quality, splitting, verify, windows
from docketforge.sources import paged, readers


def rows(df, *cols):
    return sorted([tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.select(*cols).collect()], key=str)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9), (3, 1), (None, 4), (8, 7)], "u long, v long")
    assert rows(components.connected_components(e), "node", "component") == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 9)]
    assert components.connected_components(e.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    e = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert components.connected_components(e).select("component").distinct().count() == 1


@pytest.mark.parametrize("a, b, same", [("Smith v. Jones", "JONES, WARDEN v. SMITH et al.", True), ("Acme Corp. v. Doe", "Acme Corporation v. Doe", True), ("Smith v. Jones", "Smith v. Brown", False)])
def test_name_keys(spark, a, b, same):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(T.name_key(F.col("a")).alias("a"), T.name_key(F.col("b")).alias("b")).first()
    assert (r["a"] == r["b"]) is same


@pytest.mark.parametrize("cite, key", [("410 U.S. 113", "410-113"), ("410 U. S. 113 (1973)", "410-113"), ("410 US 113", "410-113"), ("93 S. Ct. 705", None), ("", None), (None, None)])
def test_citation_keys(spark, cite, key):
    assert spark.createDataFrame([(cite,)], "c string").select(T.citation_key(F.col("c"))).first()[0] == key


@pytest.mark.parametrize("n", [400, 900, 901, 1500, 1600, 2400, 5000])
def test_windows_cover_every_word(spark, n):
    text = "\n\n".join(" ".join(f"w{i}" for i in range(j, min(j + 60, n))) for j in range(0, n, 60))
    made = windows.windows(spark.createDataFrame([(1, f"  {text} ", "x")], "cluster_id long, text string, total string")).orderBy("chunk_index").collect()
    assert made[0]["start_word"] == 0 and made[-1]["end_word"] == n and all(b["start_word"] <= a["end_word"] for a, b in zip(made, made[1:]))
    assert all(text[r["char_start"] : r["char_end"]] == r["text"] for r in made) and made[-1]["char_end"] == len(text)
    assert made[-1]["position"] == "late" and len(made) == 1 or made[-1]["end_word"] - made[-1]["start_word"] >= 200


def test_windows_of_nothing(spark):
    assert windows.windows(spark.createDataFrame([(1, None), (2, " \n "), (3, "")], "cluster_id long, text string")).count() == 0


def test_bands(spark):
    band = lambda n: [r[0] for r in spark.range(n).orderBy("id").select(windows.band(F.col("id"), F.lit(n))).collect()]
    assert band(1) == ["late"] and band(2) == ["early", "late"] and band(3) == ["early", "late", "late"] and band(4) == ["early", "middle", "late", "late"]


def test_longest_run_against_brute_force(spark):
    data = [(1, "a b c d", "x b c d y"), (2, None, "a"), (3, "a a a", "a a"), (3, "a a a", "a a"), (4, "one two", "two one"), (5, "", "")]
    out = rows(verify.longest_shared_run(spark.createDataFrame(data, "pair_id long, answer string, supporting_span string")), "pair_id", "longest_run")
    assert out == [(1, 3), (2, 0), (3, 2), (3, 2), (4, 1), (5, 0)]


def test_verification(spark):
    o = spark.createDataFrame([(1, "The “rule” is U. S. C. based.  It holds, always and ever.")], "cluster_id long, text string")
    p = spark.createDataFrame([(1, 1, "It holds"), (2, 1, 'The "rule" is U.S.C. based.'), (3, 1, "it holds always AND ever"), (4, 1, "It never holds"), (5, 1, None), (6, 9, "It holds"), (7, 1, "The rule . . . always and ever"), (8, 1, "")], "pair_id long, cluster_id long, supporting_span string")
    steps = {1: 0, 2: 1, 3: 2, 7: 2}
    assert dict(rows(verify.first_method(p, o, artefact=True), "pair_id", "step")) == {k: steps.get(k, 4) for k in range(1, 9)}
    h = {r["pair_id"]: (r["exact"], r["normalised"], r["word"], r["artefact"]) for r in verify.hits(p, o, artefact=True).collect()}
    assert h[1] == (True,) * 4 and h[3] == (False, False, True, True) and h[4] == h[5] == h[6] == h[8] == (False,) * 4
    assert [r["failures"] for r in verify.step_rates(verify.first_method(p, o)).collect()] == [7, 6, 4]


def test_pairs_of_one_opinion_stand_in_lists_beside_its_text(spark):
    text = "Chapter one. " + " ".join(f"word{i} stands, here" for i in range(700))
    quote = lambda i: (f"word{i} stands, here", f"Word{i}  stands here", f"word{i} . . . word{i + 50} stands", f"word{i} st- ands", f"word{i} falls", None)[i % 6]
    data = [(i, None if i % 50 == 7 else 8 if i % 50 == 9 else 1, quote(i), 13 if i == 0 else None, 13 + 18 if i == 0 else None) for i in range(600)]
    p = spark.createDataFrame([*data, data[0]], "pair_id long, cluster_id long, supporting_span string, span_start long, span_end long")
    o = spark.createDataFrame([(1, text, "a", "b"), (2, "Another text.", "c", "d")], "cluster_id long, text string, case_name string, citation string")
    assert verify.chunked(p, o.select("cluster_id", "text"), "left").count() <= 6
    plain, tolerant = (rows(verify.first_method(p, o, artefact=x), "pair_id", "step") for x in (False, True))
    assert len(plain) == len(tolerant) == 601 and [(k, min(x, 3)) for k, x in tolerant] == plain
    assert {x for _, x in tolerant} == {0, 2, 3, 4}
    chain = verify.provenance(p, o)
    assert [r[1] for r in rows(chain, "pair_id", "found_step")] == [x for k, x in plain if k % 50 not in (7, 9)]
    assert [r["slice"] for r in chain.where("offsets_hold").collect()] == ["word0 stands, here"] * 2


def test_tolerant_search_has_no_text_beside_each_pair(spark, monkeypatch):
    made, chunked = [], verify.chunked
    monkeypatch.setattr(verify, "chunked", lambda *a, **k: made.append(chunked(*a, **k)) or made[-1])
    p = spark.range(600).select(F.col("id").alias("pair_id"), F.lit(1).alias("cluster_id"), F.concat(F.lit("no such words "), "id").alias("supporting_span"))
    steps = verify.first_method(p, spark.createDataFrame([(1, "It is so.")], "cluster_id long, text string"), artefact=True)
    assert [r["step"] for r in steps.collect()] == [4] * 600 and made[0].count() <= 3


def test_counterfactuals(spark):
    d = spark.createDataFrame([("It is not so, not at all",), ("There is no doubt",), ("One two three four",), ("One",)], "s string")
    assert [r[0] for r in d.select(verify.counterfactual(F.col("s"))).collect()] == ["It is so, not at all", "There is doubt", "One two never three four", "One never"]


def test_failure_classes(spark):
    window = "the quick brown fox jumps over the lazy dog near the river bank today"
    o = spark.createDataFrame([(1, window)], "cluster_id long, text string")
    spans = ["??", "the quick brown cat jumps over the lazy dog", "purple rain falls", "the quick, brown fox", window + " and more words than there are", None]
    p = spark.createDataFrame([(i, 1, 0, s) for i, s in enumerate(spans)], "pair_id long, cluster_id long, chunk_index int, supporting_span string")
    assert rows(diagnose.classes(p, o), "pair_id", "failure") == [(0, "empty"), (1, "near_miss"), (2, "fabricated"), (3, "cross_chunk"), (4, "span_exceeds_chunk")]


def test_gap_kinds_know_lines_padded_by_any_space(spark):
    gaps = ["x\n\t 12 \t\nand", "x\n\t3 See above", "[T]he", "plain words left out here", "see 12 U. S. 3"]
    d = spark.createDataFrame([(g,) for g in gaps], "g string")
    assert [r[0] for r in d.select(diagnose.gap_kind(F.col("g"))).collect()] == ["page_furniture", "page_furniture", "editorial_brackets", "prose_omitted", "citation_omitted"]


def test_labels_by_a_person_go_first(spark):
    d = spark.createDataFrame([(1, "citation_omitted"), (2, "page_furniture"), (3, None)], "pair_id long, suggested string")
    m = spark.createDataFrame([(1, "fabrication"), (1, " "), (2, "")], "pair_id long, label string")
    out = diagnose.labelled(d, m)
    assert rows(out, "pair_id", "classification", "classified_by") == [(1, "fabrication", "person"), (2, "page_furniture", "suggestion"), (3, None, "suggestion")]
    assert diagnose.review_rates(out, 10).count() == 0
    rates = {r["label"]: r["n"] for r in diagnose.review_rates(out.where("pair_id < 3"), 10).collect()}
    assert rates == {"fabrication": 1, "unfaithful_quotation": 1, "unmarked_omission": 0}
    with pytest.raises(Exception, match="unknown class"):
        diagnose.labelled(d, spark.createDataFrame([(1, "odd")], "pair_id long, label string")).collect()


def test_trim(spark):
    long = "word " * 600
    c = spark.createDataFrame([(1, long + "SEPARATE"), (2, "short text. SEPARATE"), (3, long), (4, None)], "cluster_id long, text string")
    a = spark.createDataFrame([(1, []), (2, []), (3, ["wrong_case"]), (4, [])], "cluster_id long, reasons array<string>")
    cuts = spark.createDataFrame([(1, 3000), (2, 12), (3, 10)], "cluster_id long, cut_at long")
    out = {r["cluster_id"]: r for r in corpus.trimmed(c, a, cuts).collect()}
    assert out[1]["text"] == long.rstrip() and out[1]["cut_at"] == 3000 and out[1]["words_removed"] == 1
    assert out[2]["reasons"] == ["below_min_words_after_trim"] and out[2]["text"].endswith("SEPARATE") and out[3]["reasons"] == ["wrong_case"] and out[3]["text"] == long and out[4]["text"] is None


def test_replies_of_all_kinds(spark):
    good = '{"qa_pairs": [{"question": "q", "answer": "a", "unknown": 1}]}'
    replies = [f"```json\n{good}\n```", f"So: {good} Done.", '{"qa_pairs": [{"question": "q', '{"other": 1}', "nothing", None, ""]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i long, reply string")
    out = {r["i"]: (r["state"], r["pairs"] and r["pairs"][0]["question"]) for r in seams.parsed(d).collect()}
    assert out == {0: ("ok", "q"), 1: ("ok", "q"), 2: ("broken", None), 3: ("no_pairs", None), 4: ("broken", None), 5: ("broken", None), 6: ("broken", None)}


def test_calls_and_batches():
    answers, waits = iter([(500, "", None), (429, "", 7.0), (200, "body", None)]), []
    assert seams.call(lambda t: next(answers), "x", sleep=waits.append) == "body" and waits == [2.0, 7.0]
    with pytest.raises(seams.GaveUp):
        seams.call(lambda t: (401, "", None), "x", sleep=waits.append)

    def run(batch):
        if len(batch) > 2:
            raise MemoryError
        return [x * 10 for x in batch]

    assert seams.in_batches(list(range(9)), run, 8) == [x * 10 for x in range(9)]


def test_paged_client():
    class Flaky:
        def __init__(self):
            self.sizes, self.calls = [], 0

        def page(self, window, cursor, size):
            self.calls += 1
            self.sizes.append(size)
            if self.calls == 1:
                return paged.Answer(None)
            if self.calls == 2:
                return paged.Answer(429, wait=1.0)
            at = int(cursor or 0)
            return paged.Answer(200, [{"i": i} for i in range(at, min(at + size, 12))], str(at + size) if at + size < 12 else None)

    t, waits = Flaky(), []
    got = list(paged.Client(t, sleep=waits.append).rows(("a", "b")))
    assert [r["i"] for r in got] == list(range(12)) and t.sizes[:3] == [20, 10, 10] and waits[:2] == [2.0, 1.0]

    class Closed:
        def __init__(self, answer):
            self.answer = answer

        def page(self, window, cursor, size):
            return self.answer

    with pytest.raises(RuntimeError):
        list(paged.Client(Closed(paged.Answer(403)), sleep=waits.append).rows(("a", "b")))
    with pytest.raises(paged.QuotaExhausted):
        list(paged.Client(Closed(paged.Answer(429, wait=4000.0)), sleep=waits.append).rows(("a", "b")))


def test_paged_client_pauses_no_longer_than_told():
    class Busy:
        def __init__(self, wait):
            self.wait, self.asked = wait, set()

        def page(self, window, cursor, size):
            at = int(cursor or 0)
            if at % 60 == 40 and at not in self.asked:
                self.asked.add(at)
                return paged.Answer(429, wait=self.wait)
            return paged.Answer(200, [{"i": i} for i in range(at, at + size)], str(at + size) if at + size < 400 else None)

    for wait, slept in ((0.0, 0.0), (0.5, 88.0)):
        waits = []
        assert len(list(paged.Client(Busy(wait), sleep=waits.append).rows(("a", "b")))) == 400
        assert sum(waits) == slept


def test_paged_rows_are_asked_for_without_reading_the_table_again(tmp_path, monkeypatch):
    path, reads, read = str(tmp_path / "t.parquet"), [], pq.read_table
    pq.write_table(pa.table({"id": range(300), "d": [f"200{i % 3}-05-05" for i in range(300)], "name": [f"n{i}" for i in range(300)]}), path)
    monkeypatch.setattr(pq, "read_table", lambda *a, **k: reads.append(a) or read(*a, **k))
    pages = paged.ParquetPages(path, "id", "d", ("id", "d", "name"), hide="name")
    for y in (0, 1, 2):
        for r in paged.Client(pages, size=7).rows((f"200{y}-01-01", f"200{y}-12-31")):
            assert r["name"] is None and pages.one(r["id"])["name"] == f"n{r['id']}"
    assert len(reads) == 3
    assert pages.one(3)["name"] == "n3" and pages.one(999) is None and len(reads) == 5


def test_settings(tmp_path):
    f = tmp_path / "s.toml"
    f.write_text('[settings]\nmodel = "m"\nchunk_overlap = 900\nunknown = 1\n')
    s = config.Settings.read(str(f))
    assert s.model == "m" and len(s.problems()) == 1 and "chunk_overlap" in s.problems()[0] and config.Settings().problems() == ["model is missing"]
    assert config.Settings(model="m", most_copied_words=None).warnings() == ["most_copied_words isn't set"]


def test_medians_and_shares(spark):
    for n in (1, 2, 3, 4, 7, 10):
        d = spark.range(n).select(F.col("id").alias("x"))
        assert d.agg(T.upper_median("x")).first()[0] == n // 2
    d = spark.range(1001).select(F.col("id").alias("x"))
    assert d.agg(T.at_share("x", 0.1), T.at_share("x", 0.9)).first() == (100, 900)


def test_positions_and_examples(spark):
    d = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id"), (F.col("id") % 3).alias("label"))
    out = corpus.by_position(d, ["id"], spark.createDataFrame([(5, "v")], "position long, verdict string"))
    assert out.where("position <> id").count() == 0 and rows(out.where("verdict = 'v'"), "id") == [5]
    assert corpus.examples(d, "label", "id", 2).count() == 6
    inner = splitting.inner_val(d, "id")
    assert inner.where("inner_split = 'val'").count() == 50 and splitting.inner_val(d.where("id = 1"), "id").first()["inner_split"] == "val"


def test_shared_folder_is_asked_for_on_a_cluster():
    class Stub:
        class conf:
            @staticmethod
            def get(key, default):
                return None

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

    with pytest.raises(RuntimeError):
        session.shared_dir(Stub)


def test_release_removes_cut_tables(spark):
    df = session.cut(spark.range(5))
    path = df.inputFiles()[0]
    assert df.count() == 5 and session.release() >= 1
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_first_and_last_win(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), (" ", 5)], "k string, pos long")
    assert rows(readers.one_of_key(d, "k", "pos"), "k", "pos") == [("a", 1), ("b", 3)] and rows(readers.one_of_key(d, "k", "pos", last=True), "k", "pos") == [("a", 2), ("b", 3)]


def test_primary_takes_the_first_of_equals(spark):
    subs = "array<struct<opinion_id long, type string, author string, text string, word_count int>>"
    d = spark.createDataFrame([(1, [(5, "020lead", None, "x", 3), (6, "010combined", None, "y", 3), (7, "040dissent", None, "z", 9)]), (2, [(8, "040dissent", None, "z", 9)]), (3, [])], f"cluster_id long, sub_opinions {subs}")
    assert rows(d.select("cluster_id", corpus.primary()["opinion_id"].alias("o")), "cluster_id", "o") == [(1, 5), (2, None), (3, None)]


def test_strict_join_refuses_a_citation_that_misses(spark):
    c = spark.createDataFrame([(1, "Ann v. Bob", "1 U.S. 1"), (2, "Ann v. Bob", None), (3, "Ann v. Bob", "9 U.S. 9"), (4, None, None)], "cluster_id long, case_name string, citation string")
    a = spark.createDataFrame([("A", "ANN v. BOB", "1 U.S. 1", "8", "1990"), ("B", "ANN v. BOB", None, None, "1991")], "caseid string, casename string, uscite string, issuearea string, term string")
    assert rows(corpus.annotate(c, a), "cluster_id", "matched") == [(1, "citation"), (2, "case_name"), (3, "case_name"), (4, None)]
    assert rows(corpus.annotate(c, a, lenient=False), "cluster_id", "matched") == [(1, "citation"), (2, "case_name")]


def test_split_keeps_groups_and_shares(spark):
    p = spark.range(3200).select((F.col("id") % 200).alias("cluster_id"), F.concat(F.lit("c"), F.col("id") % 200 % 6).alias("category"), F.col("id").alias("pair_id"))
    s = splitting.stratified_groups(p, "cluster_id", "category")
    assert s.count() == 200 and s.select("cluster_id").distinct().count() == 200
    n = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert 150 <= n["train"] <= 170 and n["val"] and n["test"]
    assert splitting.leakage(p).agg(F.avg("share")).first()[0] > 0.95
    rare = splitting.stratified_groups(spark.createDataFrame([(1, "r"), (2, "r"), (3, None)], "cluster_id long, category string"), "cluster_id", "category")
    assert rows(rare, "split") == ["train"] * 3


def test_ranked_equals_a_global_rank(spark):
    d = spark.range(500).select(F.lit("g").alias("g"), F.md5(F.col("id").cast("string").cast("binary")).alias("o"), "id")
    r = splitting.ranked(d, "g", F.substring("o", 1, 2), ["o"]).orderBy("o").collect()
    assert [x["rank"] for x in r] == list(range(1, 501)) and {x["size"] for x in r} == {500}


def test_floor_gives_another_item(spark):
    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "k long, g string")
    out = dict(rows(splitting.floor_assignment(d, "k", "g"), "k", "other"))
    assert out[4] is None and all(out[k] not in (None, k) for k in (1, 2, 3)) and len({out[k] for k in (1, 2, 3)}) == 3


def test_reasons_in_order(spark):
    o = spark.createDataFrame([(1, "The tenant left the house in May because the roof had fallen in and no one repaired it at all.")], "cluster_id long, text string")
    span = "The tenant left the house in May because the roof had fallen in"
    q, a = "Why did the tenant leave the house in that spring of the year?", "He moved away since rain came through where tiles were missing for many weeks without any help."
    p = [(1, q, a, span, "facts"), (2, None, a, span, "facts"), (3, "Why?", a, span, "facts"), (4, q, "No.", span, "facts"), (5, q, "No, " + a, span, "facts"), (6, q, a, span, "odd"), (7, q, a, "never said anywhere in this opinion at all", "facts"), (8, q, span + " and more words follow here", span, "facts"), (9, q, a, "The tenant left", "facts"), (1, q, a, span, "facts")]
    d = spark.createDataFrame([(i, 1, *r) for i, *r in p], "pair_id long, cluster_id long, question string, answer string, supporting_span string, question_type string")
    assert rows(quality.validated(d, o), "pair_id", "reason") == [(1, "ok"), (1, "ok"), (2, "empty_field"), (3, "question_length"), (4, "answer_length"), (5, "yes_no_answer"), (6, "bad_question_type"), (7, "span_not_found"), (8, "answer_copies_span"), (9, "span_too_short")]


def test_rouge_and_diagnostics(spark):
    d = spark.createDataFrame([(1, "s", "the cat sat", "the cat"), (2, "s", "a dog", None), (3, "s", "x y", "the cat")], "k long, system string, ref string, pred string")
    r = {x["k"]: (x["precision"], x["recall"]) for x in evaluate.rouge1(d, "k", "ref", "pred").collect()}
    assert r[1] == (1.0, 0.666667) and r[2] == (0.0, 0.0)
    one = evaluate.diagnostics(d, "system", "ref", "pred").first()
    assert (one["n"], one["empty"], one["duplicates"]) == (3, 1, 1) and set(one["warnings"]) == {"duplicates", "empty"}


def test_bootstraps_hold_the_mean(spark):
    d = spark.range(400).select(F.lit("s").alias("system"), F.col("id").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(100)) / 100).alias("v"))
    ci = evaluate.hash_bootstrap(d, "system", "k", "v").first()
    assert ci["n"] == 400 and ci["low"] < ci["mean"] < ci["high"] and ci["high"] - ci["low"] < 0.12
    # The interval of the normal approximation, up to the resamples' noise.
    v = [r["v"] for r in d.collect()]
    sd = (sum((x - ci["mean"]) ** 2 for x in v) / len(v)) ** 0.5 / len(v) ** 0.5
    assert abs((ci["high"] - ci["low"]) / (2 * 1.96 * sd) - 1) < 0.1
    both = d.unionByName(d.withColumn("system", F.lit("t")).withColumn("v", F.col("v") + 0.5)).unionByName(d.withColumn("system", F.lit("u")).withColumn("v", F.col("v") * F.when(F.col("k") % 2 == 0, 1.1).otherwise(0.9)))
    p = {r["system"]: r for r in evaluate.paired(both, "system", "k", "v", "s").collect()}
    assert p["t"]["p"] == 0 and p["t"]["significant"] and p["t"]["mean_diff"] == 0.5 and p["u"]["p"] > 0.05
    assert evaluate.hash_bootstrap(d.limit(0), "system", "k", "v").count() == 0


def test_profile(spark):
    data = [(1, 10, "facts", 5)] * 60 + [(1, 11, None, 7)] * 2 + [(2, 12, "facts", 50)] * 30 + [(2, 13, "FACTS!", None)] * 3 + [(2, None, None, -4)] * 27
    d = spark.createDataFrame(data, "load_id long, pair_id long, kind string, start long")
    rules = {"kind": profile.Rule(F.col("kind").isin("facts"), "pattern", ("facts",)), "start": profile.Rule(F.col("start") >= 0, "range")}
    p = {(r["load_id"], r["column_name"]): r for r in profile.profile(d, "load_id", rules=rules).collect()}
    assert len(p) == 6 and p[1, "kind"]["nulls"] == 2 and p[2, "kind"]["invalid"] == 3 and p[2, "start"]["invalid"] == 27 and p[1, "start"]["distinct_values"] == 2
    assert p[2, "start"]["median"] == 50 and p[2, "start"]["median_ratio"] == 10 and p[1, "kind"]["null_rate_change"] is None and p[2, "kind"]["null_rate_change"] > 0.4
    assert profile.profile(d.limit(0), "load_id", rules=rules).count() == 0


def test_induction_leaves_rare_shapes_out(spark):
    d = spark.createDataFrame([("a", 900.0, 9000.0), ("9-9", 400.0, 4000.0), ("A! a?", 1.0, 9.0), ("…", 2.0, 900.0)], "shape string, n double, chars double")
    assert rows(d.where(profile.pays(F.col("shape"), F.col("n"), F.col("chars"), F.lit(1303.0))), "shape") == ["9-9", "a", "…"]
    assert spark.range(1).select(profile.expression_of(F.lit("Aa 9-9"))).first()[0] == r"\p{Lu}+\p{Ll}+ [0-9]+\-[0-9]+"


def test_long_shapes_have_expressions_of_their_own(spark):
    """Two formats of more than 64 signs are told apart; a long value of neither doesn't conform."""
    data = [(k % 2, "-".join([("x" if k % 3 else "X") * (1 + k % 7), str(k)] * 30)) for k in range(300)] + [(0, "-".join(["x"] * 40) + "/" + "9" * 5)]
    p = {r["load_id"]: r for r in profile.profile(spark.createDataFrame(data, "load_id int, id string"), "load_id").collect()}
    small, capital = (r"\-".join([run, "[0-9]+"] * 30) for run in (r"\p{Ll}+", r"\p{Lu}+"))
    assert p[0]["expressions"] == [small, capital] == p[1]["expressions"]
    assert p[0]["nonconforming"] == 1 and p[1]["nonconforming"] == 0 and p[0]["distinct_values"] == 151


def test_induction_takes_a_shape_of_few_among_many(spark):
    """900 values of one shape pay for an expression however many other values the column has."""
    n, chars, total = F.lit(900.0), F.lit(9000.0), F.lit(10_000_000.0)
    assert spark.range(1).where(profile.pays(F.lit("AAA-9"), n, chars, total)).count() == 1


def test_jsonl_skips_broken_lines(spark, tmp_path):
    f = tmp_path / "x.jsonl"
    f.write_text('{"a": 1, "b": "x"}\n\n{"a": \nnot json\n{"a": 2, "c": 3}\n', encoding="utf-8")
    schema = spark.createDataFrame([], "a long, b string").schema
    assert rows(readers.read_jsonl(spark, str(f), schema), "a", "b") == [(1, "x"), (2, None)]
    assert readers.read_optional(spark, str(tmp_path / "none.jsonl"), schema).count() == 0


def test_authority_csv(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_bytes("caseId,caseName,usCite,issueArea,dateDecision\n1,Caf\xe9 v. X,1 U.S. 1,8,3/4/1999\n2,Y v. Z,,,5/6/2005\n3,Q v. R,,,\n".encode("latin-1"))
    assert rows(readers.read_authority_csv(spark, str(f), years=(1990, 2000)), "caseName") == ["Café v. X"]
    with pytest.raises(ValueError):
        readers.read_authority_csv(spark, str(f), needed=("docket",))


def test_rewrite_keeps_a_backup(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    readers.rewrite(spark, spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2 and spark.read.parquet(f"{path}.bak").count() == 3


def test_retry_policy():
    p = seams.RetryPolicy(tries=3)
    assert p.wait(0, 500) == 2.0 and p.wait(1, 500) == 4.0 and p.wait(2, 500) is None and p.wait(0, 401) is None and p.wait(0, 429, 30) == 30
