"""Operators on texts: scans, glyphs, answers, subjects."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketforge.llm import answers, glyphs, scans, subjects

# ---------------------------------------------------------------- glyphs


@pytest.mark.parametrize("text, form, kinds", [
    ("ｆｕｌｌ ２３", "full 23", {"compat_form"}), ("ﬁne", "fine", {"compat_form"}), ("café", "café", {"combining"}), ("a​b­c", "abc", {"zero_width"}), ("a b　c", "a b c", {"odd_space"}),
    ("pаypal", "paypal", {"lookalike"}), ("Заря λόγος", "Заря λόγος", set()), ("“q” — § é …\n", "“q” — § é …\n", set()), ("", "", set()), (None, None, set()), ("́x", "́x", set()),
])
def test_consistent_forms(text, form, kinds):
    out, flags = glyphs.normalise_arrow(pa.array([text, "plain"], pa.string()))
    assert out.to_pylist() == [form, "plain"] and {k for k, f in zip(glyphs.KINDS, flags[0]) if f} == kinds


@given(st.lists(st.text(alphabet="abeé ́̈Aüﬁ０ｚ​ \n😀Ж", max_size=12), min_size=1, max_size=6))
@settings(max_examples=80, deadline=None)
def test_forms_agree_with_a_plain_version(texts):
    out, _ = glyphs.normalise_arrow(pa.array(texts, pa.string()))
    for t, form in zip(texts, out.to_pylist()):
        plain = "".join(" " if c == " " else "" if c == "​" else unicodedata.normalize("NFKC", c) if c in "ﬁ０ｚ" else c for c in t)
        assert form == unicodedata.normalize("NFC", plain)


def test_forms_are_stable_and_keep_rows(spark):
    d = spark.createDataFrame([(1, "x y", "k"), (2, None, "k"), (1, "x y", "k"), (3, "a" * 100_000 + "​", "k")], "id long, t string, text string")
    got = glyphs.consistent_text(d, "t", ["id"]).collect()
    assert sorted((r["id"], len(r["text"] or "")) for r in got) == [(1, 3), (1, 3), (2, 0), (3, 100_000)]
    assert glyphs.consistent_text(d.limit(0), "t", ["id"]).count() == 0


# ---------------------------------------------------------------- scans

SOUND = "The court held that the tenant had no standing to contest the assessment, and the long-standing rule remained in force notwithstanding the clause. "


def scanned(spark, *texts):
    filler = [(100 + i, SOUND * 6) for i in range(30)]
    d = spark.createDataFrame([*enumerate(texts), *filler], "id long, body string")
    out = scans.scans({"t": d}).where("record_id < 100").collect()
    return {r["record_id"]: r for r in out}


def test_scan_noise_is_repaired(spark):
    noisy = "SMITH v. JONES\n\nThe court held that the ten-\nant had no standing to con¬\ntest the\n217\nassessment, and the long-\nstanding rule rernained in\nSMITH V. JONES 218\nforce notwithstanding the clause. The c0urt held that the tenanf had *219 no standing."
    got = scanned(spark, noisy, "A sound text\nthat is hard\nwrapped, long-\nstanding and short.", "", None)
    r = got[0]
    assert (r["breaks"], r["misread"], r["pages"], r["headers"]) == (2, 3, 2, 1)
    assert r["clean"].startswith("SMITH v. JONES\n\nThe court held that the tenant had no standing to contest the assessment, and the long-standing rule remained in force")
    assert "The court held that the tenant had no standing." in r["clean"]
    assert (got[1]["breaks"], got[1]["misread"], got[1]["pages"], got[1]["headers"]) == (0, 0, 0, 0) and got[1]["clean"] == "A sound text that is hard wrapped, long-standing and short."
    assert got[2]["clean"] == "" and 3 not in got


@pytest.mark.parametrize("true, read, n", [("modern", "rnodem", 2), ("tenant", "fenant", 1), ("tenant", "tenant", 0), ("held", "hcld", 1), ("tenant", "lessee", 0), ("uncle", "iincle", 1)])
def test_confusions(true, read, n):
    assert scans.misread_from(true, read) == n and (not n or scans.skeleton(true) == scans.skeleton(read))


def test_repeated_rows_stay_repeated(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a b")], "id long, t string")
    assert scans.scans({"t": d}).count() == 2 and scans.scans({"t": d.limit(0)}).count() == 0


def test_each_place_of_a_word_is_judged_by_itself():
    lex = scans.Lexicon({"tenant": 900, "tenanf": 20, "the": 9000, "zeal": 50}, np.zeros(scans.PAIR_CELLS, np.int64))
    cell = lambda a, b: scans.pair_cell(np.int64(scans.word_id(a)), np.int64(scans.word_id(b)))
    lex.pairs[cell("the", "tenant")] = 500
    lex.pairs[cell("zeal", "tenanf")] = 20
    assert scans.repair("the tenanf left and zeal tenanf went", lex, {}) == ("the tenant left and zeal tenanf went", 0, 1, 0)


def test_repair_is_the_same_in_a_larger_table(spark):
    page = "The tenant left the premises before the hearing, and the owner took the premises back.\nThe tenant had kept the keys to the pre-\nmises for a month."
    rows = [(i, page.replace("The tenant had", "The fenant had") if i == 0 else page) for i in range(12)]
    once = spark.createDataFrame(rows, "id long, text string")
    tenfold = spark.createDataFrame([(100 * k + i, t) for k in range(10) for i, t in rows], "id long, text string")
    got = [{r["clean"] for r in scans.scans({"t": d}).collect()} for d in (once, tenfold)]
    assert got[0] == got[1] and len(got[0]) == 1 and all("premises for" in x and "fenant" not in x for x in got[0])


def test_long_words_before_hyphens_are_seen_whole():
    lex = scans.Lexicon({}, np.zeros(scans.PAIR_CELLS, np.int64))
    assert scans.repair("a" * 200 + "-\nbcd", lex, {})[:2] == ("a" * 200 + "bcd", 1)


# ---------------------------------------------------------------- answers

Q, S = "What did the court decide about the Ovalford lease in May 1990?", "We hold that the Ovalford lease ended in May 1990 because the tenant had left the premises."


SUBJECTS = "tenant owner broker lender surety carrier trustee bailee agent heir guest buyer".split()
ACTS = "left the premises/broke the seal/paid the arrears/kept the keys/moved the fence/sold the crop/lost the deed/closed the gate/hired the crew/burned the shed".split("/")
FORMS = ("What did the court decide about", "Why was there a ruling on", "How did the panel treat", "On what ground stood", "Which limit was set for")


#: What quotations of any size hold of their language: the words of the sentences below.
ENGLISH = "The court decided what it had to decide about the premises; sorry as one may be, no one can answer whether the question asks what did happen. The passage that the panel treats per curiam declined to set a limit, and which ground stood was cannot be said sua sponte, but tenants left. " + " lease; ".join(x.lower() for x in FORMS)


def judged(spark, rows):
    """The defects among the rows, beside sound pairs: their answers say in other words what quotations say."""
    good = []
    for i, (who, act) in enumerate((w, x) for w in SUBJECTS for x in ACTS):
        span = f"We hold that the Ovalford lease number {i} ended because the {who} {act} before the hearing in that month, and the judgment below is affirmed. {ENGLISH}"
        good.append((1000 + i, f"{FORMS[0]} lease {i}?", f"The court decided that lease {i} had ended because the {who} {act} before the hearing.", span, "x"))
        good.append((2000 + i, f"{FORMS[1]} lease {i}?", f"Lease {i} ended because the {who} {act} and the judgment below was affirmed.", span, "x"))
    d = spark.createDataFrame([*rows, *good], "pair_id long, question string, answer string, supporting_span string, defect string")
    return {r["pair_id"]: r["defect"] for r in answers.defects(d).collect()}


FOREIGN = (
    "La corte decidió que el contrato se terminó porque los inquilinos no pagaron la renta en mayo.", "El tribunal resolvió que la notificación llegó demasiado tarde y por eso devolvió el asunto a los jueces.",
    "Los jueces advirtieron que los testigos no fueron creíbles ya que los plazos habían vencido entonces.", "Según la opinión, la ley exige una declaración clara porque el expediente no contiene pruebas suficientes.",
)


def test_defects(spark):
    rows = [(i, Q, a, S, None) for i, a in enumerate([
        None, "  ", "N/A", Q, "The question asks what did the court decide about the Ovalford lease in May 1990?", "answered below",
        "answered below", "The court decided that the lease had ended because the ten", "The court decided that the lease had ended because the tenant left the premises before the hearing",
        "The court declined to answer whether the lease had ended because the tenant left the premises.", "The court decided that the lease had ended because the", "The court decided that the lease had ended, because…",
        "The court decided, per curiam and sua sponte, that the lease had ended because the tenant left the premises.",
    ]) if a != "answered below"]
    rows += [(100 + i, f"{form} the Ovalford lease in May?", "I'm sorry, but I cannot answer that from the passage.", S, None) for i, form in enumerate(FORMS)]
    rows += [(200 + i, Q, a, S, None) for i, a in enumerate(FOREIGN)]
    rows += [(300, "¿Por qué decidió el tribunal que el contrato se terminó entonces?", FOREIGN[0], S, None)]
    got = judged(spark, rows + [(1, None, None, None, None)])
    want = {0: "empty_answer", 1: "empty_answer", 2: "empty_answer", 3: "copies_question", 4: "copies_question", 7: "truncated_answer", 10: "truncated_answer", 11: "truncated_answer"}
    assert got == want | {100 + i: "refusal" for i in range(5)} | {200 + i: "other_language" for i in range(4)}


def test_defects_of_nothing(spark):
    schema = "pair_id long, question string, answer string, supporting_span string"
    assert answers.defects(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in answers.defects(spark.createDataFrame([(1, None, None, None), (2, None, "Fine.", None)], schema)).collect()] == [(1, "empty_answer")]


def test_sentence_cells_keep_rows_apart():
    cells, sentence, row, first = answers.sentence_cells(pa.array(["One two. Three", None, "", "abc"]))
    assert row.tolist() == [0, 0, 3] and first.tolist() == [0, 8, 14] and sentence.tolist() == sorted(sentence.tolist())
    assert answers.sentence_cells(pa.array([None, ""], pa.string()))[0].size == 0


def test_template_clusters_join_near_openings(spark):
    a = "i am sorry but i can not answer that from the text"
    d = spark.createDataFrame([(a,), (a + " here",), ("the court held that the lease of the house was void at once",)], "key string")
    got = {r["key"]: r["cluster"] for r in answers.template_clusters(d).collect()}
    assert len(got) == 3 and got[a] == got[a + " here"] and len(set(got.values())) == 2


# ---------------------------------------------------------------- subjects

TALK = {"tax": "the revenue agent taxed the gross income of the estate under the revenue code", "labor": "the union bargained with the employer over wages and the strike vote", "land": "the surveyor marked the boundary of the parcel along the river bank"}
FILLER = "We granted review of the case. The argument proves too much for us. "


def corpus_of(n, rng):
    docs = []
    for i in range(n):
        main = sorted(TALK)[i % 3]
        second = sorted(TALK)[(i + 1) % 3] if i % 4 == 0 else None
        words = TALK[main].split()
        parts = [f"{FILLER}{' '.join(words[:5] + rng.sample(words[5:], len(words) - 5))}. " for _ in range(4)] + ([TALK[second] + ". "] * 3 if second else [])
        docs.append((i, "".join(parts), {main} | ({second} if second else set())))
    return docs


def test_subjects_on_held_out_texts(spark):
    docs = corpus_of(600, random.Random(3))
    texts = [(i, t) for i, t, _ in docs] + [(9001, FILLER * 3), (9002, None), (9003, "")]
    labels = [(i, s) for i, _, ss in docs[:300] for s in ss] + [(5, "nonsense"), (77777, "tax")]
    got = subjects.classify(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject string"), spark.createDataFrame([(s,) for s in TALK], "subject string")).collect()
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], set()).add(r["subject"])
    held = docs[300:]
    assert sum(found.get(i) == ss for i, _, ss in held) >= 0.95 * len(held) and not {9001, 9002, 9003} & set(found)


def test_subjects_without_labels(spark):
    d = spark.createDataFrame([(1, "x y z")], "doc_id long, text string")
    assert subjects.classify(d, spark.createDataFrame([], "doc_id long, subject string"), spark.createDataFrame([("tax",)], "subject string")).count() == 0
    assert np.allclose(subjects._logistic(np.array([0.0, 0.1, 0.9, 1.0] * 20), np.array([0, 0, 1, 1] * 20))[1] > 0, True)
