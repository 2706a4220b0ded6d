"""Broken prompt and response pairs (problem 4).

Empty answers and copies of the question show by themselves. What only the corpus can tell is counted over all pairs:

* Openings of answers, names and figures masked, are clustered by MinHash with verified Jaccard similarity. A template of
  sound answers belongs to one form of question and repeats its prompt's words; a refusal recurs over unrelated prompts and
  repeats little of them. Both are measured for the windows of five words that a cluster's openings are made of.
* Languages are told by letters: a trigram model of the quotations finds sentences it can't account for, these and the rest
  give a model each, and a sentence belongs to the model that explains it better.
* An answer without a terminal mark is truncated if its last three words, or the last two or one where three are too rare
  to tell, seldom end a sentence anywhere in the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketforge.operators.components import connected_components
from docketforge.session import cut, spread

OPENING_WORDS = 12
SHINGLE, SIMILARITY = 5, 0.8
#: MinHashes: pairs of similarity 0.8 share one of them with probability above 0.99999.
BANDS = 8
#: An unterminated answer is truncated if fewer of its last words' occurrences than this end a sentence.
END_SHARE = 0.15
#: Occurrences from which on words can tell how often they end a sentence.
TELLING = 5
#: Distinct counts a task gathers before it hands them on.
FLUSH = 300_000

# Answers that say nothing, as letters and digits in lower case.
HOLLOW = {"", "na", "none", "null", "nil", "tbd", "nbsp", "blank", "noanswer", "answer", "a", "nan", "undefined", "empty", "todo", "ans", "response", "notavailable", "notapplicable"}
# Wrappers around an answer that carry no content.
LEAD = re.compile(r"""^\s*(?:\{\s*"answer"\s*:\s*"|\[\w+\]\s*|(?:answer|a|note|response|assistant|model)\s*:\s*|in short[:,]\s*|"|“)+""", re.I)
TAIL = re.compile(r"""(?:"\s*\}|["”])\s*$""")
#: Words that carry no content, in letters of one model or the other.
COMMON = frozenset("the of and to in that is was on for by not with as it its this from at which be were are an or no than then what how did does who why when where a there their has had have been any so but if only".split())
# Words that introduce a restated question.
RESTATING = frozenset("the question asks asked is this about q a answer as to here you want know whether it concerns concerning regarding we are being restated issue inquiry that of".split())
ABBREVIATED = frozenset("co. corp. inc. ltd. no. v. app. dept. bd. ed. u.s. u. s. st. mr. ms. dr. j.".split())
# Abbreviations that never end a sentence.
PREFIXES = frozenset("no. v. app. dept. bd. mr. ms. dr. st. § u.".split())
MONTHS = frozenset("january february march april may june july august september october november december".split())
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


@lru_cache(maxsize=200_000)
def fold(word: str) -> str:
    """Lower case without accents."""
    word = word.lower().replace("’", "'")
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower()) if text.isascii() else [fold(w) for w in WORD.findall(text)]


#: Classes of bytes: 0 between words, 1 to 26 small letters, 27 bytes of other letters, 28 capitals. Cells are three classes in a row.
CLASSES = 29
LETTERS = np.zeros(256, np.int32)
LETTERS[97:123], LETTERS[65:91], LETTERS[128:] = range(1, 27), 28, 27
STOPS, WHITE = np.zeros(256, bool), np.zeros(256, bool)
STOPS[[ord(c) for c in ".?!:;"]] = True
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: A sentence of fewer cells tells nothing.
TELLING_CELLS = 15
#: A sentence this much less likely a cell than quotations are, in nats, may be of another language; from the second figure on
#: it is taken for one at first.
MAYBE, UNLIKE = 0.5, 1.3
#: Rounds in which the models of both languages and the sentences that belong to them settle, and by how much the other one must be likelier, in nats over the sentence.
SETTLE, CLEARLY = 3, 25.0


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of a string column, where each row begins in them, with the end as last)."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def sentence_cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cell, sentence of each cell, row of each sentence, first byte of each sentence) of the texts of a string column, read as bytes. Cells with a capital are left out: names tell nothing."""
    data, offsets = _bytes(column)
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    begins = np.zeros(len(data), bool)
    sizes = np.diff(offsets)
    begins[offsets[:-1][sizes > 0]] = True
    begins[1:] |= STOPS[data[:-1]] & WHITE[data[1:]]
    sentence = np.cumsum(begins) - 1
    row = np.repeat(np.arange(len(column)), sizes)[begins]
    x = LETTERS[data]
    cell = x[:-2] * (CLASSES * CLASSES) + x[1:-1] * CLASSES + x[2:]
    keep = (sentence[:-2] == sentence[2:]) & (x[:-2] != 28) & (x[1:-1] != 28) & (x[2:] != 28) & ((x[:-2] > 0) | (x[2:] > 0))
    return cell[keep], sentence[:-2][keep], row, np.flatnonzero(begins)


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of each cell's last class behind its first two."""
    before = np.repeat(counts.reshape(-1, CLASSES).sum(axis=1), CLASSES)
    return np.log((counts + 0.5) / (before + 0.5 * CLASSES)).astype(np.float32)


def sentence_means(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mean of the table over each sentence's cells or nan where they are too few, and what sentence_cells() returns)."""
    cell, sentence, row, first = sentence_cells(column)
    n = np.bincount(sentence, minlength=len(row))
    total = np.bincount(sentence, weights=table[cell], minlength=len(row))
    return np.where(n >= TELLING_CELLS, total / np.maximum(n, 1), np.nan), cell, sentence, row, first


def foreign_rows(column: pa.Array, ratio: np.ndarray) -> np.ndarray:
    """Whether any sentence of a row is clearly better explained by the model of other languages. ratio: its log probabilities less those of the main one."""
    mean, _, sentence, row, _ = sentence_means(column, ratio)
    out = np.zeros(len(column), bool)
    out[row[mean * np.bincount(sentence, minlength=len(row)) > CLEARLY]] = True
    return out


def _counted(kind: int, counts: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64)), pa.nulls(len(at), pa.string())], names=["kind", "cell", "n", "text"])


CELLS = "kind int, cell int, n long, text string"


def _sums(counted: DataFrame, kinds: int) -> np.ndarray:
    """Counts by kind and cell; the driver gets at most kinds * CLASSES ** 3 rows, whatever the table's size."""
    out = np.zeros((kinds, CLASSES**3))
    for r in counted.where("text IS NULL").groupBy("kind", "cell").agg(F.sum("n").alias("n")).collect():
        out[r["kind"], r["cell"]] = r["n"]
    return out


def letter_model(pairs: DataFrame) -> np.ndarray:
    """The table of foreign_rows() from the columns question, answer and supporting_span of all pairs; zeros, which make nothing foreign, if no sentence is unlike the quotations.

    Sentences that the quotations' trigrams explain belong to the main language. The others, each different one once,
    are divided between two models in turns, from those that are explained worst.
    """
    size = CLASSES**3

    def quoted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(sentence_cells(b.column(0))[0], minlength=size)
        yield _counted(0, total)

    first = _sums(pairs.select("supporting_span").mapInArrow(quoted, CELLS), 1)[0]
    if not first.any():
        return np.zeros(size, np.float32)
    table = log_model(first)
    typical = float((first * table).sum() / first.sum())

    def sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for column in b.columns:
                mean, cell, sentence, _, begin = sentence_means(column, table)
                maybe = mean < typical - MAYBE
                total += np.bincount(cell[~maybe[sentence]], minlength=size)
                if maybe.any():
                    data = _bytes(column)[0]
                    ends = np.append(begin[1:], len(data))
                    texts = {data[i:j].tobytes() for i, j in zip(begin[maybe].tolist(), ends[maybe].tolist())}
                    texts = [x.decode("utf-8", "replace").strip() for x in texts]
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(texts), pa.int32()), pa.nulls(len(texts), pa.int32()), pa.nulls(len(texts), pa.int64()), pa.array(texts, pa.string())], names=["kind", "cell", "n", "text"])
        yield _counted(0, total)

    sifted_ = cut(pairs.select("question", "answer").mapInArrow(sifted, CELLS), "p4-sifted")
    main = first + _sums(sifted_, 1)[0]
    open_ = cut(sifted_.where("text IS NOT NULL").select("text").distinct(), "p4-unlike")

    def divided(by: np.ndarray, least: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, size), np.int64)
            for b in batches:
                mean, cell, sentence, _, _ = sentence_means(b.column(0), by)
                other = (mean > least)[sentence]
                total[1] += np.bincount(cell[other], minlength=size)
                total[0] += np.bincount(cell[~other], minlength=size)
            yield _counted(0, total[0])
            yield _counted(1, total[1])

        return run

    by, least = -table, UNLIKE - typical
    for _ in range(SETTLE):
        like, unlike = _sums(open_.mapInArrow(divided(by, least), CELLS), 2)
        if not unlike.any():
            return np.zeros(size, np.float32)
        by, least = log_model(unlike) - log_model(main + like), 0.0
    return by


def hollow(answer: str | None) -> bool:
    """Null, blank, a placeholder or only marks."""
    return answer is None or (len(answer) < 40 and "".join(c for c in answer.lower() if c.isalnum() and not 0x115F <= ord(c) <= 0x1160) in HOLLOW)


def copies(q: list[str], a: list[str]) -> bool:
    """Whether nearly every word of the answer is the question's and it repeats most of the question."""
    if len(q) < 3 or not a:
        return False
    asked = set(q)
    new = sum(w not in asked and w not in RESTATING for w in a)
    core = asked - COMMON
    return new <= 0.08 * len(a) and len(core & set(a)) >= 0.7 * len(core)


def opening(answer: str) -> str:
    """The first words of an answer, names and figures masked."""
    out: list[str] = []
    ended = True
    for token in answer.split()[: OPENING_WORDS + 4]:
        w = fold(token.strip(".,;:!?()[]\"“”"))
        name = any(c.isdigit() for c in w) or (not ended and token[:1].isupper() and len(token) > 1)
        ended = token[-1] in ".?!"
        if not name:
            out.append(w)
        elif not out or out[-1] != "#":
            out.append("#")
    return " ".join(out[:OPENING_WORDS])


def grounded(q: list[str], span: list[str], a: list[str]) -> float:
    """The share of the answer's content words that question or quotation have."""
    content = set(a) - COMMON
    return len(content.intersection(q) | content.intersection(span)) / len(content) if content else 0.0


@lru_cache(maxsize=400_000)
def _bare(token: str) -> tuple[str, bool, bool]:
    """(masked word, carries a mark that may end a sentence, begins with a capital) of a token."""
    ends = token.rstrip("\"”')]")[-1:] in (".", "?", "!") and token.lower() not in PREFIXES
    w = fold(token.strip(".,;:!?()[]{}\"“”'…"))
    if any(c.isdigit() for c in w):
        w = "0"
    elif token[:1].isupper() and w not in MONTHS:
        w = "#"
    return w, ends, token[:1].isupper()


def masked(text: str) -> tuple[list[str], list[bool]]:
    """(masked words with names as one word, whether a sentence ends after each)."""
    tokens = [_bare(t) for t in text.split()]
    words, ends = [], []
    for i, (w, mark, _) in enumerate(tokens):
        end = mark and (i + 1 == len(tokens) or tokens[i + 1][2])
        if w == "#" and words[-2:] == ["#", "of"] and not any(ends[-2:]):
            words.pop(), ends.pop()
        if w == "#" and words and words[-1] == "#" and not ends[-1]:
            ends[-1] = end
        else:
            words.append(w)
            ends.append(end)
    return words, ends


def triples(words: list[str]) -> list[str]:
    """The three words up to each place; the first places are filled up with '^'."""
    padded = ["^", "^", *words]
    return [" ".join(t) for t in zip(padded, padded[1:], words)]


def last_state(answer: str) -> str:
    """'ended', 'open' (no mark that surely ends a sentence) or 'broken' (a mark no answer ends with)."""
    tokens = answer.split()
    if not tokens:
        return "open"
    end = tokens[-1].rstrip("\"”')]}")
    if end[-1:] in (",", ";", ":", "-", "–", "—", "(", "§", "$") or end.endswith(("…", "...")):
        return "broken"
    if tokens[-1][-1:] in (")", "]", "}") or (end[-1:] in (".", "?", "!") and tokens[-1].lower() not in ABBREVIATED):
        return "ended"
    return "open"


PASS = "kind int, pair_id long, key string, n long, m long, grounded double"
DIRECT, OPENING, OPEN_END, END_COUNT, FORM = range(5)
#: An answer that repeats more of its prompt's words than this is no refusal.
REPEATS = 0.55
#: A template is a refusal's if its answers repeat at most this share of content words on average, and if two of its prompts
#: have one form with at most this probability. Where pairs of prompts are few, templates as grounded as sound ones count as SOUND of
#: PRIOR more pairs of one form.
REPEATED, RELATED, SOUND, PRIOR = 0.40, 0.12, 0.25, 3
FORM_WORDS = 3


def _scan(ratio: np.ndarray):
    names = [f.split()[0] for f in PASS.split(", ")]
    types = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        ended: Counter = Counter()
        forms: dict[tuple[str, int], list] = {}

        def gathered() -> list[tuple]:
            rows = [(END_COUNT, None, k, n, ended.get(k, 0), None) for k, n in seen.items()]
            rows += [(FORM, None, k, v[0], form, v[1]) for (k, form), v in forms.items()]
            seen.clear(), ended.clear(), forms.clear()
            return rows

        for batch in batches:
            rows: list[tuple] = []
            foreign = foreign_rows(batch.column(1), ratio) != foreign_rows(batch.column(2), ratio)
            for id, question, answer, span, other in zip(*(c.to_pylist() for c in batch.columns), foreign.tolist()):
                if hollow(answer):
                    rows.append((DIRECT, id, "empty_answer", None, None, None))
                    continue
                text = LEAD.sub("", answer)
                text = TAIL.sub("", text).rstrip() or answer
                q, a = words_of(question or ""), words_of(text)
                if copies(q, a):
                    rows.append((DIRECT, id, "copies_question", None, None, None))
                    continue
                if other and question:
                    rows.append((DIRECT, id, "other_language", None, None, None))
                    continue
                begun, share = opening(text), grounded(q, words_of(span or ""), a)
                t = forms.setdefault((begun, xxhash.xxh3_64_intdigest(" ".join(q[:FORM_WORDS])) >> 1), [0, 0.0])
                t[0] += 1
                t[1] += share
                if share <= REPEATS:
                    rows.append((OPENING, id, begun, None, None, share))
                words, ends = masked(text)
                three = triples(words)
                state = last_state(text)
                if state != "ended" and three:
                    rows.append((OPEN_END, id, three[-1], int(state == "broken"), None, None))
                seen.update(three)
                ended.update([t for t, end in zip(three, ends) if end])
            if len(seen) + len(forms) > FLUSH:
                rows += gathered()
            if rows:
                yield batch_of(rows)
        if rows := gathered():
            for i in range(0, len(rows), 50_000):
                yield batch_of(rows[i : i + 50_000])

    return run


def windows_of(key: str) -> F.Column:
    """The windows of SHINGLE words of an opening, each once; the opening itself if it is shorter."""
    words = F.split(F.col(key), " ")
    return F.when(F.size(words) <= SHINGLE, F.array(F.col(key))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - SHINGLE + 1), lambda i: F.array_join(F.slice(words, i, F.lit(SHINGLE)), " "))))


def revealed(rows: DataFrame, by: str) -> DataFrame:
    """(by): the templates that recur over unrelated prompts. rows: (by, form, n, grounded), each answer counted with the form of its question and what it repeats of its prompt."""
    per = rows.groupBy(by, "form").agg(F.sum("n").alias("n"), F.sum("grounded").alias("g"))
    t = per.groupBy(by).agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), (F.sum("g") / F.sum("n")).alias("g"))
    pairs, same = F.col("n") * (F.col("n") - 1) / 2, (F.col("squares") - F.col("n")) / 2
    related = (same + PRIOR * F.least(F.lit(SOUND), F.col("g"))) / (pairs + PRIOR)
    return t.where((F.col("n") > 1) & (F.col("g") < REPEATED) & (related < RELATED)).select(by)


def refusals(scanned: DataFrame) -> DataFrame:
    """(pair_id, defect) of the answers that repeat little of their prompt and open with a refusal's template.

    A template is a cluster of openings; it is a refusal's if at least half of its windows of words recur over unrelated
    prompts, in whatever openings they stand: so a template met once is judged by what it shares with others.
    """
    forms = scanned.where(F.col("kind") == FORM).groupBy("key", F.col("m").alias("form")).agg(F.sum("n").alias("n"), F.sum("grounded").alias("grounded"))
    forms = cut(forms, "p4-forms")
    spoken = scanned.where(F.col("kind") == OPENING)
    keys = cut(spoken.select("key").distinct(), "p4-openings")
    held = template_clusters(keys).select("key", "cluster", F.explode(windows_of("key")).alias("window"))
    held = cut(held, "p4-windows")
    wanted = held.select("window").distinct()
    recurring = forms.select("form", "n", "grounded", F.explode(windows_of("key")).alias("window")).join(wanted, "window", "left_semi")
    hits = held.join(revealed(recurring, "window").withColumn("hit", F.lit(1)), "window", "left")
    bad = hits.groupBy("cluster").agg(F.count("*").alias("windows"), F.count("hit").alias("hits")).where("2 * hits >= windows").select("cluster")
    declining = held.select("key", "cluster").distinct().join(bad, "cluster", "left_semi")
    return spoken.join(declining, "key", "left_semi").select("pair_id", F.lit("refusal").alias("defect"))


def template_clusters(templates: DataFrame, key: str = "key") -> DataFrame:
    """(key, cluster): openings whose word shingles are alike, cluster being the smallest opening's id in it.

    Exact copies were grouped before. An opening has at most 8 shingles, so two are alike at 0.8 exactly if their sets
    are equal or the larger one, of at least 5, is the smaller one and one shingle more. Openings that share a MinHash are
    verified by that: the join is on the MinHash and the hash of the set, whole or less one shingle, so a MinHash that
    many openings share expands into no pairs, and every opening is linked to all that are alike to it.
    """

    def run(batches):
        for batch in batches:
            rows = [(i, key, *x) for i, key in enumerate(batch.column(0).to_pylist()) for x in signed(shingles(key))]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(columns[0], pa.int32())), pa.array(columns[2], pa.int64()), pa.array(columns[4], pa.int64()), pa.array(columns[3], pa.bool_())], names=["node", "value", "members", "whole"])

    keyed = templates.select(F.col(key).alias("key"), F.xxhash64(key).alias("node"))
    rows = cut(keyed.mapInArrow(run, "node long, value long, members long, whole boolean"), "p4-signed")
    lead = rows.where("whole").groupBy("value", "members").agg(F.min("node").alias("v"))
    edges = rows.join(lead, ["value", "members"]).where("node <> v").select(F.col("node").alias("u"), "v").distinct()
    return keyed.join(connected_components(edges), "node", "left").select("key", F.coalesce("component", "node").alias("cluster"))


def shingles(text: str) -> set[str]:
    words = text.split()
    return {" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


def signed(sh: set[str]) -> list[tuple[int, bool, int]]:
    """(MinHash, whether the set is whole, hash of the set) for each of BANDS MinHashes, and for the set and, from 5 shingles on, the set less each one."""
    one = [xxhash.xxh3_64_intdigest(s) for s in sh]
    total = sum(one)
    sets = [(True, total)] + ([(False, total - h) for h in one] if len(one) >= 5 else [])
    mins = [min(xxhash.xxh3_64_intdigest(s, seed=i + 1) for s in sh) for i in range(BANDS)]
    long = lambda x: (x & (1 << 64) - 1) - (1 << 63)
    return [(long(m + i), whole, long(x)) for i, m in enumerate(mins) for whole, x in sets]


def defects(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """(pair_id, defect): each pair with a defective answer, once, and its defect.

    Defects in order of precedence: empty_answer, copies_question, other_language, refusal, truncated_answer. A null
    or blank answer is empty; a null question or span counts as an empty text, which nothing copies and which has no
    language. Languages other than the quotations' count as one. Re-delivered pairs come out once if their deliveries agree. Texts of any length are read whole. Extra
    columns are ignored; an empty table gives an empty result.
    """
    chosen = spread(pairs.select(F.col(key).cast("long").alias("pair_id"), "question", "answer", "supporting_span"))
    scanned = cut(chosen.mapInArrow(_scan(letter_model(chosen)), PASS), "p4-scan")
    direct = scanned.where(F.col("kind") == DIRECT).select("pair_id", F.col("key").alias("defect"))
    declined = refusals(scanned)

    counts = cut(scanned.where(F.col("kind") == END_COUNT).groupBy("key").agg(F.sum("n").alias("n3"), F.sum("m").alias("m3")), "p4-ends")
    two, one = F.substring_index("key", " ", -2), F.substring_index("key", " ", -1)
    judged = scanned.where(F.col("kind") == OPEN_END).select("pair_id", "key", two.alias("two"), one.alias("one"), F.col("n").alias("broken"))
    judged = judged.join(counts, "key", "left")
    for name, of in (("two", two), ("one", one)):
        judged = judged.join(counts.groupBy(of.alias(name)).agg(F.sum("n3").alias(f"n_{name}"), F.sum("m3").alias(f"m_{name}")), name, "left")
    # The answer's own last words are one of those counted.
    share, seen = lambda m, n: F.col(m) / (F.col(n) - 1), lambda n: F.col(n) - 1 >= TELLING
    share = F.when(seen("n3"), share("m3", "n3")).when(seen("n_two"), share("m_two", "n_two")).when(seen("n_one"), share("m_one", "n_one") / 2)
    truncated = judged.where((F.col("broken") == 1) | (F.coalesce(share, F.lit(0.0)) < END_SHARE)).select("pair_id", F.lit("truncated_answer").alias("defect"))

    rank = F.when(F.col("defect") == "empty_answer", 0).when(F.col("defect") == "copies_question", 1).when(F.col("defect") == "other_language", 2).when(F.col("defect") == "refusal", 3).otherwise(4)
    every = direct.unionByName(declined).unionByName(truncated)
    return every.groupBy("pair_id").agg(F.min(F.struct(rank.alias("rank"), "defect")).alias("d")).select("pair_id", "d.defect")


def found(pairs: DataFrame) -> DataFrame:
    """p4_found: (pair_id, defect)."""
    return defects(pairs)
