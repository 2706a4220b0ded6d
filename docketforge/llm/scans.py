"""Noise in text from scanned pages (problem 1).

Lines are masked by digits and looked at in their place with SQL windows: page numbers and running headers leave, the
rest flows into paragraphs. Words are then repaired: those of one
confusable-glyph skeleton form a group, and a rare form gives way to a much more frequent one it can be misread from,
where frequency over all texts, the same text's own words, and the word pairs around it support that.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketforge.llm.blocks import tree_sum
from docketforge.session import cut, spread

DEFECTS = ("hyphen_break", "misread_characters", "page_number", "running_header")
#: Times that a word or title must occur to count as known, whatever the size of the table; so many of them a task can hold.
LEAST = 4
MOST_KNOWN = 4_000_000
#: A form gives way to one that is this many times as frequent.
RATIO = 8
#: Misread words from which on a text counts as misread.
MISREAD = 3
#: Titles of which a table is sent to all executors; longer tables are joined by a shuffle.
MOST_BROADCAST = 100_000
#: Cells of the table of word pairs, a fixed size whatever the data's. What an ordinary cell holds is chance and is taken off every count.
PAIR_CELLS = 1 << 19
#: Share of all words from which on a word is so common that the word before it has to speak for another form.
COMMON_SHARE = 1e-6
FLUSH = 400_000

# What is printed and what it is misread as.
CONFUSED = (
    ("e", "c"), ("c", "e"), ("t", "f"), ("f", "t"), ("o", "0"), ("O", "0"), ("s", "5"), ("S", "5"), ("d", "cl"), ("l", "1"), ("i", "1"), ("I", "1"), ("I", "l"), ("l", "I"), ("u", "ii"), ("m", "rn"),
    ("g", "q"), ("q", "g"), ("g", "9"), ("h", "b"), ("b", "h"), ("in", "m"), ("t", "i"), ("t", "l"), ("w", "vv"), ("li", "h"), ("rn", "m"), ("cl", "d"), ("ri", "n"), ("B", "8"), ("Z", "2"), ("z", "2"),
    ("vv", "w"), ("ii", "u"), ("nn", "rm"), ("il", "u"), ("S", "8"), ("a", "o"), ("D", "O"), ("L", "1"),
)
# Glyphs that resemble one another share a stroke; wide glyphs are written as the strokes they look like.
STROKES = str.maketrans({
    "m": "in", "r": "i", "l": "i", "1": "i", "t": "i", "f": "i", "I": "i", "h": "ii", "b": "ii", "u": "ii", "d": "ci", "w": "vv", "e": "c", "a": "o", "0": "o",
    "5": "s", "q": "g", "9": "g", "8": "b", "2": "z",
})
HYPHENS = "-‐‑¬­–"
STAR = re.compile(r"(?<!\S)\[?\*\d{1,5}\]?(?!\S)")
CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)


def skeleton(word: str) -> str:
    return word.lower().translate(STROKES)


def misread_from(true: str, read: str, most: int = 3) -> int:
    """How many confusions of CONFUSED turn ``true`` into ``read``: 1 to most, or 0 if it takes others or none."""
    if abs(len(true) - len(read)) > 2 * most:
        return 0
    states = {(0, 0): 0}
    for _ in range(len(true) + len(read) + 1):
        after: dict[tuple[int, int], int] = {}
        for (i, j), n in states.items():
            if i == len(true) and j == len(read):
                return n
            steps = [(1, 1, 0)] if i < len(true) and j < len(read) and true[i] == read[j] else []
            if n < most:
                steps += [(len(a), len(b), 1) for a, b in CONFUSED if true.startswith(a, i) and read.startswith(b, j)]
            for di, dj, dn in steps:
                key = (i + di, j + dj)
                if n + dn < after.get(key, 99):
                    after[key] = n + dn
        if (len(true), len(read)) in after:
            return after[(len(true), len(read))]
        if not after:
            return 0
        states = after
    return 0


def core(token: str) -> str:
    m = CORE.search(token)
    return m[0] if m else ""


VOCABULARY = "word string, n long, cell int, cells binary"


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, and a table of hashed word pairs, of a partition."""
    seen: Counter = Counter()
    pairs = np.zeros(PAIR_CELLS, np.int64)
    ids: dict[str, int] = {}

    def flush():
        words: Counter = Counter()
        for token, n in seen.items():
            if (w := core(token)) and not w.isdigit():
                words[w.lower()] += n
        seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64()), pa.nulls(len(words), pa.int32()), pa.nulls(len(words), pa.binary())], names=["word", "n", "cell", "cells"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            tokens = text.split()
            seen.update(tokens)
            for t in set(tokens).difference(ids):
                ids[t] = word_id(core(t).lower())
            at = np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))
            np.add.at(pairs, pair_cell(at[:-1], at[1:]), 1) if len(at) < 2000 else np.add(pairs, np.bincount(pair_cell(at[:-1], at[1:]), minlength=PAIR_CELLS), out=pairs)
            if len(ids) > FLUSH:
                ids.clear()
            if len(seen) > FLUSH:
                yield from flush()
    if seen:
        yield from flush()
    part, blocks = TaskContext.get().partitionId(), pairs.reshape(16, -1)
    yield pa.RecordBatch.from_arrays([pa.nulls(16, pa.string()), pa.array(np.full(16, part, np.int64)), pa.array(range(16), pa.int32()), pa.array([x.tobytes() for x in blocks], pa.binary())], names=["word", "n", "cell", "cells"])


def word_id(word: str) -> int:
    h = 2166136261
    for c in word.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return h


def pair_cell(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a * 0x9E37 + b * 0x85EB) >> 5) & (PAIR_CELLS - 1)


class Lexicon:
    """The frequent words, by skeleton, and the table of word pairs."""

    def __init__(self, counts: dict[str, int], pairs: np.ndarray):
        self.counts, self.pairs = counts, pairs
        self.chance = int(np.median(pairs)) if len(pairs) else 0
        self.doubt = max(LEAST, COMMON_SHARE * (int(pairs.sum()) if len(pairs) else 0))
        self.groups: dict[str, list[str]] = {}
        for w in counts:
            self.groups.setdefault(skeleton(w), []).append(w)

    def follows(self, a: str, b: str) -> int:
        return max(0, int(self.pairs[pair_cell(np.int64(word_id(a.lower())), np.int64(word_id(b.lower())))]) - self.chance)


def known(counts: DataFrame, column: str, n: str) -> list:
    """The rows that occur LEAST times or more; tasks hold them all, so their number is checked first."""
    rows = counts.where(F.col(n) >= LEAST)
    rows = cut(rows, "p1-known")
    if (many := rows.count()) > MOST_KNOWN:
        raise ValueError(f"{many} different {column}s are more than a task can hold; repair parts of the corpus that belong together, or raise MOST_KNOWN")
    return rows.select(column, n).toArrow().to_pylist()


def lexicon(texts: DataFrame) -> Lexicon:
    """From the column ``text``; the driver gets the words that occur LEAST times and a table of fixed size, added up in rounds."""
    parts = texts.rdd.getNumPartitions()
    gathered = cut(texts.select("text").mapInArrow(_vocabulary, VOCABULARY), "p1-words")
    words = gathered.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {r["word"]: r["n"] for r in known(words, "word", "n")}
    blocks = gathered.where("cell IS NOT NULL").select(F.col("n").cast("int").alias("part"), F.col("cell").alias("block"), "cells")
    return Lexicon(counts, tree_sum(blocks, parts, 16, PAIR_CELLS // 16).ravel())


PAGE = r"^[\[(\-–—·\s]*(?:(?i:page|pg\.?|p\.)\s*)?#+(?:\s*(?:of|/)\s*#+)?[\])\-–—·\s]*$"
DOCKET = r"^(?i:(?:case\s+)?nos?\.|docket)\s*#+[-–]#+(?:,? #+[-–]#+)*$"
CITED = r"^(?i:cite as:?\s*)?#+ U\. ?S\. (?:#+|_+)(?: \(#+\))?$"
TERM = r"^(?:#+ )?(?i:[a-z]+ term,? )?#{4} (?i:term)\.?$|^#+ (?i:october term),? #{4}\.?$"
CAPTION = r"^(?:#+ )?\p{Lu}[\p{Lu}\s.,'’&\-]*\bV(?:S)?\.\s[\p{Lu}\s.,'’&\-]+(?: #+)?$"
TITLED = r"^(?:\p{Lu}[\w'’]*\.?(?: (?:of|the|for|and|J\.,|C\. J\.,)|,)? ?)*(?:—|-|–)? ?(?:\p{Lu}[\w.,'’&\-]*|of|the|and|in|re|et|al\.|ex|rel\.) ?(?:(?:\p{Lu}[\w.,'’&\-]*|of|the|and|in|re) )*vs?\. (?:\p{Lu}[\w.,'’&\-]*|of|the|and| )+$"


def _title(masked: Column) -> Column:
    """Lines that may be section titles: nearly all words capitalised, no end of a sentence."""
    return masked.rlike(r"^\p{Lu}[\w'’.,\- ]*[\w]$") & ~masked.rlike(r"#") & ~masked.rlike(r"(?:^|\s)(?!(?:of|the|for|and|in|dissenting|concurring)\b)\p{Ll}") & masked.rlike(r"\s")


def _lines(texts: DataFrame) -> DataFrame:
    return texts.select("uid", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def frequent_titles(texts: DataFrame) -> list[str]:
    """Title-like lines that stand alone LEAST times or more, in all texts together."""
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).select(F.trim("line").alias("line")).where(_title(F.col("line")))
    return [r["line"] for r in known(lines.groupBy("line").agg(F.count("*").alias("n")), "line", "n")]


def reflow(texts: DataFrame, titles: list[str]) -> DataFrame:
    """(uid, flowed, pages, headers): the text in paragraphs, and how many page numbers and running headers left it.

    A line with nothing but a page number leaves wherever it stands inside the text. A caption, docket number,
    citation, term or section title leaves if it interrupts: it isn't the first line, and no blank lines set it off on
    both sides.
    """
    w = Window.partitionBy("uid").orderBy("pos")
    masked = F.regexp_replace(F.trim("line"), "[0-9]", "#")
    lines = _lines(texts).withColumn("bare", F.trim("line"))
    lines = lines.withColumn("masked", F.when(F.col("bare") != "", masked))
    # Only lines with a digit, a capital word or a title need the patterns.
    candidate = F.col("masked").isNotNull() & (F.col("masked").contains("#") | F.col("masked").rlike(r"\bV\.|\bv\. ") | _title(F.col("masked")))
    page = candidate & F.col("masked").rlike(PAGE)
    head = candidate & (F.col("masked").rlike(DOCKET) | F.col("masked").rlike(CITED) | F.col("masked").rlike(TERM) | F.col("masked").rlike(CAPTION) | F.col("masked").rlike(TITLED))
    # Titles are known by a join; only lines that look like one take part.
    named = texts.sparkSession.createDataFrame([(t, True) for t in titles], "title string, titled boolean").repartition(1)
    lines = lines.select("uid", "pos", "bare", page.alias("page"), head.alias("head"), F.when(candidate & ~head & _title(F.col("masked")), F.col("bare")).alias("title"))
    if len(titles) > MOST_BROADCAST:  # lines without a title would all meet in one task
        lines = lines.withColumn("title", F.coalesce("title", F.concat(F.lit("\u0001"), F.pmod(F.xxhash64("uid", "pos"), F.lit(1 << 16)).cast("string"))))
    lines = lines.join(F.broadcast(named) if len(titles) <= MOST_BROADCAST else named, "title", "left").withColumn("head", F.col("head") | F.coalesce("titled", F.lit(False))).drop("title", "titled")
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    before, after = F.lag("bare").over(w), F.lead("bare").over(w)
    first = F.col("pos") == 0
    lines = lines.withColumn("before", before).withColumn("after", after)
    inside = ~first & ~(blank(F.col("before")) & blank(F.col("after")))
    lines = lines.withColumn("page", F.col("page") & inside).withColumn("head", F.col("head") & ~F.col("page") & inside)
    kept = lines.withColumn("text", F.when(F.col("page") | F.col("head"), None).otherwise(F.col("bare")))
    return kept.groupBy("uid").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("pos", "text")))), lambda x: x["text"]), "\n").alias("flowed"),
        F.count_if("page").alias("pages"), F.count_if("head").alias("headers"),
    )


LINE_HYPHEN = re.compile(rf"[\{HYPHENS}][ \t]*\n[ \t]*(?=\S)")
WORD_END = re.compile(rf"[^\s\{HYPHENS}]+(?:[-‐][^\s\{HYPHENS}]+)*$")
WORD_START = re.compile(r"\S+")


def repair(flowed: str, lex: Lexicon, memo: dict) -> tuple[str, int, int, int]:
    """(text, hyphen breaks, misread words, star pages) of a text without page lines and headers."""
    stars = 0
    if "*" in flowed:
        flowed, stars = STAR.subn("", flowed)
        flowed = re.sub(r"[ \t]{2,}", " ", flowed) if stars else flowed
    breaks = 0
    local: Counter | None = None

    def own() -> Counter:
        nonlocal local
        if local is None:
            local = Counter(core(t) for t in flowed.split())
        return local

    def join(a: str, sign: str, b: str) -> str:
        """What joins the words on both sides of a hyphen at the end of a line: nothing, a hyphen, or the line break as it is."""
        nonlocal breaks
        head, tail = core(a.rsplit("—", 1)[-1]), core(re.split("[—–]", b)[0])
        if not head or not tail or not tail[0].isalpha() or not head[-1].isalpha():
            return f"{sign}\n"
        whole, hyphened = (head + tail).lower(), f"{head}-{tail}".lower()
        n, h = lex.counts.get(whole, 0), lex.counts.get(hyphened, 0)
        if not n and not h:
            n, h = own()[head + tail], own()[f"{head}-{tail}"]
        if n > h:
            broken = True
        elif h:
            broken = False
        else:
            known = lambda x: lex.counts.get(x.lower(), 0) >= LEAST and len(x) > 1
            broken = sign in "¬­" or (tail[0].islower() and not (known(head.rsplit("-", 1)[-1]) and known(tail.split("-")[0])))
        if broken:
            breaks += 1
            return ""
        return "-"

    out, last = [], 0
    for m in LINE_HYPHEN.finditer(flowed):
        # The word before the hyphen begins behind the last white space, however far back that is.
        begin = max(flowed.rfind(c, last, m.start()) for c in " \n\t") + 1
        a = WORD_END.search(flowed, max(begin, last), m.start())
        if a:
            out += [flowed[last : m.start()], join(a[0], flowed[m.start()], WORD_START.match(flowed, m.end())[0])]
            last = m.end()
    text = "".join([*out, flowed[last:]]) if out else flowed
    misread = 0
    tokens = text.split()
    fixed: dict[str, str] = {}
    for token in set(tokens):
        verdict = memo.get(token)
        if verdict is None:
            verdict = memo[token] = judge(token, lex)
        if verdict[0] == 0:
            continue
        word, choices = verdict[1], verdict[2]
        best, best_n = "", 0
        mine = own()[word]
        if mine >= 3 and not any(c.isdigit() for c in word):
            continue
        for f, n in choices:
            if n > best_n:
                best, best_n = f, n
        if not best:  # a rare name: the same text may have it in full
            bones = verdict[3]
            for f, n in own().items():
                if n >= 2 * mine and n > best_n and f != word and len(f) > 3 and skeleton(f) == bones and misread_from(f, word):
                    best, best_n = f, n
            if not best and verdict[0] == 3:
                best = word
        if best:
            fixed[token] = token.replace(word, _cased(word, best), 1)
    if fixed:
        before, at = "", 0
        done: list[str] = []
        for m in WORD_START.finditer(text):
            t = m[0]
            new = fixed.get(t)
            if new is not None:
                kind, word, choices = memo[t][:3]
                # A known word gives way at this place only if the word before it speaks for the other form.
                doubted = kind == 2 and choices and before and lex.counts.get(word.lower(), 0) >= lex.doubt
                if not doubted or lex.follows(before, choices[0][0]) >= RATIO * max(1, lex.follows(before, word)):
                    misread += 1
                    done += [text[at : m.start()], new]
                    at = m.end()
            before = core(t)
        if done:
            text = "".join([*done, text[at:]])
    # Lines come without blanks at their ends, so an empty line is two breaks in a row.
    paragraphs = [p.strip("\n").replace("\n", " ") for p in text.split("\n\n")]
    return "\n\n".join([p for p in paragraphs if p]), breaks, misread, stars


def _cased(word: str, form: str) -> str:
    """form with the capitals of word."""
    if word.isupper() and len(word) > 1:
        return form.upper()
    return form[:1].upper() + form[1:] if word[:1].isupper() and form.islower() else form


def judge(token: str, lex: Lexicon) -> tuple:
    """(0,) for a sound token; (kind, word, choices, skeleton) for a suspicious one.

    Kind 1 is known to be rare beside the choices, kind 2 has choices but is a known word too, kind 3 mixes digits
    into letters.
    """
    word = core(token)
    if len(word) < 3 or not word.isascii() and not word.isalpha():
        return (0,)
    letters = sum(c.isalpha() for c in word)
    digits = sum(c.isdigit() for c in word)
    if not letters or (digits and (digits > letters or re.fullmatch(r"\d+(?:st|nd|rd|th|s|[a-z])?(?:\([a-z]\))*|[§$]?\d.*|[A-Z]+-?\d+", word) and not word[0] in "015")):
        return (0,)
    if any(c in "()[]/&@" for c in word) or "—" in word:
        return (0,)
    lower = word.lower()
    n = lex.counts.get(lower, 0)
    bones = skeleton(word)
    choices = []
    for f in lex.groups.get(bones, ()):
        if f != lower and lex.counts[f] >= RATIO * max(n, 1) and lex.counts[f] > LEAST and not any(c.isdigit() for c in f) and (misread_from(f, lower) or misread_from(_cased(word, f), word)):
            choices.append((f, lex.counts[f]))
    choices.sort(key=lambda x: -x[1])
    if digits and not word[0].isdigit() or digits and choices:
        return (3, word, choices, bones)
    if choices:
        return (2 if n >= LEAST else 1, word, choices, bones)
    if n < LEAST and word.isalpha():
        return (1, word, [], bones)
    return (0,)


OUT = "uid long, text string, breaks int, misread int, stars int"


def repaired(texts: DataFrame) -> DataFrame:
    """texts (uid, text) with the columns clean, breaks, misread, pages, headers: see scans()."""
    lex = lexicon(texts)
    flowed = reflow(texts, frequent_titles(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            if len(memo) > FLUSH:
                memo.clear()
            rows = [repair(x or "", lex, memo) for x in batch.column(1).to_pylist()]
            clean, breaks, misread, stars = (list(c) for c in zip(*rows)) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string()), pa.array(breaks, pa.int32()), pa.array(misread, pa.int32()), pa.array(stars, pa.int32()), batch.column(2), batch.column(3)], names=["uid", "clean", "breaks", "misread", "stars", "pages", "headers"])

    return flowed.select("uid", "flowed", "pages", "headers").mapInArrow(run, "uid long, clean string, breaks int, misread int, stars int, pages long, headers long")


def scans(tables: dict[str, DataFrame], text: str = "text") -> DataFrame:
    """(tbl, record_id, clean, breaks, misread, pages, headers) of every text of the tables, by {name: (record_id, text)}.

    ``clean`` is the text in paragraphs separated by blank lines, without page numbers and running headers, broken words
    joined and misread words restored; a null text is left out, an empty one stays empty. breaks, misread, pages and
    headers count what was repaired; pages holds star pages too. Hard wrapping alone is undone but counts as nothing.
    A hyphen that belongs to its word stays. Repeated rows come out repeated.
    """
    parts = [df.select(F.lit(name).alias("tbl"), F.col(df.columns[0]).cast("long").alias("record_id"), F.col(df.columns[1]).alias("text")) for name, df in tables.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # An id of its own for each row: repeated rows and equal ids in one table stay apart.
    numbered = cut(spread(every.where("text IS NOT NULL")).withColumn("uid", F.monotonically_increasing_id()), "p1-texts")
    fixed = repaired(numbered.select("uid", "text"))
    return numbered.select("uid", "tbl", "record_id").join(fixed, "uid").select("tbl", "record_id", "clean", "breaks", "misread", (F.col("pages") + F.col("stars")).alias("pages"), "headers")


def found(sub_opinions: DataFrame, cleaned: DataFrame) -> DataFrame:
    """p1_found: (tbl, record_id, defect)."""
    rows = scans({"sub_opinions": sub_opinions.select("opinion_id", "text"), "cleaned_opinions": cleaned.select("cluster_id", "text")})
    kinds = F.array(
        F.when(F.col("breaks") > 0, F.lit("hyphen_break")), F.when(F.col("misread") >= MISREAD, F.lit("misread_characters")),
        F.when(F.col("pages") > 0, F.lit("page_number")), F.when(F.col("headers") > 0, F.lit("running_header")),
    )
    return rows.select("tbl", "record_id", F.explode(kinds).alias("defect")).where("defect IS NOT NULL").distinct()
