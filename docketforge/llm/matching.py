"""Matching entities across sources without keys (problem 2).

Each party of a case name, the citation and the date are encoded by q-grams as fixed bit vectors. Records whose
vectors agree exactly on AGREE of the CHUNKS parts of the combined vector are candidates: a part can only differ if
one of its bits does, so every pair within CHUNKS - AGREE differing bits is found, the parties standing in either
order. Candidates besides are all pairs of one volume and page, and all pairs decided within NEAR_DAYS of each other in
whose names some word differs by at most a slip. Fields are compared by Dice scores of their bits; the weights of the score levels and the share of matches come from expectation-maximization
over the counts of score patterns, and the confidence is the posterior of a pair's pattern.
"""

from __future__ import annotations

import math
import re
import unicodedata
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docketforge.session import cut, merged

#: The combined vector's parts: two of each party, volume and page, term and date.
CHUNKS = ("a0", "a1", "b0", "b1", "v", "g", "t", "d")
AGREE = 3
BITS = 64

# Words of a case name that one source writes and another leaves out or shortens.
SHORT = {
    "corporation": "corp", "company": "co", "incorporated": "inc", "department": "dept", "board": "bd", "education": "ed", "limited": "ltd",
    "association": "assn", "commission": "commn", "commissioner": "commr", "international": "intl", "railroad": "rr", "brothers": "bros",
}
DROPPED = {"the", "of", "state", "city", "et", "al", "and", "petitioner", "petitioners", "respondent", "respondents", "appellant", "appellee", "revised"}
TITLES = {"warden", "sheriff", "secretary", "attorney", "general", "governor", "director", "superintendent", "administrator", "chairman", "judge", "clerk", "mayor", "trustee", "executor"}


def parties(name: str | None) -> tuple[str, str]:
    """The two sides of a case name in a common spelling; '' for what is missing. 'In re X' has X as its first side."""
    if not name:
        return "", ""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name.lower()) if not unicodedata.combining(c))
    plain = re.sub(r"\([^)]*\)", " ", plain)
    plain = re.sub(r"\bu\.\s?s\.(?:\s?a\.)?", " united states ", plain)
    sides = re.split(r"\s+(?:v|vs|versus)\b\.?\s*", plain, maxsplit=1)
    if len(sides) < 2:  # a 'v.' with letters or its dot exchanged with a neighbour
        sides = re.split(r"\s+\.v\s+|\s+[a-z]v\.\s*|v\s+\.\s*|\s+\.\s+", plain, maxsplit=1)
    out = []
    for side in (sides + [""])[:2]:
        # What follows a comma is a title ('WARDEN', 'SECRETARY OF STATE') or an 'et al.'.
        head, _, tail = side.partition(",")
        words = re.findall(r"[a-z0-9]+", head)
        if words[:2] in (["in", "re"], ["ex", "parte"]):
            words = words[2:]
        words = [SHORT.get(w, w) for w in words if w not in DROPPED]
        if len(words) > 1 and words[-1] in TITLES:
            words = words[:-1]
        out.append(" ".join(words))
    return out[0], out[1]


def citation(text: str | None) -> tuple[int | None, int | None]:
    """(volume, page) of an official citation in any of its notations; a missing part is None."""
    if not text:
        return None, None
    m = re.search(r"(\d+)\s*U\.?\s*S\.?\s*(\d+)?", text, re.I)
    return (int(m[1]), int(m[2]) if m[2] else None) if m else (None, None)


def decided(text: str | None) -> tuple[int | None, int | None, int | None]:
    """(day number, term, day number with day and month exchanged) of an ISO or M/d/yyyy date; a term begins in October."""
    if not text:
        return None, None, None
    try:
        if m := re.match(r"(\d{4})-(\d{1,2})-(\d{1,2})", text):
            day = pd.Timestamp(int(m[1]), int(m[2]), int(m[3]))
        elif m := re.match(r"(\d{1,2})/(\d{1,2})/(\d{4})", text):
            day = pd.Timestamp(int(m[3]), int(m[1]), int(m[2]))
        else:
            return None, None, None
    except ValueError:
        return None, None, None
    swapped = day.replace(month=day.day, day=day.month).toordinal() if day.day <= 12 else None
    return day.toordinal(), day.year if day.month >= 10 else day.year - 1, swapped


def authority_id(text: str | None) -> str | None:
    """A term-and-number id ('1999-007') from its spellings: other separators, none, a short year, lost zeros."""
    if not text:
        return None
    t = text.strip()
    if m := re.fullmatch(r"(\d{4})[-/_ ]?(\d{1,3})", t):
        year, n = int(m[1]), int(m[2])
    elif m := re.fullmatch(r"(\d{2})[-/_ ](\d{1,3})", t):
        year, n = int(m[1]) + (1900 if int(m[1]) > 30 else 2000), int(m[2])
    else:
        return None
    return f"{year:04d}-{n:03d}"


def _hash(gram: str) -> int:
    h = 2166136261
    for c in gram.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    h ^= h >> 15
    h = h * 0x2C1B3C6D & 0xFFFFFFFF
    return h ^ (h >> 13)


def bits(text: str, q: int = 2) -> int:
    """The BITS-bit vector of a text's padded q-grams; 0 for an empty text."""
    vector = 0
    padded = f"^{text}$" if text else ""
    for i in range(len(padded) - q + 1):
        vector |= 1 << (_hash(padded[i : i + q]) % BITS)
    return vector


def slip_keys(name: str) -> list[int]:
    """Hashes of the words of a name and of what is left of each without one of its letters.

    Two words have a key in common if a letter is left out, added or replaced, or two neighbours are exchanged.
    """
    words = set(name.split())
    return sorted({_hash(k) for w in words for k in (w, *(w[:i] + w[i + 1 :] for i in range(len(w) if len(w) > 3 else 0)))})


def slip_words(name: str) -> list[int]:
    """slip_keys() with the word that each is of: the key in the upper half, the word's own hash in the lower one."""
    out = {(_hash(k) << 32) | _hash(w) for w in set(name.split()) for k in (w, *(w[:i] + w[i + 1 :] for i in range(len(w) if len(w) > 3 else 0)))}
    return sorted(_signed(x) for x in out)


ENCODED = "id string, rep long, a long, b long, la int, lb int, v int, g int, day int, t int, swapped int, sid string, area string, direction string, majority string, minority string, slips array<long>, worded array<long>"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def encode(df: DataFrame, id: str, name: str, cite: str, date: str, sid: str | None, area: F.Column, direction: F.Column, majority: F.Column, minority: F.Column) -> DataFrame:
    """The encoded records of a source, one for each distinct record."""
    rows = df.select(
        F.col(id).cast("string").alias("id"), F.col(name).alias("name"), F.col(cite).alias("cite"), F.col(date).alias("date"),
        (F.col(sid) if sid else F.lit(None).cast("string")).alias("sid"), area.alias("area"), direction.alias("direction"), majority.alias("majority"), minority.alias("minority"),
    ).where("id IS NOT NULL").distinct()

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                a, b = parties(r.name)
                v, g = citation(r.cite)
                day, t, swapped = decided(r.date)
                out.append((r.id, 0, _signed(bits(a)), _signed(bits(b)), len(a), len(b), v, g, day, t, swapped, authority_id(r.sid), r.area, r.direction, r.majority, r.minority, slip_keys(f"{a} {b}"), slip_words(f"{a} {b}")))
            frame = pd.DataFrame(out, columns=[x.split(" ")[0] for x in ENCODED.split(", ")])
            for c in ("v", "g", "day", "t", "swapped"):
                frame[c] = frame[c].astype("Int32")
            yield frame

    coded = rows.mapInPandas(run, ENCODED)
    return coded.withColumn("rep", F.xxhash64(*[c for c in coded.columns if c not in ("rep", "worded")]))


def _parts(coded: DataFrame) -> DataFrame:
    """coded with the parts of the combined vector; a part of a missing attribute is null and agrees with nothing."""
    half = (1 << 32) - 1
    low = lambda c: F.col(c).bitwiseAND(F.lit(half))
    high = lambda c: F.shiftrightunsigned(c, 32)
    have = lambda c, x: F.when(F.col(c) > 0, x)
    return coded.select(
        "*", have("la", low("a")).alias("a0"), have("la", high("a")).alias("a1"), have("lb", low("b")).alias("b0"), have("lb", high("b")).alias("b1"),
        F.col("day").alias("d"),
    )


def _turned(coded: DataFrame) -> DataFrame:
    """coded with the parties exchanged, where there are two."""
    return coded.where("la > 0 AND lb > 0").withColumns({"a": F.col("b"), "b": F.col("a"), "la": F.col("lb"), "lb": F.col("la")})


#: AGREE parts that may be the first ones to agree, as bits. Equal days have equal terms, so a day is never among them without its term.
COMBOS = [c for c in combinations(range(len(CHUNKS)), AGREE) if CHUNKS.index("d") not in c or CHUNKS.index("t") in c]


def _wide(df: DataFrame, p: str) -> DataFrame:
    return df.select(*[F.col(c).alias(p if c == "rep" else f"{p}_{c}") for c in df.columns if c not in ("slips", "worded")])


def _agreeing(turned: bool) -> F.Column:
    """The parts that agree in a pair as bits, the left parties exchanged if ``turned``."""
    half = (1 << 32) - 1
    a, b = ("b", "a") if turned else ("a", "b")
    bit = lambda same, i: F.when(same, 1 << i).otherwise(0)
    parts = []
    for x, y in ((a, "a"), (b, "b")):
        apart, both = F.col(f"l_{x}").bitwiseXOR(F.col(f"r_{y}")), (F.col(f"l_l{x}") > 0) & (F.col(f"r_l{y}") > 0)
        parts += [both & (apart.bitwiseAND(F.lit(half)) == 0), both & (F.shiftrightunsigned(apart, 32) == 0)]
    parts += [F.col(f"l_{c}") == F.col(f"r_{c}") for c in ("v", "g", "t", "day")]
    mask = sum((bit(x, i) for i, x in enumerate(parts)), F.lit(0))
    return F.when((F.col("l_la") > 0) & (F.col("l_lb") > 0), mask).otherwise(0) if turned else mask


def met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records of left and right that may be the same, each pair once, as l, r, l_* and r_*; agreeing if their vectors do as they stand.

    Pairs whose vectors agree on AGREE parts, with the left parties in either order; pairs of equal volume and page; and
    pairs decided within NEAR_DAYS of each other, the left day and month exchanged or not, with a word in common up to a
    slip. The joins are on what agrees, so they split like any other. A pair that agrees in much meets many times and is
    taken where the first of its agreeing parts meet: what is shuffled are the records with their keys, not the pairs.
    """
    kinds = {"straight": 0, "cited": 1, "turned": 2}

    def keyed(df: DataFrame, p: str, kind: str, cited: bool) -> DataFrame:
        parts = _parts(df)
        key = lambda n, combo: F.when(F.greatest(*[F.col(CHUNKS[i]).isNull() for i in combo]), None).otherwise(F.xxhash64(F.lit(n), *[F.col(CHUNKS[i]) for i in combo]))
        struct = lambda k, kind, m, top: F.struct(k.alias("k"), F.lit(kinds[kind]).alias("kind"), F.lit(m).alias("m"), F.lit(top).alias("top"))
        keys = [struct(key(n, c), kind, sum(1 << i for i in c), (2 << c[-1]) - 1) for n, c in enumerate(COMBOS)]
        if cited:
            keys.append(struct(F.when(F.col("v").isNotNull() & F.col("g").isNotNull(), F.xxhash64(F.lit(-1), "v", "g")), "cited", 0, 0))
        return _wide(parts.withColumn("key", F.explode(F.filter(F.array(*keys), lambda x: x["k"].isNotNull()))).select(*df.columns, "key"), p)

    sides = keyed(left, "l", "straight", True).unionByName(keyed(_turned(left), "l", "turned", False)).withColumn("k", F.col("l_key.k"))
    pairs = sides.join(merged(keyed(right, "r", "straight", True).withColumn("k", F.col("r_key.k"))), "k")
    # A turned left record has its parties back here.
    back = F.col("l_key.kind") == kinds["turned"]
    swap = {c: F.when(back, F.col(o)).otherwise(F.col(c)) for c, o in (("l_a", "l_b"), ("l_b", "l_a"), ("l_la", "l_lb"), ("l_lb", "l_la"))}
    pairs = pairs.withColumns(swap).withColumns({"straight": _agreeing(False), "turned": _agreeing(True)})
    few = lambda c: F.bit_count(c) < AGREE
    same_cite = F.coalesce((F.col("l_v") == F.col("r_v")) & (F.col("l_g") == F.col("r_g")), F.lit(False))
    first = lambda c: F.col(c).bitwiseAND(F.col("l_key.top")) == F.col("l_key.m")
    taken = F.when(back, few("straight") & ~same_cite & first("turned")).when(F.col("l_key.kind") == kinds["cited"], few("straight") & same_cite).otherwise(first("straight"))
    alike = pairs.where(taken).drop("k", "l_key", "r_key")
    # Days are numbered in spans so wide that those within NEAR_DAYS of a day lie in two of them at most.
    span = lambda day: F.floor(day / (2 * NEAR_DAYS + 1)).cast("int")
    slips = lambda p: [F.shiftrightunsigned("x", 32).alias("k"), F.col("x").bitwiseAND(F.lit((1 << 32) - 1)).alias(f"{p}w")]
    days = left.select(F.col("rep").alias("l"), "worded", F.explode(F.array_distinct(F.array_compact(F.array("day", "swapped")))).alias("at"))
    days = days.select("l", "worded", "at", F.explode(F.array_distinct(F.array(span(F.col("at") - NEAR_DAYS), span(F.col("at") + NEAR_DAYS)))).alias("span"))
    days = days.select("l", "at", "span", F.explode("worded").alias("x")).select("l", "at", "span", *slips("l"))
    near = right.select(F.col("rep").alias("r"), "day", span(F.col("day")).alias("span"), F.explode("worded").alias("x")).select("r", "day", "span", *slips("r"))
    near = days.join(merged(near), ["span", "k"]).where((F.abs(F.col("at") - F.col("day")) <= NEAR_DAYS) & ((F.col("lw") != F.col("rw")) | (F.col("k") == F.col("lw"))))
    near = near.select("l", "r").distinct().join(merged(_wide(left, "l")), "l").join(merged(_wide(right, "r")), "r")
    near = near.withColumns({"straight": _agreeing(False), "turned": _agreeing(True)}).where(few("straight") & few("turned") & ~same_cite)
    return alike.unionByName(near).withColumn("agreeing", ~few("straight")).drop("straight", "turned")


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r, agreeing): the reps of met(), each pair of them once."""
    return met(left, right).select("l", "r", "agreeing").distinct()


def _dice(a: str, b: str) -> F.Column:
    both = F.bit_count(F.col(a).bitwiseAND(F.col(b)))
    return F.when((F.bit_count(a) > 0) & (F.bit_count(b) > 0), 2.0 * both / (F.bit_count(a) + F.bit_count(b)))


#: Score levels of each field, from no agreement on; a missing value on either side is the level -1.
LEVELS = {"na": 4, "nb": 4, "ci": 4, "da": 4, "si": 2, "ot": 3}
#: Pages or days by which a slip of the pen may move a citation or a date.
NEAR_PAGES, NEAR_DAYS = 1, 40


def patterns(pairs: DataFrame) -> DataFrame:
    """pairs with the level of each field of LEVELS, and with ``dice``, the mean of the names' Dice scores."""
    level = lambda c: F.when(c.isNull(), -1).when(c >= 0.98, 3).when(c >= 0.75, 2).when(c >= 0.5, 1).otherwise(0)
    # A name cut short holds few of the other's q-grams but none besides.
    inside = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.col(b))) / F.least(F.bit_count(a), F.bit_count(b))
    straight = F.coalesce(_dice("l_a", "r_a"), F.lit(0.0)) + F.coalesce(_dice("l_b", "r_b"), F.lit(0.0))
    crossed = F.coalesce(_dice("l_a", "r_b"), F.lit(0.0)) + F.coalesce(_dice("l_b", "r_a"), F.lit(0.0))
    out = pairs.withColumn("turned", (crossed > straight) & (F.least("l_la", "l_lb", "r_la", "r_lb") > 0))
    for x, y in (("a", "b"), ("b", "a")):
        out = out.withColumn(f"o_{x}", F.when(F.col("turned"), F.col(f"r_{y}")).otherwise(F.col(f"r_{x}"))).withColumn(f"o_l{x}", F.when(F.col("turned"), F.col(f"r_l{y}")).otherwise(F.col(f"r_l{x}")))
    out = out.withColumn("dice_a", _dice("l_a", "o_a")).withColumn("dice_b", _dice("l_b", "o_b"))
    out = out.withColumn("sub_b", F.when(F.col("dice_b").isNotNull(), inside("l_b", "o_b"))).withColumn("sub_a", F.when(F.col("dice_a").isNotNull(), inside("l_a", "o_a")))
    short_b = (F.col("l_lb") < F.col("o_lb")) & (F.col("sub_b") >= 0.6)
    short_a = (F.col("l_la") < F.col("o_la")) & (F.col("sub_a") >= 0.8)
    digits = lambda c: F.array_sort(F.split(F.col(c).cast("string"), ""))
    near = lambda x, y, far: (F.abs(F.col(x) - F.col(y)) <= far) | (digits(x) == digits(y))
    gap = F.least(F.abs(F.col("l_day") - F.col("r_day")), F.abs(F.col("l_swapped") - F.col("r_day")) + 1)
    same = lambda c: F.when(F.col(f"l_{c}").isNull() | F.col(f"r_{c}").isNull(), 0).when(F.col(f"l_{c}") == F.col(f"r_{c}"), 1).otherwise(-1)
    others = same("area") + same("direction") + same("majority") + same("minority")
    return out.select(
        "*",
        F.when((level(F.col("dice_a")) < 1) & short_a, 1).otherwise(level(F.col("dice_a"))).alias("na"),
        F.when((level(F.col("dice_b")) < 1) & short_b, 1).otherwise(level(F.col("dice_b"))).alias("nb"),
        F.when(F.col("l_v").isNull() | F.col("r_v").isNull(), -1)
        .when((F.col("l_v") == F.col("r_v")) & (F.col("l_g") == F.col("r_g")), 3)
        .when((F.col("l_v") == F.col("r_v")) & F.col("l_g").isNull(), 1)
        # A slip in one of both numbers: the page is equal, or the volume is and the page is near or has its digits exchanged.
        .when((F.col("l_g") == F.col("r_g")) | ((F.col("l_v") == F.col("r_v")) & near("l_g", "r_g", NEAR_PAGES)), 2).otherwise(0).alias("ci"),
        F.when(gap.isNull(), -1).when(gap == 0, 3).when(gap <= NEAR_DAYS, 2).when((gap <= 400) | (F.col("l_t") == F.col("r_t")), 1).otherwise(0).alias("da"),
        F.when(F.col("l_sid").isNull(), -1).when(F.col("l_sid") == F.col("r_id"), 1).otherwise(0).alias("si"),
        F.when(others >= 2, 2).when(others >= 0, 1).otherwise(0).alias("ot"),
        ((F.coalesce("dice_a", F.lit(0.0)) + F.coalesce("dice_b", F.lit(0.0))) / 2).alias("dice"),
    )


def fit(counts: dict[tuple, int], n_left: int, chance: dict[tuple, int] | None = None, rounds: int = 60) -> dict[tuple, float]:
    """Posterior of a match for each pattern of LEVELS, by expectation-maximization from their counts.

    A field's weight at a level is the log ratio of the level's probability among matches and among other pairs. The
    number of matches is at most n_left. ``chance`` counts the patterns of pairs drawn at random, which are no matches:
    where nearly every candidate is one, they alone tell what other pairs look like. Patterns are at most the product of the levels, whatever the data's size.
    """
    fields = list(LEVELS)
    pats = list({**counts, **(chance or {})})
    n = np.array([counts.get(p, 0) for p in pats], float)
    drawn = np.array([(chance or {}).get(p, 0) for p in pats], float)
    idx = np.array([[lv + 1 for lv in p] for p in pats])
    m = [np.full(LEVELS[f] + 1, 0.0) for f in fields]
    u = [np.full(LEVELS[f] + 1, 0.0) for f in fields]
    # The start: matches mostly agree, other pairs mostly don't, beyond how often levels occur among all pairs.
    for j, f in enumerate(fields):
        every = np.bincount(idx[:, j], weights=n + drawn, minlength=LEVELS[f] + 1) + 1
        u[j] = every / every.sum()
        tilt = np.exp(1.5 * np.arange(-1, LEVELS[f])) / math.exp(1.5 * (LEVELS[f] - 1))
        tilt[0] = tilt[1:].mean()
        m[j] = u[j] * tilt / (u[j] * tilt).sum()
    share = min(0.9, 0.7 * n_left / max(1.0, n.sum()))
    post = np.zeros(len(pats))
    for _ in range(rounds):
        weight = sum(np.log(m[j][idx[:, j]]) - np.log(u[j][idx[:, j]]) for j in range(len(fields))) + math.log(share / (1 - share))
        post = 1 / (1 + np.exp(-np.clip(weight, -50, 50)))
        total = (post * n).sum()
        for j, f in enumerate(fields):
            a = np.bincount(idx[:, j], weights=n * post, minlength=LEVELS[f] + 1) + 0.5
            b = np.bincount(idx[:, j], weights=n * (1 - post) + drawn, minlength=LEVELS[f] + 1) + 0.5
            m[j], u[j] = a / a.sum(), b / b.sum()
        share = min(max(total / n.sum(), 1e-9), 0.95, 1.2 * n_left / n.sum())
    return {p: float(x) for p, x in zip(pats, post)}


def match(clusters: DataFrame, cases: DataFrame, least: float = 0.5) -> DataFrame:
    """(cluster_id, caseid, confidence, dice): the authority case of each cluster whose confidence is at least ``least``.

    Every delivery of a cluster is compared, and its best pair counts. A cluster gets the case with the highest
    confidence; where several have it, their probabilities share one, so two cases that fit alike fall below 1/2. A
    case may get several clusters. Nulls in an attribute neither speak for nor against a match; clusters or cases
    without id are left out, and so are pairs that agree in too little (see candidates). Empty tables give an empty
    result.
    """
    left = encode(clusters, "cluster_id", "case_name", "citation", "date_filed", "scdb_id", *_cluster_columns(clusters))
    right = encode(cases, "caseid", "casename", "uscite", "datedecision", None, F.col("issuearea"), F.col("decisiondirection"), F.col("majvotes"), F.col("minvotes"))
    left, right = cut(left, "p2-left"), cut(right, "p2-right")
    # A cluster's own id of a case makes a pair whatever else agrees.
    known = _wide(left.where("sid IS NOT NULL"), "l").join(merged(_wide(right, "r")), F.col("l_sid") == F.col("r_id")).withColumn("agreeing", F.lit(True))
    pairs = met(left, right).where(~F.coalesce(F.col("l_sid") == F.col("r_id"), F.lit(False))).unionByName(known)
    wide = lambda df, p: merged(_wide(df, p))
    scored = cut(patterns(pairs).select(F.col("l_id").cast("long").alias("cluster_id"), F.col("r_id").alias("caseid"), *LEVELS, "dice", "agreeing"), "p2-scored")
    # Pairs whose vectors don't agree as they stand are scored by the levels' weights among those that do.
    rows = scored.groupBy(*LEVELS).agg(F.count_if("agreeing").alias("n")).collect()
    if not rows:
        return scored.select("cluster_id", "caseid", F.lit(0.0).alias("confidence"), "dice")
    # About one pair for each left record, drawn by the records' hashes.
    n_right = right.count()
    at = lambda seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(n_right))
    drawn = left.select(F.col("rep").alias("l"), at(1).alias("b")).join(merged(right.select(F.col("rep").alias("r"), at(2).alias("b"))), "b").select("l", "r")
    chance = patterns(drawn.join(wide(left, "l"), "l").join(wide(right, "r"), "r")).groupBy(*LEVELS).agg(F.count("*").alias("n")).collect()
    counted = lambda rs: {tuple(r[f] for f in LEVELS): r["n"] for r in rs}
    post = fit(counted(rows), left.select("id").distinct().count(), counted(chance))
    spark = clusters.sparkSession
    table = spark.createDataFrame([(*p, x) for p, x in post.items()], ", ".join(f"{f} int" for f in LEVELS) + ", p double")
    # The table has one row a pattern: at most the product of the levels.
    best = scored.join(F.broadcast(table), list(LEVELS)).groupBy("cluster_id", "caseid").agg(F.max(F.struct("p", "dice")).alias("s")).select("cluster_id", "caseid", "s.*")
    w = Window.partitionBy("cluster_id")
    # Odds of each case against the others and against none of them.
    odds = F.least(F.col("p"), F.lit(1 - 1e-9)) / (1 - F.least(F.col("p"), F.lit(1 - 1e-9)))
    ranked = best.withColumn("odds", odds).withColumn("confidence", F.col("odds") / (1 + F.sum("odds").over(w)))
    ranked = ranked.withColumn("n", F.row_number().over(w.orderBy(F.desc("confidence"), F.desc("dice"), "caseid")))
    return ranked.where((F.col("n") == 1) & (F.col("confidence") >= least)).select("cluster_id", "caseid", F.round("confidence", 6).alias("confidence"), F.round("dice", 6).alias("dice"))


#: Issue area of each category, as in the table of subjects.
AREAS = ("criminal_procedure", "civil_rights", "first_amendment", "due_process", "privacy", "attorneys", "unions", "economic_activity", "judicial_power", "federalism", "interstate_relations", "federal_taxation", "miscellaneous", "private_action")


def _cluster_columns(clusters: DataFrame) -> list[F.Column]:
    area = F.element_at(F.create_map(*[x for i, a in enumerate(AREAS) for x in (F.lit(a), F.lit(str(i + 1)))]), F.col("scdb_category"))
    return [area, F.col("scdb_decision_direction"), F.col("scdb_votes_majority"), F.col("scdb_votes_minority")]


def found(clusters: DataFrame, cases: DataFrame) -> DataFrame:
    """p2_found: (cluster_id, caseid)."""
    return match(clusters, cases).select("cluster_id", "caseid")
