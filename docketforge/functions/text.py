"""Text functions as Catalyst expressions; none of them leaves the JVM."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Every character that counts as white space, in a notation that several regex engines share.
SPACE_SET = r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE, SOLID = f"[{SPACE_SET}]", f"[^{SPACE_SET}]"
TOKEN = "[a-z0-9§]+"
UPPER_HALF = 0.500000000001

# Typographic variants and what they are compared as.
VARIANTS, PLAIN = "“”‘’–—− ", "\"\"''--- "
# Words of a party name that sources write or leave out.
NOISE_WORDS = (
    "v vs et al inc llc co corp corporation ltd lp llp the of and a an dba petitioner respondent attorney general secretary commissioner director administrator "
    "warden superintendent sheriff governor president board department county city state states united us dept comm bureau agency office officer acting interim"
).split()
# What may follow a party's name.
NAME_TAIL = r"(?i),?[ ]*(?:et al\.?|doing business as|dba|d/b/a|individually|on behalf of|as trustee|trustee)\b.*$"


def blank(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def words(x: Column) -> Column:
    """Small-letter tokens without editorial brackets; none for null."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(blank(x), r"[\[\]]", "")), F.lit(TOKEN), F.lit(0))


def word_count(x: Column) -> Column:
    """Runs of characters that aren't white space; 0 for null."""
    return F.size(F.regexp_extract_all(blank(x), F.lit(SOLID + "+"), F.lit(0)))


def squeeze(x: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(x, SPACE + "+", " "))


def normalised(x: Column) -> Column:
    """Typographic variants, spacing and the gaps in initials made equal."""
    return F.regexp_replace(squeeze(F.translate(blank(x), VARIANTS, PLAIN)), r"\b([A-Z])\. +(?=[A-Z]\.)", "$1.")


def stream(x: Column) -> Column:
    """Small letters, digits and section signs without anything between them."""
    return F.regexp_replace(F.lower(blank(x)), r"[^\p{L}\p{N}§]", "")


def elided_parts(x: Column) -> Column:
    """The parts of a quotation around its ellipses; none if there are fewer than two."""
    parts = F.filter(F.transform(F.split(blank(x), r"\.[ ]*\.[ ]*\.|…"), squeeze), lambda p: p != "")
    return F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))


def without_tags(x: Column) -> Column:
    return squeeze(F.regexp_replace(blank(x), "<[^>]+>", " "))


def clean_text(x: Column) -> Column:
    """Text without control characters, footnote marks and lines that hold a page number only, spacing squeezed.

    Compatibility forms are left to functions.udfs.nfkc, which goes before where a source has them.
    """
    t = F.regexp_replace(blank(x), r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}]", "")
    t = F.regexp_replace(t, r"\[ *[Ff]ootnote +[0-9]+ *\]", " ")
    t = F.regexp_replace(t, r"\n[ \t\n\r]*\*?[0-9]{1,4}[ \t\n\r]*\n", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, f"^{SPACE}+|{SPACE}+$", "")


def sanitised(x: Column) -> Column:
    """Without characters that JSON can't carry."""
    return F.regexp_replace(x, r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{FFFE}\x{FFFF}]", " ")


def citation_key(x: Column) -> Column:
    """'volume-page' of an official citation, null if there is none."""
    pattern = r"([0-9]+) +U\.? ?S\.? +([0-9]+)"
    volume, page = F.regexp_extract(blank(x), pattern, 1), F.regexp_extract(blank(x), pattern, 2)
    return F.when(volume != "", F.concat_ws("-", volume, page))


def plain_name(x: Column) -> Column:
    t = F.regexp_replace(F.lower(blank(x)), "[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\b(?:" + "|".join(NOISE_WORDS) + r")\b", " "), " +", " "))


def name_key(x: Column) -> Column:
    """The first two telling words of both sides of a case name, sorted; '' if there are none."""
    sides = F.split(F.regexp_replace(blank(x), r"(?i)\bvs?\b\.?", "\u0001"), "\u0001")
    lead = lambda side: F.slice(F.filter(F.split(plain_name(F.regexp_replace(side, NAME_TAIL, "")), " "), lambda w: F.length(w) > 2), 1, 2)
    second = F.when(F.size(sides) > 1, lead(F.element_at(sides, 2))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.array_sort(F.concat(lead(F.element_at(sides, 1)), second)), " ")


def starts_yes_no(x: Column) -> Column:
    """Whether an answer's first word is yes, no, true or false."""
    first = F.regexp_extract(blank(x), f"{SOLID}+", 0)
    return F.regexp_replace(F.lower(first), "[^a-z]", "").isin("yes", "no", "true", "false")


def overlap_ratio(a: Column, b: Column) -> Column:
    """The share of a's alphabetic tokens that b has too; 0 if a has none."""
    ta = F.regexp_extract_all(F.lower(blank(a)), F.lit("[a-z]+"), F.lit(0))
    tb = F.regexp_extract_all(F.lower(blank(b)), F.lit("[a-z]+"), F.lit(0))
    # Bound to one struct, the token lists are made once and not for each token.
    once = F.array(F.struct(ta.alias("t"), F.array_intersect(ta, tb).alias("c")))
    share = F.transform(once, lambda x: F.try_divide(F.size(F.filter(x["t"], lambda w: F.array_contains(x["c"], w))), F.size(x["t"])))
    return F.coalesce(F.get(share, 0), F.lit(0.0))


def upper_median(column: str) -> Column:
    """The middle value, of two middle values the greater; an aggregate over counts of the different values, not over rows."""
    # Just above one half, so that of an even number of values the upper one of the middle is reached.
    return F.expr(f"percentile_disc({UPPER_HALF}D) WITHIN GROUP (ORDER BY `{column}`)")


def at_share(column: str, share: float) -> Column:
    """The value at place floor(n * share) of the n values in order, from 0; over counts as well."""
    return F.expr(f"percentile_disc({share + 1e-12}D) WITHIN GROUP (ORDER BY `{column}`)")


def share_of_all(counts: DataFrame, n: str = "n", digits: int = 4, name: str = "pct") -> DataFrame:
    """counts with each row's share of all in percent. counts is an aggregate of few rows, which the window holds in one task."""
    return counts.withColumn(name, F.round(100 * F.col(n) / F.sum(n).over(Window.partitionBy()), digits))


def _filled(x: Column, pattern: str, before: str, lengths: tuple[int, ...], behind: str, lead: int = 0) -> Column:
    for n in lengths:
        x = F.regexp_replace(x, pattern.format(n=n), before + " " * (n + lead) + behind)
    return x


def blanked(x: Column) -> Column:
    """x with footnote marks behind punctuation, star pages and bracketed page numbers as blanks of equal length, so offsets stay."""
    t = _filled(blank(x), r"""([.,;:”"'])[0-9]{{{n}}}(?=\s|$)""", "$1", (1, 2, 3), "")
    t = _filled(_filled(t, r"\*\s[0-9]{{{n}}}", "", (4, 3, 2, 1), "", 2), r"\*[0-9]{{{n}}}", "", (4, 3, 2, 1), "", 1)
    for a, b in ((1, 1), (1, 0), (0, 1), (0, 0)):
        t = _filled(t, r"\[" + r"\s" * a + "[0-9]{{{n}}}" + r"\s" * b + r"\]", "", (4, 3, 2, 1), "", 2 + a + b)
    return t


#: Footnote marks behind punctuation, star pages and bracketed page numbers, for texts whose offsets needn't stay.
MARKS = ((r"""([.,;:”"'])[0-9]{1,3}(?=\s|$)""", "$1 "), (r"\*\s?[0-9]{1,4}", " "), (r"\[\s?[0-9]{1,4}\s?\]", " "))


def ascii_stream(x: Column) -> Column:
    """Small letters a-z, digits and section signs without anything between them, footnote and page marks left out."""
    t = blank(x)
    for pattern, by in MARKS:
        t = F.regexp_replace(t, pattern, by)
    return F.regexp_replace(F.lower(t), "[^a-z0-9§]", "")


def case_matches(words: list[str], *names: Column) -> Column:
    """Whether every one of the words stands as a word of its own in the names taken together."""
    hay = F.concat_ws(" ", *[F.lower(blank(n)) for n in names])
    hits = [hay.rlike(r"\b" + re.escape(w.lower()) + r"\b") for w in words]
    return functools.reduce(lambda a, b: a & b, hits, F.lit(True))


def first_telling(fields: dict[str, Column], least: int = 50) -> Column:
    """The first of the fields that has ``least`` words once its tags are blanks, with runs of blanks and of empty lines squeezed; '' if none has. A field named 'plain_text' keeps what looks like tags."""
    def tidy(name: str, x: Column) -> Column:
        t = blank(x) if name == "plain_text" else F.regexp_replace(blank(x), "<[^>]+>", " ")
        return F.regexp_replace(F.regexp_replace(t, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")

    ready = [tidy(name, x) for name, x in fields.items()]
    telling = F.coalesce(*[F.when(word_count(t) >= least, F.regexp_replace(t, f"^{SPACE}+|{SPACE}+$", "")) for t in ready])
    return F.coalesce(telling, F.lit(""))
