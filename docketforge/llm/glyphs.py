"""Visually identical text with different characters (problem 3).

An Arrow string column is decoded once into one array of code points for the whole batch. Tables built by rule
from the Unicode data give each code point its class, its replacement and its expanded length; deletion, folding,
expansion and composition are gathers, repeats and sorted searches over that array, never a call for each row.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("compat_form", "combining", "zero_width", "odd_space", "lookalike")
#: Code points from TOP on are left as they are: no table entry lies there.
TOP = 0x20000
PLAIN, COMPAT, MARK, ZERO, SPACE = 0, 1, 2, 3, 4
NONE, LATIN, FOREIGN = 0, 1, 2

# Letters of other scripts that look like Latin ones, as pairs of letter and Latin letter.
LOOKALIKES = (
    "аa еe оo рp сc уy хx іi ѕs јj һh ԁd ԛq ԝw ѵv ӏl гr кk АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЅS ЈJ ԚQ ԜW "
    "αa οo ρp υu νv ιi κk γy χx τt ηn ωw ςs εe ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX օo ոn սu ցg"
)
# Characters without width, besides those of category Cf in the ranges used below.
ZERO_WIDTH = (0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0xFEFF)


@lru_cache(maxsize=1)
def tables() -> dict[str, np.ndarray]:
    """The lookup tables, by code point below TOP: class, script, twin, and the expansion as start, length and pool."""
    kind, script = np.zeros(TOP, np.uint8), np.zeros(TOP, np.uint8)
    twin = np.arange(TOP, dtype=np.uint32)
    length, start, pool = np.ones(TOP, np.int64), np.zeros(TOP, np.int64), []
    ccc = np.zeros(TOP, np.uint8)
    for c in range(0x80, TOP):
        ch = chr(c)
        cat = unicodedata.category(ch)
        ccc[c] = unicodedata.combining(ch)
        wide = 0xFF01 <= c <= 0xFFEE or 0xFB00 <= c <= 0xFB06
        if cat == "Zs":
            kind[c] = SPACE
        elif c in ZERO_WIDTH or 0x200B <= c <= 0x200F or 0x202A <= c <= 0x202E or 0x2060 <= c <= 0x206F or 0xFE00 <= c <= 0xFE0F:
            kind[c] = ZERO
        elif cat == "Mn" and (0x300 <= c <= 0x36F or 0x1AB0 <= c <= 0x1AFF or 0x1DC0 <= c <= 0x1DFF or 0x20D0 <= c <= 0x20FF or 0xFE20 <= c <= 0xFE2F):
            kind[c] = MARK
        elif wide and (form := unicodedata.normalize("NFKC", ch)) != ch:
            kind[c] = COMPAT
            length[c], start[c] = len(form), len(pool)
            pool.extend(map(ord, form))
        if cat[0] == "L" and c not in (0xAA, 0xBA, 0xB5):
            name = unicodedata.name(ch, "")
            script[c] = LATIN if name.startswith(("LATIN", "FULLWIDTH LATIN")) else FOREIGN if name.startswith(("CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "COPTIC")) else NONE
    for c in [*range(65, 91), *range(97, 123)]:
        script[c] = LATIN
    for pair in LOOKALIKES.split():
        twin[ord(pair[0])] = ord(pair[1])
    pairs = {}
    for c in range(0xC0, 0x1F00):
        d = unicodedata.decomposition(chr(c))
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", chr(c)) == chr(c):
            a, b = (int(x, 16) for x in d.split())
            pairs[(a << 21) | b] = c
    keys = np.array(sorted(pairs), np.int64)
    return {
        "kind": kind, "script": script, "twin": twin, "length": length, "start": start, "pool": np.array(pool, np.uint32),
        "ccc": ccc, "keys": keys, "whole": np.array([pairs[int(k)] for k in keys], np.uint32),
    }


def decode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all rows, start of each row and the end); a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    heads = (raw & 0xC0) != 0x80
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(heads, out=before[1:])
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, before[offsets - offsets[0]]


def encode(points: np.ndarray, starts: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The Arrow strings of rows of code points; rows not valid become null."""
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    ends = np.zeros(len(points) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    out = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(ends[starts].tobytes()), pa.py_buffer(data))
    if valid is not None and not valid.all():
        out = pc.if_else(pa.array(valid), out, pa.scalar(None, pa.large_string()))
    return out


def _marks(points: np.ndarray, rows: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Marks behind their letter in canonical order, then composed with it as far as one character exists."""
    while True:
        low = np.minimum(points, TOP - 1)
        ccc = t["ccc"][low]
        swap = np.flatnonzero((ccc[1:] > 0) & (ccc[:-1] > ccc[1:]) & (rows[1:] == rows[:-1]))
        if not len(swap):
            break
        swap = swap[np.concatenate(([True], np.diff(swap) > 1))]
        points[swap], points[swap + 1] = points[swap + 1].copy(), points[swap].copy()
    while True:
        ccc = t["ccc"][np.minimum(points, TOP - 1)]
        at = np.flatnonzero((ccc[1:] > 0) & (ccc[:-1] == 0) & (rows[1:] == rows[:-1])) + 1
        if not len(at):
            return points, rows
        # The next mark of another class than those kept before it may still compose with the letter.
        key = (points[at - 1].astype(np.int64) << 21) | points[at].astype(np.int64)
        i = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
        hit = t["keys"][i] == key
        if not hit.any():
            return points, rows
        points[at[hit] - 1] = t["whole"][i[hit]]
        keep = np.ones(len(points), bool)
        keep[at[hit]] = False
        points, rows = points[keep], rows[keep]


def normalise_arrow(column: pa.Array, text: bool = True) -> tuple[pa.Array | None, np.ndarray]:
    """(the consistent form of each row or None, a bool matrix of rows by KINDS).

    Full-width forms and ligatures become their ordinary letters, odd spaces one ordinary space each, characters
    without width vanish, look-alike letters in words with Latin letters become Latin, separate accents compose.
    Line breaks, precomposed letters, quotes, dashes and whole words of another script stay.
    """
    t = tables()
    points, starts = decode(column)
    n = len(starts) - 1
    flags = np.zeros((n, len(KINDS)), bool)
    rare = np.flatnonzero(points >= 0x80)
    if len(rare):
        special = points[rare]
        special = np.where(special < TOP, special, 0)
        kind = t["kind"][special]
        row_of = np.searchsorted(starts, rare, side="right") - 1
        for k, name in ((COMPAT, 0), (ZERO, 2), (SPACE, 3)):
            flags[row_of[kind == k], name] = True
        marks = rare[kind == MARK]
        base = marks[marks > 0] - 1
        script_of = lambda at: t["script"][np.minimum(points[at], TOP - 1)]
        lettered = base[(script_of(base) > 0) | (t["kind"][np.minimum(points[base], TOP - 1)] == MARK)] + 1
        flags[np.searchsorted(starts, lettered, side="right") - 1, 1] = True
        # Words: runs of letters, marks and characters without width. Only those with a foreign letter matter.
        foreign = rare[t["script"][special] == FOREIGN]
        if len(foreign):
            low = np.minimum(points, TOP - 1)
            script = t["script"][low]
            inside = (script > 0) | (t["kind"][low] == MARK) | (t["kind"][low] == ZERO)
            row_start = np.zeros(len(points) + 1, bool)
            row_start[starts[:-1]] = True
            begins = inside & np.concatenate(([True], ~inside[:-1])) | (inside & row_start[:-1])
            run = np.cumsum(begins)
            latin = np.bincount(run[(script == LATIN) & inside], minlength=run[-1] + 1)
            mixed = foreign[latin[run[foreign]] > 0]
            twin = t["twin"][np.minimum(points[mixed], TOP - 1)]
            mixed, twin = mixed[twin != points[mixed]], twin[twin != points[mixed]]
            flags[np.searchsorted(starts, mixed, side="right") - 1, 4] = True
            if text:
                points = points.copy()
                points[mixed] = twin
    if not text:
        return None, flags
    valid = np.asarray(column.is_valid()) if column.null_count else None
    if not flags.any():
        return encode(points, starts, valid), flags
    rows = np.repeat(np.arange(n), np.diff(starts))
    low = np.where(points < TOP, points, 0)
    kind, length = t["kind"][low], t["length"][low].copy()
    length[kind == ZERO] = 0
    out = np.repeat(np.where(kind == SPACE, 32, points).astype(np.uint32), length)
    rows_out = np.repeat(rows, length)
    wide = np.flatnonzero(kind == COMPAT)
    if len(wide):
        at = (np.cumsum(length) - length)[wide]
        size = length[wide]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(at, size) + step] = t["pool"][np.repeat(t["start"][low[wide]], size) + step]
    if flags[:, 1].any():
        out, rows_out = _marks(out, rows_out, t)
    ends = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(rows_out, minlength=n), out=ends[1:])
    return encode(out, ends, valid), flags


def consistent_text(df: DataFrame, column: str, keys: list[str], text: bool = True) -> DataFrame:
    """keys, ``kinds`` (array of KINDS that occur) and, if ``text``, ``text`` in its consistent form, for every row of df.

    A null text stays null with no kinds; an empty one stays empty. Repeated rows come out repeated. Columns of df
    other than keys and ``column`` are left out, so clashing names don't matter.
    """
    chosen = df.select(*[F.col(k) for k in keys], F.col(column).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    schema = f"{fields}, kinds array<string>" + (", text string" if text else "")
    names = pa.array(KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A batch of very long texts is cut by bytes: an array of code points takes four times as much and some copies.
            step = max(1, int(batch.num_rows * 8_000_000 // max(1, batch.nbytes)))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                given = part.column(part.num_columns - 1)
                form, flags = normalise_arrow(given, text=False)
                if text:  # only rows with a kind are rebuilt
                    touched = pa.array(flags.any(axis=1))
                    form = pc.replace_with_mask(given.cast(pa.large_string()), touched, normalise_arrow(given.filter(touched))[0])
                which = np.flatnonzero(flags.ravel()) % len(KINDS)
                ends = np.concatenate(([0], np.cumsum(flags.sum(axis=1)))).astype(np.int32)
                kinds = pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(which)))
                arrays = [part.column(i) for i in range(part.num_columns - 1)] + [kinds] + ([form.cast(pa.string())] if text else [])
                yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "kinds", *(["text"] if text else [])])

    return chosen.mapInArrow(run, schema)


def spans_in_opinions(pairs: DataFrame, opinions: DataFrame) -> DataFrame:
    """(pair_id, as_is, consistent): whether a pair's span stands in its opinion as both are written, and in their consistent forms with white space squeezed.

    Null where the span or the opinion is missing. Both sides are brought to their form once before they meet; AQE splits
    an opinion that many pairs quote.
    """
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    a = consistent_text(pairs, "supporting_span", ["pair_id", "cluster_id"]).select("pair_id", "cluster_id", squeezed(F.col("text")).alias("span"))
    b = consistent_text(opinions, "text", ["cluster_id"]).select("cluster_id", squeezed(F.col("text")).alias("opinion"))
    forms = a.join(b, "cluster_id", "left").select("pair_id", F.contains("opinion", "span").alias("consistent")).groupBy("pair_id").agg(F.max("consistent").alias("consistent"))
    raw = pairs.select("pair_id", "cluster_id", "supporting_span").join(opinions.select("cluster_id", "text"), "cluster_id", "left")
    raw = raw.groupBy("pair_id").agg(F.max(F.contains("text", "supporting_span")).alias("as_is"))
    return raw.join(forms, "pair_id").select("pair_id", "as_is", "consistent")


def found(pairs: DataFrame, opinions: DataFrame) -> DataFrame:
    """p3_found: (tbl, record_id, kind), one row for each kind that occurs in a record's text."""
    a = consistent_text(pairs, "supporting_span", ["pair_id"], text=False).select(F.lit("pair_records").alias("tbl"), F.col("pair_id").alias("record_id"), F.explode("kinds").alias("kind"))
    b = consistent_text(opinions, "text", ["cluster_id"], text=False).select(F.lit("cleaned_opinions").alias("tbl"), F.col("cluster_id").alias("record_id"), F.explode("kinds").alias("kind"))
    return a.unionByName(b).distinct()
