"""The kernels as Arrow UDFs, and their registration for SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketforge.functions import kernels as K


def _struct(kind: T.DataType, *names: str) -> T.StructType:
    return T.StructType([T.StructField(n, kind) for n in names])


# Types as objects: a module of UDFs can be imported before there is a session.
PLACE = _struct(T.IntegerType(), "start", "end")
SECTIONS = T.ArrayType(T.StructType([*PLACE.fields, *_struct(T.StringType(), "kind", "author").fields]))
PIECES = T.StructType([T.StructField("pieces", T.ArrayType(PLACE)), T.StructField("lost", T.IntegerType())])


@F.pandas_udf(PLACE)
def located(span: pd.Series, text: pd.Series) -> pd.DataFrame:
    """Offsets of a quotation in its source; nulls where it isn't found or either is null."""
    found = [K.locate(s, t) if s and t else None for s, t in zip(span, text)]
    return pd.DataFrame({"start": pd.array([f[0] if f else None for f in found], dtype="Int32"), "end": pd.array([f[1] if f else None for f in found], dtype="Int32")})


def stepped(tolerant: bool):
    """A UDF from a source's three forms and the lists of its quotations' forms to the list of kernels.found_step()."""

    def run(source: pd.Series, normalised: pd.Series, words: pd.Series, spans: pd.Series, norms: pd.Series, rows: pd.Series, parts: pd.Series) -> pd.Series:
        texts = zip(source, normalised, words)
        return pd.Series([[K.found_step((t or "", n, w), *x, tolerant) for x in zip(*lists)] for (t, n, w), lists in zip(texts, zip(spans, norms, rows, parts))])

    return F.pandas_udf(run, T.ArrayType(T.IntegerType()))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("slice", T.StringType()), T.StructField("holds", T.BooleanType())])))
def recorded(source: pd.Series, spans: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    """For each quotation of a source what its offsets cut, null if they don't lie in it, and whether they are those of the first place it stands at. A missing offset is -1."""

    def one(text: str, span: str | None, a: int, b: int) -> dict:
        return {"slice": text[a:b] if 0 <= a < b <= len(text) else None, "holds": bool(span) and 0 <= a and b - a == len(span) and text.find(span, 0, b) == a}

    return pd.Series([[one(t, *x) for x in zip(*lists)] for t, lists in zip(source, zip(spans, starts, ends))])


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else K.nfkc(x))


@F.pandas_udf(SECTIONS)
def segmented(text: pd.Series) -> pd.Series:
    return text.map(lambda x: [{"start": a, "end": b, "kind": k, "author": w} for a, b, k, w in K.sections(x or "")])


@F.pandas_udf(T.IntegerType())
def separate_boundary(text: pd.Series) -> pd.Series:
    """Where the first separate writing begins in a text that is the Court's opinion from its start; null if nowhere."""
    return pd.Series(pd.array([K.first_separate(x or "", in_court=True) for x in text], dtype="Int32"))


@F.pandas_udf(T.IntegerType())
def snapped(text: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([K.snapped(x or "", int(t)) for x, t in zip(text, target)], dtype="int32")


def windowed(size: int, stride: int, least_last: int, snap: bool, text: bool):
    """A UDF from a text to its windows, with each window's text if ``text``."""
    names = ["chunk_index", "n_chunks", "start_word", "end_word", "char_start", "char_end"]
    fields = [T.StructField(n, T.IntegerType()) for n in names] + ([T.StructField("text", T.StringType())] if text else [])

    def one(x: str | None) -> list[dict]:
        x = (x or "").strip()
        made = [dict(zip(names, w)) for w in K.windows(x, size, stride, least_last, snap)]
        return [w | {"text": x[w["char_start"] : w["char_end"]]} for w in made] if text else made

    def run(column: pd.Series) -> pd.Series:
        return column.map(one, na_action=None)

    run.__annotations__ = {"column": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.ArrayType(T.StructType(fields)))


@F.pandas_udf(PIECES)
def pieced(span: pd.Series, text: pd.Series) -> pd.DataFrame:
    rows = [K.pieces(s or "", t or "") for s, t in zip(span, text)]
    return pd.DataFrame({"pieces": [[{"start": a, "end": b} for a, b in r[0]] for r in rows], "lost": [r[1] for r in rows]})


@F.pandas_udf(T.DoubleType())
def overlap_share(span: pd.Series, window: pd.Series) -> pd.Series:
    """The share of the span's words in blocks that the window has in the same order; null where either is null."""
    return pd.Series([None if s is None or w is None else K.overlap_share(list(s), list(w)) for s, w in zip(span, window)], dtype="float64")


@F.pandas_udf(T.IntegerType())
def divergence(span: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([K.divergence(s or "", t or "") for s, t in zip(span, text)], dtype="int32")


@F.pandas_udf(T.IntegerType())
def longest_run(a: pd.Series, b: pd.Series) -> pd.Series:
    """The longest run of words that two texts share, in words of functions.text.words()."""
    return pd.Series([K.longest_run(K.words(x or ""), K.words(y or "")) for x, y in zip(a, b)], dtype="int32")


SUMMARY = T.StructType([
    T.StructField("n_sections", T.IntegerType()), T.StructField("kinds", T.MapType(T.StringType(), T.IntegerType())), T.StructField("binding_words", T.IntegerType()),
    T.StructField("total_words", T.IntegerType()), T.StructField("confident", T.BooleanType()), T.StructField("binding_text", T.StringType()),
])


@F.pandas_udf(SUMMARY)
def section_summary(text: pd.Series) -> pd.DataFrame:
    rows = [K.summary(x or "") | {"binding_text": K.binding_text(x or "")} for x in text]
    return pd.DataFrame(rows, columns=SUMMARY.names)


@F.pandas_udf(_struct(T.DoubleType(), "rouge1_p", "rouge1_r", "rouge1_f", "rougeL_f", "meteor"))
def overlap_scores(reference: pd.Series, prediction: pd.Series) -> pd.DataFrame:
    rows = []
    for r, p in zip(reference, prediction):
        a, b = K.rouge_tokens(r or ""), K.rouge_tokens(p or "")
        rows.append((*K.rouge_1(a, b), K.rouge_l(a, b), K.meteor_exact((r or "").split(), (p or "").split())))
    return pd.DataFrame(rows, columns=["rouge1_p", "rouge1_r", "rouge1_f", "rougeL_f", "meteor"])


@F.pandas_udf(_struct(T.DoubleType(), "low", "high"))
def exact_interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([K.binomial_interval(int(a), int(b)) for a, b in zip(k, n)], columns=["low", "high"])


def register(spark: SparkSession) -> None:
    """Makes the functions callable from SQL."""
    for name, f in (("locate_span", located), ("nfkc", nfkc), ("segment", segmented), ("separate_boundary", separate_boundary), ("snap_break", snapped), ("quote_pieces", pieced), ("overlap_share", overlap_share), ("longest_run", longest_run), ("section_summary", section_summary), ("overlap_scores", overlap_scores), ("exact_interval", exact_interval)):
        spark.udf.register(name, f)
