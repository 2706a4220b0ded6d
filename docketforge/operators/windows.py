"""Overlapping word windows over long documents, with exact offsets and position bands."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketforge.functions import text as T
from docketforge.functions.udfs import windowed
from docketforge.session import spread


@dataclass(frozen=True)
class WindowConfig:
    """Words of a window and of its overlap with the next, and the least words of the last."""

    words: int = 900
    overlap: int = 150
    least_last: int = 200
    early: float = 0.15
    late: float = 0.20

    @property
    def stride(self) -> int:
        return max(1, self.words - self.overlap)


def stripped(x: Column) -> Column:
    return F.regexp_replace(T.blank(x), f"^{T.SPACE}+|{T.SPACE}+$", "")


def tokens(x: Column) -> Column:
    """The words of a stripped text, each with the white space behind it."""
    return F.regexp_extract_all(x, F.lit(f"{T.SOLID}+{T.SPACE}*"), F.lit(0))


def word_offsets(opinions: DataFrame) -> DataFrame:
    """(row, cluster_id, i, start) of every word: a running sum of token lengths in each document."""
    docs = documents(opinions).withColumn("row", F.monotonically_increasing_id()).select("row", "cluster_id", F.posexplode(tokens(F.col("text"))).alias("i", "t"))
    w = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return docs.select("row", "cluster_id", "i", F.coalesce(F.sum(F.length("t")).over(w), F.lit(0)).alias("start"))


def documents(opinions: DataFrame) -> DataFrame:
    """(cluster_id, text, total): stripped texts and their words; blank texts are left out."""
    return opinions.select("cluster_id", stripped(F.col("text")).alias("text")).where("text <> ''").withColumn("total", T.word_count(F.col("text")))


def sizes(opinions: DataFrame) -> DataFrame:
    """(cluster_id, total): the words of every text that has any; a filter on the count would count twice."""
    return spread(opinions.select("cluster_id", "text")).where(F.col("text").rlike(T.SOLID)).select("cluster_id", T.word_count(F.col("text")).alias("total"))


def number(total: Column, c: WindowConfig) -> Column:
    """How many windows a document of so many words has."""
    raw = F.when(total <= c.words, 1).otherwise(F.ceil((total - c.words) / c.stride) + 1).cast("int")
    return F.when((raw > 1) & (total - (raw - 1) * c.stride < c.least_last), raw - 1).otherwise(raw)


def band(index: Column, n: Column, c: WindowConfig = WindowConfig()) -> Column:
    """early, middle or late: a single window is late, two are early and late, of more the first and last shares count, rounded half to even, at least one early and two late."""
    early = F.greatest(F.lit(1), F.bround(n * c.early).cast("int"))
    late = F.greatest(F.lit(2), F.bround(n * c.late).cast("int"))
    return F.when(n == 1, "late").when(n == 2, F.when(index == 0, "early").otherwise("late")).when(index < early, "early").when(index >= n - late, "late").otherwise("middle")


def bounds(docs: DataFrame, c: WindowConfig = WindowConfig()) -> DataFrame:
    """docs with a row for each window: chunk_index, n_chunks, start_word, end_word (excluded), position.

    Windows begin every stride words until one reaches the end; a last one of fewer than least_last words is folded
    into the one before it. A document of at most ``words`` words is one window.
    """
    rows = docs.withColumn("n_chunks", number(F.col("total"), c)).withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    start = F.col("chunk_index") * c.stride
    end = F.when(F.col("chunk_index") == F.col("n_chunks") - 1, F.col("total")).otherwise(start + c.words)
    return rows.withColumn("start_word", start).withColumn("end_word", end).withColumn("position", band(F.col("chunk_index"), F.col("n_chunks"), c))


def windows(opinions: DataFrame, c: WindowConfig = WindowConfig(), snap: bool = True, text: bool = True) -> DataFrame:
    """(cluster_id, chunk_index, n_chunks, start_word, end_word, char_start, char_end, position[, text]).

    char_end is the end of the last word, or of the text for the last window; with ``snap`` char_start of all but the
    first window moves back to a paragraph or sentence break, so windows overlap by at least the nominal words. Offsets
    are code points of the stripped text, so substring(text, char_start + 1, char_end - char_start) is the window.
    Null and blank documents have no window; repeated rows have theirs each.
    """
    made = spread(opinions.select("cluster_id", "text")).select("cluster_id", F.explode(windowed(c.words, c.stride, c.least_last, snap, text)("text")).alias("w")).select("cluster_id", "w.*")
    names = ["cluster_id", "chunk_index", "n_chunks", "start_word", "end_word", "char_start", "char_end"]
    return made.select(*names, band(F.col("chunk_index"), F.col("n_chunks"), c).alias("position"), *(["text"] if text else []))


def coverage_report(opinions: DataFrame, c: WindowConfig = WindowConfig()) -> DataFrame:
    """One row: opinions, chunks, median and most chunks of a document, chunks by position, words, covered words in percent.

    A document's windows are counted inside its row, so only one row of sums leaves each task.
    """
    docs = sizes(opinions).withColumn("n", number(F.col("total"), c))
    bands = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: band(i, F.col("n"), c))
    docs = docs.select("n", "total", bands.alias("b"))
    held = lambda p: F.sum(F.size(F.filter("b", lambda x: x == p)))
    # The last window ends with the document, so every document is covered to its end.
    return docs.agg(
        F.count("*").alias("opinions"), F.sum("n").alias("chunks"), T.upper_median("n").alias("median_chunks"), F.max("n").alias("max_chunks"),
        held("early").alias("early"), held("middle").alias("middle"), held("late").alias("late"), F.sum("total").alias("words"), F.round(100 * F.sum("total") / F.sum("total"), 1).alias("coverage_pct"),
    )


def band_share(opinions: DataFrame, c: WindowConfig = WindowConfig()) -> DataFrame:
    """(position, n, pct): windows by band."""
    return T.share_of_all(bounds(sizes(opinions), c).groupBy("position").agg(F.count("*").alias("n")))
