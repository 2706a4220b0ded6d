"""Subject area of each document (problem 10).

A complement naive Bayes over hashed word pairs is fitted on labelled documents and refined by expectation-maximization
over the sentences of all documents, whose words count with the sentence's posterior: a pair's weight for a subject grows with how much rarer it is in the text of all
other subjects than its frequency lets expect. A sentence belongs to the subject with the highest sum of weights, or to
none. The share of a document's text that a subject takes is turned into a posterior of its own for each subject,
calibrated on labelled documents that the fit hasn't seen, so a document may have none, one or several subjects.
"""

from __future__ import annotations

import unicodedata
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketforge.llm.blocks import BLOCKS, block_rows, tree_sum
from docketforge.session import cut, spread

#: Cells that pairs of neighbouring words are hashed to.
WIDTH = 1 << 18
#: Documents with labels that the first fit and the calibration take at most, chosen by a hash of their id.
LABELLED = 20_000
#: Subjects whose tables of WIDTH cells a task can hold.
MOST_SUBJECTS = 256
#: Expected counts are sent as whole parts of this size.
GRAIN = 64
ROUNDS = 2
#: Pseudo-count of a word in the text of other subjects.
PRIOR = 2.0
#: Sum of the weights of a text's different word pairs by which the text has a subject, and sum over a sentence's pairs
#: by which a sentence of such a text belongs to it.
TOGETHER, ENOUGH = 4.5, 1.0
#: A weight above this counts as this much, so a text needs several.
MOST = 2.0
#: A weight below this isn't evidence: it keeps the words of no subject, or chance in few texts, from adding up.
FAINT = (0.6, 0.3)
#: Labelled documents of a subject, and their share, in which the first fit must have met a word to count it.
MET, MET_SHARE = 3, 0.004
FLUSH = 400_000


def _code(token: str) -> int:
    """The hash of a token's word times two, plus one where the token ends a sentence; -1 or -2 for tokens without a word.

    Names and figures are one word each: they make most different pairs, would crowd the cells and tell nothing.
    """
    ends = token[-1:] in ".?!" or token[-2:-1] in ".?!" and token[-1:] in "\"”')"
    word = token.strip(".,;:!?()[]{}\"“”'’«»…—-").lower()
    if not word:
        return -2 if ends else -1
    if any(c.isdigit() for c in word):
        word = "0"
    elif token.lstrip("(\"“'‘«")[:1].isupper():
        word = "#"
    elif not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    h = 2166136261
    for c in word.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return ((h ^ h >> 15) & 0xFFFFFF) * 2 + ends


def features(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, cells, sizes): the cells of neighbouring words in order, and the number of them and of all tokens of each sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in batches:
            if len(memo) > FLUSH:
                memo.clear()
            cells, sizes, tokens_in = [], [], []
            for x in batch.column(1).to_pylist():
                tokens = (x or "").split()
                for t in set(tokens).difference(memo):
                    memo[t] = _code(t)
                codes = np.fromiter(map(memo.__getitem__, tokens), np.int32, len(tokens))
                ends = (codes == -2) | ((codes >= 0) & (codes % 2 == 1))
                if len(ends):
                    ends[-1] = True
                at = np.flatnonzero(ends)
                sentence = np.cumsum(ends) - ends
                words, of = codes[codes >= 0].astype(np.int64) // 2, sentence[codes >= 0]
                within = of[1:] == of[:-1]
                cells.append((((words[:-1] * 0x9E37 + words[1:] * 0x85EB) >> 4) % WIDTH)[within])
                sizes.append(np.bincount(of[1:][within], minlength=len(at)).astype(np.int32))
                tokens_in.append(np.diff(at, prepend=-1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(_lists(c) for c in (cells, sizes, tokens_in))], names=["doc_id", "cells", "sizes", "tokens"])

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("__text"))
    return rows.mapInArrow(run, "doc_id long, cells array<int>, sizes array<int>, tokens array<int>")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


class Batch:
    """Sentences of some documents as flat arrays."""

    def __init__(self, cells: pa.Array, sizes: pa.Array, tokens: pa.Array):
        self.cells = np.asarray(cells.flatten())
        self.sizes = np.asarray(sizes.flatten()).astype(np.int64)
        self.tokens = np.asarray(tokens.flatten()).astype(np.int64)
        self.docs = np.repeat(np.arange(len(sizes)), np.diff(np.asarray(sizes.offsets)))
        self.n = len(sizes)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the words' weights of each sentence, by subject."""
        out = np.zeros((len(self.sizes), weights.shape[1]), np.float32)
        full = self.sizes > 0
        if full.any():
            starts = (np.cumsum(self.sizes) - self.sizes)[full]
            out[full] = np.add.reduceat(weights[self.cells], starts, axis=0)
        return out

    def subject(self, weights: np.ndarray) -> np.ndarray:
        """The subject of each sentence, or the number of subjects for none."""
        k = weights.shape[1]
        s = self.sums(weights)
        best = s.argmax(axis=1)
        has = np.zeros((self.n, k), bool)
        telling = weights.any(axis=1)[self.cells]
        of_word = np.repeat(self.docs, self.sizes)[telling]
        if len(of_word):
            once = np.unique(of_word * WIDTH + self.cells[telling])
            doc, starts = np.unique(once // WIDTH, return_index=True)
            has[doc] = np.add.reduceat(weights[once % WIDTH], starts, axis=0) >= TOGETHER
        return np.where((s[np.arange(len(s)), best] >= ENOUGH) & has[self.docs, best], best, k)

    def expected(self, weights: np.ndarray) -> np.ndarray:
        """Expected words by subject (none included) and cell: a sentence's words count for its subject with the posterior of its sum of weights, and for none with the rest."""
        k = weights.shape[1]
        s = self.sums(weights)
        best = self.subject(weights)
        at = np.minimum(best, k - 1)
        p = np.where(best < k, 1 / (1 + np.exp(-np.clip(2 * (s[np.arange(len(s)), at] - ENOUGH) + 2, -30, 30))), 0.0)
        cells, of = self.cells, np.repeat(np.arange(len(s)), self.sizes)
        out = np.bincount(at[of] * WIDTH + cells, weights=p[of], minlength=(k + 1) * WIDTH)
        out[k * WIDTH :] += np.bincount(cells, weights=(1 - p)[of], minlength=WIDTH)
        return out.reshape(k + 1, WIDTH)

    def shares(self, weights: np.ndarray) -> np.ndarray:
        """The share of each document's tokens that lies in each subject's sentences, and a column for none."""
        k = weights.shape[1] + 1
        at = self.docs * k + self.subject(weights)
        held = np.bincount(at, weights=self.tokens, minlength=self.n * k).reshape(self.n, k)
        return held / np.maximum(held.sum(axis=1, keepdims=True), 1)


def weights_of(counts: np.ndarray, faint: float) -> np.ndarray:
    """Weight of each cell for each subject from counts by subject; the last row of counts is text of no subject."""
    every = counts.sum(axis=0)
    share = counts.sum(axis=1) / max(1.0, counts.sum())
    rest = every[None, :] - counts
    expected = every[None, :] * (1 - share[:, None])
    w = np.log((expected + PRIOR) / (rest + PRIOR))[:-1]
    return np.ascontiguousarray(np.where(w > faint, np.minimum(w, MOST), 0).T.astype(np.float32))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """(intercept, slope) of the posterior of y by x, by Newton steps."""
    a, b = -2.0, 8.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(p - y).sum() + 1e-3 * a, ((p - y) * x).sum() + 1e-3 * b])
        v = p * (1 - p)
        h = np.array([[v.sum() + 1e-3, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -4, 4)
    return float(a), float(b)


def _sum_counts(feats: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Expected words by subject and cell over the sentences of all documents; a task sends one block for each subject, and blocks are added up in rounds."""
    k = weights.shape[1] + 1
    shared = feats.sparkSession.sparkContext.broadcast(weights)
    parts = feats.rdd.getNumPartitions()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, WIDTH))
        for b in batches:
            one = Batch(b.column(0), b.column(1), b.column(2))
            total += one.expected(shared.value)
        yield block_rows(TaskContext.get().partitionId(), np.rint(total * GRAIN))

    out = tree_sum(feats.select("cells", "sizes", "tokens").mapInArrow(run, BLOCKS), parts, k, WIDTH) / GRAIN
    shared.unpersist()
    return out


def classify(
    documents: DataFrame,
    labels: DataFrame,
    subjects: DataFrame,
    least: float = 0.5,
    rounds: int = ROUNDS,
    labelled: int = LABELLED,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, subject, posterior, share): the subjects of each document whose posterior is at least ``least``.

    The first fit and the calibration use at most ``labelled`` labelled documents, four fifths for the one and a fifth for the other; the refinement and the result cover
    all documents and whole texts. Wrong labels are outweighed by the refinement, which goes by sentences, not labels.
    Null or empty texts and texts without a subject don't appear. Labels of unknown documents or subjects are ignored;
    without any label the result is empty. Repeated rows of one doc_id come out once.
    """
    spark = documents.sparkSession
    names = sorted(r[0] for r in subjects.select("subject").where("subject IS NOT NULL").distinct().limit(MOST_SUBJECTS + 1).collect())
    if len(names) > MOST_SUBJECTS:
        raise ValueError(f"classify() holds a table of all subjects; there are more than {MOST_SUBJECTS}")
    place = {s: i for i, s in enumerate(names)}
    k = len(names)
    feats = cut(features(spread(documents), key, text), "p10-features")
    none = spark.createDataFrame([], "doc_id long, subject string, posterior double, share double")
    if not k:
        return none
    marked = labels.where(F.col("subject").isin(names)).groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    # A fifth of the labelled documents, by another hash, is kept from the first fit and calibrates the posteriors.
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0
    sample = feats.join(marked, "doc_id").select("cells", "sizes", "tokens", "subjects", held.alias("held")).toArrow()
    if not sample.num_rows:
        return none
    cols = [sample.column(i).combine_chunks() for i in range(3)]
    cols = [c if isinstance(c, pa.Array) else c.chunk(0) for c in cols]
    batch = Batch(*cols)
    truth = np.zeros((batch.n, k))
    for i, given in enumerate(sample.column(3).to_pylist()):
        for s in given:
            truth[i, place[s]] = 1
    held = np.asarray(sample.column(4).combine_chunks().to_pylist(), bool)
    if held.all() or not held.any():
        held[:] = True
        fitted = held
    else:
        fitted = ~held
    # First fit: each word of a document counts once, in equal parts for its labels.
    part = truth / np.maximum(truth.sum(axis=1, keepdims=True), 1) * fitted[:, None]
    once = np.unique(np.repeat(batch.docs, batch.sizes) * WIDTH + batch.cells)
    counts = np.zeros((k + 1, WIDTH))
    for c in range(k):
        counts[c] = np.bincount(once % WIDTH, weights=part[once // WIDTH, c], minlength=WIDTH)
    weights = weights_of(counts, FAINT[0])
    weights[counts[:k].T < np.maximum(MET, MET_SHARE * truth[fitted].sum(axis=0))[None, :]] = 0
    for _ in range(rounds):
        weights = weights_of(_sum_counts(feats, weights), FAINT[1])
    # One calibration for a document's main subject, another for those behind it.
    shares = batch.shares(weights)[:, :k]
    main = shares.argmax(axis=1)
    ranks = np.zeros_like(shares, bool)
    ranks[np.arange(batch.n), main] = True
    told = (shares.sum(axis=1) > 0) & held
    if not told.any():
        told = shares.sum(axis=1) > 0
    first = _logistic(shares[told, main[told]], truth[told, main[told]])
    relative = shares / np.maximum(shares.sum(axis=1, keepdims=True), 1e-9)
    others = told[:, None] & ~ranks & (shares > 0)
    second = _logistic(relative[others], truth[others]) if others.any() else (-20.0, 0.0)
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posterior = lambda ab, x: 1 / (1 + np.exp(-np.clip(ab[0] + ab[1] * x, -30, 30)))
        for b in batches:
            one = Batch(b.column(1), b.column(2), b.column(3))
            s = one.shares(shared.value)[:, :k]
            p = posterior(second, s / np.maximum(s.sum(axis=1, keepdims=True), 1e-9))
            top = s.argmax(axis=1)
            p[np.arange(one.n), top] = np.maximum(posterior(first, s[np.arange(one.n), top]), p[np.arange(one.n), top])
            d, c = np.nonzero((p >= least) & (s > 0))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d)), pa.array([names[i] for i in c], pa.string()), pa.array(p[d, c]), pa.array(s[d, c])], names=["doc_id", "subject", "posterior", "share"])

    rows = feats.mapInArrow(run, "doc_id long, subject string, posterior double, share double")
    return rows.groupBy("doc_id", "subject").agg(F.max("posterior").alias("posterior"), F.max("share").alias("share"))


def composition(classified: DataFrame) -> DataFrame:
    """(subject, docs): how many documents each subject has."""
    return classified.groupBy("subject").agg(F.count_distinct("doc_id").alias("docs"))


def found(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """p10_found: (doc_id, subject)."""
    return classify(documents, labels, subjects).select("doc_id", "subject")
