"""Splits that keep related records together (problem 7).

Components of linked groups are weighed by their rows and put into many equal bins by the largest differencing
method; whole bins then go to the splits. Differencing works on tuples of ``bins`` partial sums: a block of
components is reduced to one tuple by repeatedly combining the two tuples of the largest spread, largest part on
smallest, and the blocks' tuples are combined the same way in rounds, FAN of them in a task, until one is left.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketforge.operators.components import connected_components
from docketforge.session import cut

#: Components in a block of the differencing; bounds a task's memory.
BLOCK = 20_000
#: Tuples that a task combines in a round.
FAN = 64


def question_key(column: str) -> F.Column:
    """Lower case, runs of characters other than a-z and 0-9 as one blank, trimmed; empty becomes null."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(F.col(column)), "[^a-z0-9]+", " ")), F.lit(""))


def linked_groups(records: DataFrame, group: str = "cluster_id", text: str = "question") -> DataFrame:
    """(node, component) for each group that shares a text key with another; component is the smallest group id.

    A key's groups are linked by a star to the smallest of them, so a key that a third of all rows have costs one
    edge a group. Null groups and null or empty texts link nothing.
    """
    pairs = records.select(F.col(group).alias("g"), F.xxhash64(question_key(text)).alias("k"), question_key(text).isNotNull().alias("has"))
    pairs = cut(pairs.where("has AND g IS NOT NULL").select("g", "k").distinct(), "p7-pairs")
    low = pairs.groupBy("k").agg(F.min("g").alias("m"), F.count("*").alias("n")).where("n > 1").select("k", "m")
    edges = pairs.join(low, "k").where("g <> m").select(F.col("g").alias("u"), F.col("m").alias("v"))
    return connected_components(edges)


def _combine(a: tuple[np.ndarray, list], b: tuple[np.ndarray, list]) -> tuple[np.ndarray, list]:
    """Two (descending sums, members of each bin): the largest part of one joins the smallest of the other."""
    sums = a[0] + b[0][::-1]
    order = np.argsort(-sums, kind="stable")
    members = [(x, y) for x, y in zip(a[1], b[1][::-1])]
    return sums[order], [members[i] for i in order]


def difference(weights: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each weight, sum of each bin) by the largest differencing method over ``bins`` bins."""
    heap = []
    for i in range(len(weights)):
        sums = np.zeros(bins)
        sums[0] = weights[i]
        heap.append((-float(weights[i]), i, (sums, [i] + [None] * (bins - 1))))
    return _unroll(heap, len(weights), bins)


def _unroll(heap: list, n: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        c = _combine(a, b)
        heapq.heappush(heap, (-(c[0][0] - c[0][-1]), tick, c))
        tick += 1
    where = np.zeros(n, dtype=np.int64)
    if not heap:
        return where, np.zeros(bins)
    sums, members = heap[0][2]
    for i, tree in enumerate(members):
        stack = [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            elif x is not None:
                where[x] = i
    return where, sums


def difference_tuples(tuples: np.ndarray) -> np.ndarray:
    """tuples[i] are the sums of block i's bins; returns the global bin of each block's bin, by differencing the tuples."""
    n, bins = tuples.shape
    heap = []
    for i in range(n):
        order = np.argsort(-tuples[i], kind="stable")
        heap.append((-float(tuples[i].max() - tuples[i].min()), i, (tuples[i][order], [i * bins + int(j) for j in order])))
    where, _ = _unroll(heap, n * bins, bins)
    return where.reshape(n, bins)


def allocate(sums: np.ndarray, shares: dict[str, float]) -> list[str]:
    """The split of each bin: from the largest bin on, each goes to the split that lacks most of its share."""
    left = {name: share * sums.sum() for name, share in shares.items()}
    out = [""] * len(sums)
    for i in np.argsort(-sums, kind="stable"):
        best = max(left, key=lambda s: left[s])
        out[int(i)] = best
        left[best] -= sums[i]
    return out


def assign_splits(
    records: DataFrame,
    shares: dict[str, float] | None = None,
    bins: int = 100,
    group: str = "cluster_id",
    text: str = "question",
    key: str = "pair_id",
    block: int = BLOCK,
) -> DataFrame:
    """(key, group, component, new_split, new_bin) for every row of ``records``, at ``shares`` of the rows.

    Rows of one group, or of groups linked by an equal text key, are never separated. A row without group is linked
    by its text key alone if that key belongs to a component, else it stands for itself by its key. Repeated rows
    count as often as they occur. Extra columns are ignored; an empty table gives an empty result. A component
    heavier than a bin takes a bin of its own and the shares then differ by what it weighs over.
    """
    shares = shares or {"train": 0.8, "val": 0.1, "test": 0.1}
    rows = records.select(F.col(key).alias("key"), F.col(group).alias("g"), F.xxhash64(question_key(text)).alias("k"), question_key(text).isNotNull().alias("has"))
    linked = linked_groups(records, group, text).select(F.col("node").alias("g"), "component")
    by_key = None
    if rows.where("g IS NULL").limit(1).count():
        keyed = rows.where("has AND g IS NOT NULL").select("k", "g").distinct().join(linked, "g", "left")
        by_key = keyed.groupBy("k").agg(F.min(F.coalesce("component", "g")).alias("via"))
    placed = rows.join(linked, "g", "left").withColumn("component", F.coalesce("component", "g"))
    if by_key is not None:
        orphan = rows.where("g IS NULL").join(by_key, "k", "left")
        # Rows without a group and without a linked text: those of one text stay together, the rest stand alone.
        alone = F.when(F.col("has"), F.xxhash64(F.lit("text"), "k")).otherwise(F.xxhash64(F.lit("row"), "key"))
        orphan = orphan.select("key", "g", "k", "has", F.coalesce("via", alone).alias("component"))
        placed = placed.where("g IS NOT NULL").select("key", "g", "k", "has", "component").unionByName(orphan)
    placed = cut(placed.select("key", "g", "component"), "p7-placed")
    weights = cut(placed.groupBy("component").agg(F.count("*").alias("w")), "p7-weights")
    n = weights.count()
    blocks = max(1, -(-n // block))

    def reduce_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["w", "component"], ascending=[False, True], kind="stable")
        where, _ = difference(pdf["w"].to_numpy(dtype=float), bins)
        return pd.DataFrame({"block": pdf["block"].to_numpy(), "component": pdf["component"].to_numpy(), "w": pdf["w"].to_numpy(), "local": where})

    local = weights.withColumn("block", F.pmod(F.xxhash64("component"), F.lit(blocks)).cast("int"))
    local = cut(local.groupBy("block").applyInPandas(reduce_block, "block int, component long, w long, local long"), "p7-local")
    where = local.select("component", F.col("block").alias("b"), F.col("local").alias("l"))
    level, n = local.groupBy("block", "local").agg(F.sum("w").alias("w")), blocks

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.sort(pdf["block"].unique())
        tuples = np.zeros((len(names), bins))
        tuples[np.searchsorted(names, pdf["block"]), pdf["local"]] = pdf["w"]
        to = difference_tuples(tuples)
        grid = np.meshgrid(names, np.arange(bins), indexing="ij")
        return pd.DataFrame({"block": grid[0].ravel(), "local": grid[1].ravel(), "w": tuples.ravel().astype(np.int64), "parent": int(names[0]) // FAN, "into": to.ravel()})

    while n > 1:
        step = cut(level.groupBy(F.floor(F.col("block") / FAN)).applyInPandas(combine, "block int, local long, w long, parent int, into long"), "p7-level")
        level = step.groupBy(F.col("parent").alias("block"), F.col("into").alias("local")).agg(F.sum("w").alias("w"))
        where = where.join(step.select(F.col("block").alias("b"), F.col("local").alias("l"), "parent", "into"), ["b", "l"]).select("component", F.col("parent").alias("b"), F.col("into").alias("l"))
        n = -(-n // FAN)
    # One tuple is left: as many rows as bins.
    sums = np.zeros(bins)
    for r in level.collect():
        sums[r["local"]] = r["w"]
    names = allocate(sums, shares)
    lookup = records.sparkSession.createDataFrame([(j, names[j]) for j in range(bins)], "new_bin long, new_split string")
    where = where.select("component", F.col("l").alias("new_bin")).join(F.broadcast(lookup), "new_bin").select("component", F.col("new_bin").cast("int").alias("new_bin"), "new_split")
    return placed.join(where, "component").select(F.col("key").alias(key), F.col("g").alias(group), "component", "new_split", "new_bin")


def found(records: DataFrame) -> DataFrame:
    """p7_found: (cluster_id, group_id) of each group linked to another."""
    return linked_groups(records).select(F.col("node").alias("cluster_id"), F.col("component").alias("group_id"))
