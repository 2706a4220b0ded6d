"""Filling fixed-capacity containers by a grouping genetic algorithm on islands (problem 8)."""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketforge.llm.tokens import TOKENIZERS, with_tokens
from docketforge.session import cut, spread

#: Containers that the items of one block fill, more or less; a block leaves at most about one of them half empty.
BLOCK_BINS = 512
ISLANDS, GENERATIONS, POPULATION = 2, 12, 4
SCHEMA = "container string, capacity int, block long, island int, doc_id long, piece int, tokens int, item int, bin int"


class Packing:
    """Items put into bins: bins are lists of items, sums their sizes."""

    __slots__ = ("bins", "sums")

    def __init__(self, bins: list[list[int]], sums: list[int]):
        self.bins, self.sums = bins, sums

    def fitness(self, capacity: int) -> tuple[int, float]:
        """Fewer bins first; among equals, bins as uneven as possible, which leaves room to close one."""
        return -len(self.bins), sum((s / capacity) ** 2 for s in self.sums)


def best_fit(items: list[int], sizes: list[int], capacity: int, onto: Packing | None = None) -> Packing:
    """Each item into the fullest bin that still takes it, in the given order; ``onto`` is extended in place."""
    packing = onto or Packing([], [])
    bins, sums = packing.bins, packing.sums
    rooms = sorted((capacity - s, i) for i, s in enumerate(sums) if s < capacity)
    for x in items:
        size = sizes[x]
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, i = rooms.pop(at)
            bins[i].append(x)
            sums[i] += size
        else:
            i, room = len(bins), capacity
            bins.append([x])
            sums.append(size)
        if room > size:
            insort(rooms, (room - size, i))
    return packing


def cross(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: random.Random, share: float) -> Packing:
    """A child of a: well-filled whole bins of b are put in, bins of a that hold one of their items are dropped, and what these held besides is best-fitted, largest first."""
    full = sorted(range(len(b.bins)), key=lambda i: -b.sums[i])
    pool = full[: max(1, len(full) // 2)]
    chosen = rng.sample(pool, max(1, int(len(pool) * share)))
    inside = {x for i in chosen for x in b.bins[i]}
    bins, sums, loose = [], [], []
    # The least filled bin is always opened, else a child couldn't have fewer bins than a.
    worst = min(range(len(a.bins)), key=a.sums.__getitem__)
    for i, held in enumerate(a.bins):
        if i == worst or not inside.isdisjoint(held):
            loose.extend(x for x in held if x not in inside)
        else:
            bins.append(list(held))
            sums.append(a.sums[i])
    for i in chosen:
        bins.append(list(b.bins[i]))
        sums.append(b.sums[i])
    loose.sort(key=lambda x: -sizes[x])
    return best_fit(loose, sizes, capacity, Packing(bins, sums))


def evolve(sizes: list[int], capacity: int, start: list[Packing], seed: int, generations: int = GENERATIONS, population: int = POPULATION) -> Packing:
    """The fittest packing after some generations, never worse than those it starts from."""
    rng = random.Random(seed)
    least = -(-sum(sizes) // capacity)
    people = list(start)
    order = sorted(range(len(sizes)), key=lambda x: -sizes[x])
    if not people:
        people.append(best_fit(order, sizes, capacity))
    while len(people) < population and min(len(p.bins) for p in people) > least:
        jitter = [sizes[x] * (1 + 0.25 * rng.random()) for x in range(len(sizes))]
        people.append(best_fit(sorted(order, key=lambda x: -jitter[x]), sizes, capacity))
    people.sort(key=lambda p: p.fitness(capacity), reverse=True)
    for _ in range(generations):
        if len(people[0].bins) <= least or len(people) < 2:
            break
        mother = people[0] if rng.random() < 0.5 else rng.choice(people)
        father = rng.choice([p for p in people if p is not mother])
        people.append(cross(mother, father, sizes, capacity, rng, 0.1))
        people.sort(key=lambda p: p.fitness(capacity), reverse=True)
        del people[population:]
    return people[0]


def _island(pdf: pd.DataFrame, generations: int, population: int, epoch: int) -> pd.DataFrame:
    """Evolves one island's block. pdf has the items, after the first epoch once for each packing (``origin``) with its ``bin``."""
    first = pdf.iloc[0]
    capacity = int(first["capacity"])
    if "item" not in pdf:
        pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        pdf["item"] = range(len(pdf))
        start = []
        items = pdf
    else:
        start, items = [], None
        for _, one in pdf.sort_values("item", kind="stable").groupby("origin", sort=True):
            sizes = one["tokens"].tolist()
            bins: dict[int, list[int]] = {}
            for x, i in zip(one["item"].tolist(), one["bin"].tolist()):
                bins.setdefault(i, []).append(x)
            start.append(Packing(list(bins.values()), [sum(sizes[x] for x in held) for held in bins.values()]))
            items = one if items is None else items
    sizes = items["tokens"].tolist()
    seed = zlib.crc32(f"{capacity} {first['block']} {first['island']} {epoch}".encode())
    best = evolve(sizes, capacity, start, seed, generations, population)
    where = [0] * len(sizes)
    for i, held in enumerate(best.bins):
        for x in held:
            where[x] = i
    out = items[["container", "capacity", "block", "island", "doc_id", "piece", "tokens", "item"]].copy()
    out["island"] = int(first["island"])
    out["bin"] = where
    return out


def pack(
    documents: DataFrame,
    capacities: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    islands: int = ISLANDS,
    generations: int = GENERATIONS,
    population: int = POPULATION,
    block_bins: int = BLOCK_BINS,
    folder: str = TOKENIZERS,
) -> DataFrame:
    """(container, capacity, bin_id, doc_id, piece, tokens): where each document lies, for every capacity.

    A document of more tokens than the capacity is cut into full pieces, each a bin of its own, and a rest that is
    packed like any document; any other document is one piece. Items are hashed into blocks of about ``block_bins``
    bins. ``islands`` islands evolve each block, send their elite around a ring, evolve again, and the best island's
    packing stays. An empty or null text has one piece of 0 tokens and no bin. Repeated rows are packed as often as
    they occur; a null key is kept. Capacities that are null or below 1 are left out. Results don't depend on the
    partitioning.
    """
    sized = with_tokens(spread(documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))), "text", ["doc_id"], folder)
    return pack_sizes(cut(sized, "p8-sizes"), capacities, islands, generations, population, block_bins)


def pack_sizes(sized: DataFrame, capacities: DataFrame, islands: int = ISLANDS, generations: int = GENERATIONS, population: int = POPULATION, block_bins: int = BLOCK_BINS) -> DataFrame:
    """As pack(), from (doc_id, tokens)."""
    spark = sized.sparkSession
    caps = capacities.select("container", F.col("capacity_tokens").cast("int").alias("capacity")).where("capacity > 0").distinct().limit(1001).collect()
    if len(caps) > 1000:
        raise ValueError("pack_sizes() takes at most 1000 capacities")
    if not caps:
        return spark.createDataFrame([], "container string, capacity int, bin_id string, doc_id long, piece int, tokens int")
    total = sized.agg(F.sum(F.col("tokens").cast("long"))).first()[0] or 0
    each = F.array(*[F.struct(F.lit(c["container"]).alias("container"), F.lit(c["capacity"]).alias("capacity"), F.lit(max(1, round(total / (c["capacity"] * block_bins)))).cast("long").alias("blocks")) for c in caps])
    items = sized.select("doc_id", "tokens", F.explode(each).alias("c")).select("doc_id", "tokens", "c.*")
    count = F.greatest(F.ceil(F.col("tokens") / F.col("capacity")), F.lit(1)).cast("int")
    pieces = items.withColumn("piece", F.explode(F.sequence(F.lit(0), count - 1)))
    pieces = pieces.withColumn("tokens", F.least(F.col("capacity"), F.col("tokens") - F.col("piece") * F.col("capacity")).cast("int"))
    whole = pieces.where("tokens = capacity OR tokens = 0").select(
        "container", "capacity",
        F.when(F.col("tokens") > 0, F.concat_ws("-", "container", F.lit("full"), "doc_id", "piece")).alias("bin_id"), "doc_id", "piece", "tokens",
    )
    part = pieces.where("tokens < capacity AND tokens > 0")
    part = part.withColumn("block", F.pmod(F.xxhash64("container", "doc_id", "piece", "tokens"), "blocks"))
    part = part.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
    part = part.select("container", "capacity", "block", "island", "doc_id", "piece", "tokens")
    keys = ["container", "capacity", "block", "island"]
    first = part.groupBy(*keys).applyInPandas(lambda pdf: _island(pdf, generations, population, 1), SCHEMA)
    first = cut(first, "p8-elites")
    own = first.withColumn("origin", F.lit(0))
    sent = first.withColumn("island", (F.col("island") + 1) % islands).withColumn("origin", F.lit(1))
    second = own.unionByName(sent).groupBy(*keys).applyInPandas(lambda pdf: _island(pdf, generations, population, 2), SCHEMA)
    second = cut(second, "p8-packed")
    size = second.groupBy("container", "capacity", "block", "island").agg((F.max("bin") + 1).alias("bins"))
    best = size.groupBy("container", "capacity", "block").agg(F.min(F.struct("bins", "island")).alias("b")).select("container", "capacity", "block", "b.island")
    packed = second.join(best, keys, "left_semi").select(
        "container", "capacity", F.concat_ws("-", "container", "block", "bin").alias("bin_id"), "doc_id", "piece", "tokens"
    )
    return packed.unionByName(whole)


def fill_report(packed: DataFrame) -> DataFrame:
    """(container, capacity, bins, least_bins, items, fill): how full the containers are; least_bins is the sum over the capacity."""
    by = packed.where("bin_id IS NOT NULL").groupBy("container", "capacity", "bin_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    return by.groupBy("container", "capacity").agg(
        F.count("*").alias("bins"), F.ceil(F.sum("t") / F.col("capacity")).alias("least_bins"), F.sum("n").alias("items"), F.round(F.sum("t") / (F.count("*") * F.col("capacity")), 6).alias("fill")
    )
