"""Operators on records and sizes: matching, overlap, splits, packing, mixing."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketforge.llm import matching, mixing, overlap, packing, splits, tokens

# ---------------------------------------------------------------- matching


@pytest.mark.parametrize("a, b", [
    ("Acme Corp. v. Doe", "ACME CORPORATION v. DOE, WARDEN"), ("U. S. v. Poe", "UNITED STATES v. POE et al."), ("Dept. of Revenue of X v. Y", "DEPARTMENT OF REVENUE OF X v. Y"), ("  Ann  v.  Bob (Revised)", "ANN v. BOB"), ("Ánn versus Bób", "ANN v. BOB"), ("Ann .v Bob", "ANN v. BOB"),
])
def test_parties(a, b):
    assert matching.parties(a) == matching.parties(b)


def test_readings():
    assert matching.citation("24 U.S. ___ (1983)") == (24, None) and matching.citation("24 US 5") == (24, 5) and matching.citation("3 S. Ct. 4") == (None, None)
    assert matching.authority_id(" 2009/8") == "2009-008" and matching.authority_id("95-005") == "1995-005" and matching.authority_id("x") is None
    assert matching.decided("2000-03-02")[1] == 1999 and matching.decided("3/2/2000")[0] == matching.decided("2000-03-02")[0] and matching.decided("2000-13-45") == (None, None, None)


def test_a_pair_that_meets_many_times_is_taken_once(spark):
    make = lambda rows: matching.encode(spark.createDataFrame(rows, "id long, name string, cite string, date string"), "id", "name", "cite", "date", None, *[F.lit(None).cast("string")] * 4)
    one = make([(1, "Dovelian Steel v. Brenquist", "24 U.S. 7", "2001-03-02"), (2, "Wesbury v. Pelansky", None, "1990-05-06"), (3, "In re Kellmoor", "30 U.S. 9", None)])
    two = make([(1, "DOVELIAN STEEL v. BRENQUIST", "24 U.S. 7", "3/2/2001"), (2, "PELANSKY v. WESBURY", None, "5/6/1990"), (3, "Another v. Third", "30 U.S. 9", None), (4, "Dovelain v. Nobody", None, "2001-03-20")])
    pairs = matching.met(one, two).select("l_id", "r_id", "agreeing").collect()
    assert sorted(map(tuple, pairs)) == [("1", "1", True), ("1", "4", False), ("2", "2", False), ("3", "3", False)]


def test_candidates_find_all_close_vectors(spark):
    """Every pair that differs in at most CHUNKS - AGREE bits is a candidate."""
    rng = random.Random(5)
    name = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2))
    left = [(i, f"{name()} v. {name()}", f"{rng.randint(1, 9)} U.S. {rng.randint(1, 99)}", f"19{rng.randint(50, 99)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}") for i in range(60)]
    right = [(100 + i, n, c, d if i % 3 else "1999-01-01") for i, n, c, d in left] + [(200 + i, n, None, d) for i, n, c, d in left]
    make = lambda rows: matching.encode(spark.createDataFrame(rows, "id long, name string, cite string, date string"), "id", "name", "cite", "date", None, *[F.lit(None).cast("string")] * 4)
    a, b = make(left), make(right)
    rows = lambda df: {r["rep"]: r for r in df.collect()}
    la, rb = rows(a), rows(b)
    got = {(r["l"], r["r"]) for r in matching.candidates(a, b).collect()}
    for x, y in itertools.product(la.values(), rb.values()):
        if None in (x["v"], y["v"]):
            continue
        differ = sum(bin((x[c] ^ y[c]) & (2**64 - 1)).count("1") for c in ("a", "b")) + (x["v"] != y["v"]) + (x["g"] != y["g"]) + (x["t"] != y["t"]) + (x["day"] != y["day"])
        if differ <= len(matching.CHUNKS) - matching.AGREE:
            assert (x["rep"], y["rep"]) in got


def test_no_pair_scored_as_a_match_is_missed(spark):
    """Of all pairs of sf0.01, those of one term and like names, in either order, are candidates."""
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    clusters, cases = read("clusters"), read("scdb_cases")
    left = matching.encode(clusters, "cluster_id", "case_name", "citation", "date_filed", "scdb_id", *matching._cluster_columns(clusters))
    right = matching.encode(cases, "caseid", "casename", "uscite", "datedecision", None, *[F.lit(None).cast("string")] * 4)
    wide = lambda df, p: df.select(*[F.col(c).alias(p if c == "rep" else f"{p}_{c}") for c in df.columns])
    pairs = matching.patterns(wide(left, "l").crossJoin(wide(right, "r"))).where("l_t = r_t AND dice >= 0.8").select("l", "r")
    assert pairs.count() > 100 and pairs.join(matching.candidates(left, right), ["l", "r"], "left_anti").count() == 0
    # Both names with a slip and turned round, no citation, the day off: nothing of the vectors agrees but the term.
    one = matching.encode(spark.createDataFrame([(1, "Zeligeuz v. Kelavlo", None, "1977-04-24")], "id long, name string, cite string, date string"), "id", "name", "cite", "date", None, *[F.lit(None).cast("string")] * 4)
    two = matching.encode(spark.createDataFrame([(2, "KELALVO v. ZELIGUEZ", None, "4/3/1977")], "id long, name string, cite string, date string"), "id", "name", "cite", "date", None, *[F.lit(None).cast("string")] * 4)
    assert matching.candidates(one, two).count() == 1


def test_matching_finds_noisy_copies(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(4)).title()
    cases = [(f"19{60 + i // 20}-{i % 20:03d}", f"{word().upper()} CORPORATION v. {word().upper()}, WARDEN", f"{200 + i % 40} U.S. {i * 7 % 900}", str(1 + i % 14), f"{1 + i % 6}/{1 + i % 28}/{1961 + i // 20}", "1", "5", "4") for i in range(200)]
    clusters = []
    for i, c in enumerate(cases[:150]):
        name = c[1].title().replace("Corporation", "Corp.").replace(", Warden", "").replace(" V. ", " v. ")
        m, d, y = c[4].split("/")
        clusters.append((i, name if i % 5 else name[:-2], c[2] if i % 3 else None, f"{y}-{int(m):02d}-{int(d):02d}", None, None, None, None, None))
    clusters += [(900 + i, f"{word()} v. {word()}", f"{500 + i} U.S. 3", "1950-01-01", None, None, None, None, None) for i in range(20)] + [(999, None, None, None, None, None, None, None, None)]
    c = spark.createDataFrame(clusters, "cluster_id long, case_name string, citation string, date_filed string, scdb_id string, scdb_category string, scdb_decision_direction string, scdb_votes_majority string, scdb_votes_minority string")
    a = spark.createDataFrame(cases, "caseid string, casename string, uscite string, issuearea string, datedecision string, decisiondirection string, majvotes string, minvotes string")
    got = {r["cluster_id"]: r["caseid"] for r in matching.match(c, a).collect()}
    right = sum(got.get(i) == cases[i][0] for i in range(150))
    assert right >= 145 and not [i for i in got if i >= 900]
    assert matching.match(c.limit(0), a).count() == 0


# ---------------------------------------------------------------- overlap


def test_overlap_against_brute_force(spark):
    rng = random.Random(7)
    verbs = ["affirmed", "reversed", "vacated", "modified"]
    rows = []
    for i in range(120):
        town, year = f"Town{chr(97 + i % 26)}{chr(97 + i // 26)}ford", 1900 + i
        q = f"What did the court of appeals decide about the {town} lease in {year} and why did it do so?"
        a = f"The court of appeals {rng.choice(verbs)} the order about the {town} lease because the tenant left in {year}. It then sent the case back for {rng.randint(2, 99)} further findings on the loss."
        rows.append((i, q, a, "train" if i % 3 else "test"))
    extra = [(200, rows[1][1], rows[1][2], "val"), (201, rows[2][1].replace("decide", "determine"), rows[2][2].replace("It then", "It subsequently"), "test"), (202, rows[4][1], rows[5][2], "test"), (203, rows[7][1], rows[7][2].replace("1907", "1908"), "test"), (204, rows[8][1], None, "test"), (205, rows[8][1], rows[8][2], None), (200, rows[1][1], rows[1][2], "val"), (206, rows[10][1].upper(), rows[10][2].upper(), "val")]
    d = spark.createDataFrame(rows + extra, "pair_id long, question string, answer string, split string").withColumn("words", F.lit("clash"))
    got = {(r["eval_id"], r["train_id"]) for r in overlap.overlaps(d).collect()}
    assert got == {(200, 1), (201, 2), (206, 10)}
    assert overlap.overlaps(d.limit(0)).count() == 0


def test_overlap_links_all_copies_of_a_copied_text(spark):
    """Edits of one text, in train and in test: every pair that compares as the same comes out, named or not."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    q, a = [word() for _ in range(20)], [word() for _ in range(40)]
    rows = []
    for i in range(60):
        x, y = list(q), list(a)
        for _ in range(2):
            y[rng.randrange(40)] = word()
        name = ["Kelquist", "Kelqiust", "Kelquists", "Keliquist"][i % 4] if i < 40 else word()
        rows.append((i, " ".join([*x, name]), " ".join(y), "test" if i % 3 == 0 else "train"))
    d = spark.createDataFrame(rows, "pair_id long, question string, answer string, split string")
    made = {i: overlap.Record(f"{x.lower()} | {y}", overlap.names_of(f"{x} | {y}")) for i, x, y, _ in rows}
    want = {(e[0], t[0]) for e in rows for t in rows if e[3] == "test" and t[3] == "train" and overlap.same(made[e[0]], made[t[0]])}
    assert len(want) > 300 and {(r["eval_id"], r["train_id"]) for r in overlap.overlaps(d).collect()} == want


def test_coverage_merges_intervals():
    assert overlap.coverage(list("abcdef"), list("abcd")) == pytest.approx(4 / 6) and overlap.coverage(list("ab"), list("ab")) == 1.0 and overlap.near("calim", "claim") and not overlap.near("june", "july")


# ---------------------------------------------------------------- splits


def test_splits_keep_linked_groups(spark):
    rows = [(i, i % 150, f"Question {i}?") for i in range(3000)] + [(4000 + i, 7777, f"hot {i}") for i in range(900)]
    rows += [(6000, 3, "Shared one!"), (6001, 4, "shared  ONE"), (6002, 5, "shared, two"), (6003, 4, "Shared two"), (6004, None, "shared one"), (6005, None, None), (6006, None, "alone"), (6007, None, "alone"), (6006, None, "alone")]
    d = spark.createDataFrame(rows, "pair_id long, cluster_id long, question string")
    assert sorted((r["cluster_id"], r["group_id"]) for r in splits.found(d).collect()) == [(3, 3), (4, 3), (5, 3)]
    out = splits.assign_splits(d).toPandas()
    assert len(out) == len(rows) and (out.groupby("component").new_split.nunique() == 1).all()
    part = out.new_split.value_counts(normalize=True)
    assert abs(part["train"] - 0.8) < 0.02 and abs(part["val"] - 0.1) < 0.02 and abs(part["test"] - 0.1) < 0.02
    assert out[out.pair_id == 6004].component.iloc[0] == 3 and out[out.pair_id.isin([6006, 6007])].component.nunique() == 1
    assert splits.assign_splits(d.limit(0)).count() == 0


def test_differencing_is_near_equal():
    rng = np.random.default_rng(1)
    w = rng.integers(1, 50, 400).astype(float)
    where, sums = splits.difference(w, 10)
    assert sorted(np.bincount(where, w, 10)) == sorted(sums) and sums.max() - sums.min() <= 2


# ---------------------------------------------------------------- packing and mixing


def test_packing_is_valid_and_tight(spark):
    rng = random.Random(8)
    sizes = [(i, rng.randint(1, 300)) for i in range(800)] + [(900, 0), (901, 2500), (902, 1000), (1, sizes_1 := 77)]
    out = packing.pack_sizes(spark.createDataFrame(sizes, "doc_id long, tokens int"), spark.createDataFrame([("c", 1000), ("bad", None)], "container string, capacity_tokens int"), block_bins=40).toPandas()
    held = out[out.bin_id.notna()].groupby("bin_id").tokens.sum()
    assert held.max() <= 1000 and out.tokens.sum() == sum(t for _, t in sizes) and sizes_1 == 77
    assert sorted(out[out.doc_id == 901].tokens) == [500, 1000, 1000] and out[out.doc_id == 900].bin_id.isna().all() and (out[out.doc_id < 900].groupby("doc_id").piece.max() == 0).all()
    assert len(held) <= 1.03 * -(-sum(t for _, t in sizes) // 1000) + 2


def test_evolution_never_loses_items_or_quality():
    rng = random.Random(9)
    sizes = [rng.randint(20, 70) for _ in range(120)]
    first = packing.best_fit(sorted(range(120), key=lambda x: -sizes[x]), sizes, 100)
    best = packing.evolve(sizes, 100, [], 1, generations=30, population=6)
    assert sorted(x for b in best.bins for x in b) == list(range(120)) and all(sum(sizes[x] for x in b) == s <= 100 for b, s in zip(best.bins, best.sums)) and len(best.bins) <= len(first.bins)


def test_mix_meets_its_shares(spark):
    rng = random.Random(10)
    docs = [(i, "word " * rng.randint(20, 200), "big") for i in range(600)] + [(1000 + i, "word " * rng.randint(20, 200), "small") for i in range(60)] + [(2000, None, "big"), (2001, "x", None), (2002, "x", "other"), (1, "word " * 50, "big")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 3), ("void", 0.1, 1)], "source string, target_share double, max_repeats int")
    out = mixing.mix(d, t)
    s = {r["source"]: r for r in mixing.shares(out, t).collect()}
    assert abs(s["big"]["actual_share"] - 0.7) < 0.01 and abs(s["small"]["actual_share"] - 0.3) < 0.01 and s["small"]["most_copies"] <= 3 and s["big"]["most_copies"] == 1 and s["void"]["docs"] == 0
    again = mixing.mix(d.repartition(7), t)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(out) == key(again) and key(out) != key(mixing.mix(d, t, seed=8))
    assert mixing.mix(d.limit(0), t).count() == 0


def test_token_counts(spark):
    d = spark.createDataFrame([(1, "The lease ran for ten years."), (2, None), (3, "")], "doc_id long, text string")
    assert [r["tokens"] for r in tokens.with_tokens(d, "text", ["doc_id"]).orderBy("doc_id").collect()] == [7, 0, 0]


def test_blocks_add_up_in_rounds(spark):
    import numpy as np

    from docketforge.llm import blocks

    table = lambda i: np.arange(12).reshape(3, 4) + i
    rows = [(i, b, table(i)[b].astype(np.int64).tobytes()) for i in range(40) for b in range(3)]
    got = blocks.tree_sum(spark.createDataFrame(rows, blocks.BLOCKS), 40, 3, 4)
    assert (got == sum(table(i) for i in range(40))).all()


def test_splits_by_rounds_of_blocks(spark):
    d = spark.range(6000).select(F.col("id").alias("pair_id"), (F.col("id") % 900).alias("cluster_id"), F.concat(F.lit("question number "), F.col("id").cast("string")).alias("question"))
    out = splits.assign_splits(d, block=8)
    shares = {r["new_split"]: r["count"] for r in out.groupBy("new_split").count().collect()}
    assert out.count() == 6000 and abs(shares["train"] - 4800) < 120 and abs(shares["val"] - 600) < 60 and out.select("cluster_id", "new_split").distinct().count() == 900


def test_overlaps_with_both_sides_of_a_shard_split(spark, monkeypatch):
    text = lambda i: f"The {WORDS_[i % 7]} of Ovalford and {WORDS_[i // 7 % 7]} were held to 40 dollars under the lease"
    rows = [(i, "train" if i % 2 else "test", f"What did the court hold about the {WORDS_[i % 7]} and {WORDS_[i // 7 % 7]}?", text(i)) for i in range(98)]
    d = spark.createDataFrame(rows, "pair_id long, split string, question string, answer string")
    whole = {(r["eval_id"], r["train_id"]) for r in overlap.overlaps(d).collect()}
    monkeypatch.setattr(overlap, "SHARD_TEXTS", 5)
    monkeypatch.setattr(overlap, "SHARD_EVALS", 7)
    assert whole and whole == {(r["eval_id"], r["train_id"]) for r in overlap.overlaps(d).collect()}


WORDS_ = "tenant broker surety carrier trustee bailee guest".split()


def planned(monkeypatch, module) -> list[str]:
    """The plans of the tables that a module cuts from here on, as they are before any of their stages has run."""
    plans, cut = [], module.cut

    def noted(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, *args)

    monkeypatch.setattr(module, "cut", noted)
    return plans


def test_matching_broadcasts_no_table_that_grows(spark, small, monkeypatch):
    """However small the tables' files are, only the patterns' posteriors go through the driver."""
    plans = planned(monkeypatch, matching)
    clusters, cases = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("clusters", "scdb_cases"))
    last = matching.match(clusters, cases)
    assert len(plans) == 3 and "SortMergeJoin" in plans[2] and not any("Broadcast" in p for p in plans)
    assert last._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 1


def test_overlaps_broadcast_no_table_that_grows(spark, small, monkeypatch):
    """However small the tables' files are, nothing but the shards' numbers of parts goes through the driver."""
    plans = planned(monkeypatch, overlap)
    last = overlap.overlaps(spark.read.parquet(f"{small}/pair_records.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert len(plans) == 8 and "SortMergeJoin" in plans[3] and not any("Broadcast" in p for p in plans)
    assert last.count("SortMergeJoin") >= 4 and last.count("BroadcastHashJoin") <= 2
