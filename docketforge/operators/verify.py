"""Verification that a quotation occurs in its source, by methods of growing tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketforge.functions import text as T
from docketforge.functions.udfs import located, longest_run, recorded, stepped
from docketforge.session import spread

METHODS = ("exact", "normalised", "word", "artefact")
#: Pairs of an opinion that stand together beside its text, more or less.
CHUNK = 256
ELLIPSIS = r"\.[ ]*\.[ ]*\.|…"


def prepared(opinions: DataFrame, even: bool = True) -> DataFrame:
    """(cluster_id, text and its forms): what the methods search in, made once for each opinion and not for each quotation.

    A query that needs one form only has one only: the others are pruned. ``even`` spreads a table of few parts over the
    cores first.
    """
    rows = opinions.select("cluster_id", "text")
    return (spread(rows) if even else rows).select("cluster_id", *_forms(), T.ascii_stream(F.col("text")).alias("source_stream"))


def _forms() -> list[Column]:
    return [F.col("text").alias("source"), T.normalised(F.col("text")).alias("source_normalised"), _padded(F.col("text")).alias("source_words")]


def with_source(pairs: DataFrame, opinions: DataFrame) -> DataFrame:
    """Each pair beside its opinion; a pair without opinion keeps nulls. AQE splits an opinion that many pairs quote."""
    return pairs.join(prepared(opinions), "cluster_id", "left")


def chunked(pairs: DataFrame, opinions: DataFrame, how: str = "inner") -> DataFrame:
    """(cluster_id, chunk, items) and the columns of opinions: about CHUNK pairs of an opinion at a time, as structs of the other columns.

    An opinion that many pairs quote stands beside a list of them and not beside each, and its lists are spread over the
    tasks. pairs needs a pair_id; repeated rows stay.
    """
    rows = spread(pairs)
    many = pairs.groupBy(F.col("cluster_id").alias("hot")).agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    rows = rows.join(many, rows["cluster_id"].eqNullSafe(many["hot"]), "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("pair_id"), F.ceil(F.col("n") / CHUNK)), F.lit(0)))
    lists = rows.groupBy("cluster_id", "chunk").agg(F.collect_list(F.struct(*[c for c in pairs.columns if c != "cluster_id"])).alias("items"))
    return lists.join(opinions, "cluster_id", how).repartition("cluster_id", "chunk")


def _steps(span: str, tolerant: bool) -> Column:
    """The list of found_step() of the items' field ``span``, beside the forms that prepared() makes."""
    of = lambda f: F.transform("items", lambda x: f(x[span]))
    parts = lambda x: F.when(x.rlike(ELLIPSIS), F.array_join(F.filter(F.transform(T.elided_parts(x), lambda p: F.array_join(T.words(p), " ")), lambda p: p != ""), "|"))
    return stepped(tolerant)("source", "source_normalised", "source_words", of(lambda x: x), of(T.normalised), of(_padded), of(parts))


def _padded(x: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(T.words(x), " "), F.lit(" "))


def exact_hit(span: Column, source: Column) -> Column:
    return F.coalesce((T.blank(span) != "") & F.contains(source, span), F.lit(False))


def normalised_hit(span: Column, source: Column) -> Column:
    form = T.normalised(span)
    return F.coalesce((form != "") & F.contains(source, form), F.lit(False))


def word_hit(span: Column, source: Column) -> Column:
    """Whether the span's words stand in the source in a row, or its parts around ellipses one behind the other."""
    row = _padded(span)
    whole = (row != "  ") & F.contains(source, row)
    parts = F.filter(F.transform(T.elided_parts(span), lambda p: F.array_join(T.words(p), " ")), lambda p: p != "")
    # The place behind the last part found, or 0 once a part is missing; consecutive parts may share a blank.
    place = lambda at, p: F.call_function("locate", F.concat(F.lit(" "), p, F.lit(" ")), source, at)
    step = lambda at, p: F.when(at <= 0, F.lit(0)).otherwise(F.when(place(at, p) > 0, place(at, p) + F.length(p) + 1).otherwise(0))
    # Only a span with an ellipsis has parts that could stand apart.
    chained = F.when(span.rlike(ELLIPSIS), (F.size(parts) > 1) & (F.aggregate(parts, F.lit(1), step) > 0)).otherwise(False)
    return F.coalesce(whole | chained, F.lit(False))


def _tolerant(rows: DataFrame, easy: Column) -> Column:
    """The tolerant matcher's verdict on the spans that nothing else found; only those leave the JVM."""
    return located(F.when(easy, None).otherwise(F.col("span")), F.when(easy, None).otherwise(F.col("source")))["start"].isNotNull()


def hits(pairs: DataFrame, opinions: DataFrame, artefact: bool = False) -> DataFrame:
    """pair_id and a boolean for each method on its own; ``artefact`` adds the tolerant matcher, which leaves the JVM.

    A null or empty span and a missing opinion are hits of no method. Only spans that the other methods missed reach
    the tolerant matcher.
    """
    both = with_source(pairs.select("pair_id", "cluster_id", F.col("supporting_span").alias("span")), opinions)
    rows = both.select(
        "pair_id", "span", "source", exact_hit(F.col("span"), F.col("source")).alias("exact"), normalised_hit(F.col("span"), F.col("source_normalised")).alias("normalised"),
        word_hit(F.col("span"), F.col("source_words")).alias("word"),
    )
    if not artefact:
        return rows.drop("span", "source")
    easy = F.col("exact") | F.col("normalised") | F.col("word")
    hard = rows.withColumn("at", _tolerant(rows, easy))
    return hard.select("pair_id", "exact", "normalised", "word", (easy | F.col("at")).alias("artefact"))


def first_method(pairs: DataFrame, opinions: DataFrame, artefact: bool = False) -> DataFrame:
    """(pair_id, step): the number of the first of METHODS that finds a pair's span, or the number of methods for none.

    The methods run in the order of their cost, each on what those before it missed.
    """
    spans = pairs.select("pair_id", "cluster_id", F.col("supporting_span").alias("span"))
    if artefact:
        lists = chunked(spans, opinions.select("cluster_id", "text"), "left")
        found = lists.select("items", *_forms()).select("items", _steps("span", True).alias("steps"))
        return found.select(F.explode(F.arrays_zip("items", "steps")).alias("x")).select("x.items.pair_id", F.col("x.steps").alias("step"))
    step = F.when(exact_hit(F.col("span"), F.col("source")), 0).when(normalised_hit(F.col("span"), F.col("source_normalised")), 1).when(word_hit(F.col("span"), F.col("source_words")), 2).otherwise(3)
    return with_source(spans, opinions).select("pair_id", step.alias("step"))


def step_rates(steps: DataFrame, methods: tuple[str, ...] = METHODS[:3]) -> DataFrame:
    """(method, candidates, failures, failure_pct) of each method together with those before it, from first_method()."""
    one = steps.agg(F.count("*").alias("candidates"), *[F.count_if(F.col("step") > i).alias(m) for i, m in enumerate(methods)])
    tall = one.select("candidates", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("failures")) for m in methods])).alias("x"))
    return tall.select("x.method", "candidates", "x.failures", F.round(100 * F.col("x.failures") / F.col("candidates"), 4).alias("failure_pct"))


def offsets(pairs: DataFrame, opinions: DataFrame) -> DataFrame:
    """(pair_id, found_start, found_end, offset_holds): where the span first stands in its opinion, from 0 and with the end excluded, and whether the recorded offsets cut exactly it."""
    both = pairs.select("pair_id", "cluster_id", "supporting_span", "span_start", "span_end").join(opinions.select("cluster_id", "text"), "cluster_id")
    at = F.when(F.col("supporting_span") != "", F.instr("text", F.col("supporting_span")))
    cut_ = F.substring("text", F.col("span_start").cast("int") + 1, (F.col("span_end") - F.col("span_start")).cast("int"))
    ok = (F.col("span_start") >= 0) & (F.col("span_end") > F.col("span_start")) & (cut_ == F.col("supporting_span"))
    return both.select("pair_id", F.when(at > 0, at - 1).cast("long").alias("found_start"), F.when(at > 0, at - 1 + F.length("supporting_span")).cast("long").alias("found_end"), F.coalesce(ok, F.lit(False)).alias("offset_holds"))


def grounding(pairs: DataFrame, opinions: DataFrame) -> DataFrame:
    """(pair_id, status): 'exact' if the offsets cut the span, 'located' if what they cut and the span contain one another as streams, 'found' if the span's first 200 stream characters occur in the opinion, 'missing', or 'no opinion'."""
    both = with_source(pairs.select("pair_id", "cluster_id", "supporting_span", "span_start", "span_end"), opinions)
    valid = (F.col("span_start") >= 0) & (F.col("span_end") > F.col("span_start"))
    piece = F.when(valid, F.substring("source", F.col("span_start").cast("int") + 1, (F.col("span_end") - F.col("span_start")).cast("int")))
    # The streams are made once, and only where the offsets don't cut the span itself.
    loose = ~F.coalesce(piece == F.col("supporting_span"), F.lit(False))
    both = both.select("pair_id", "source", "source_stream", loose.alias("loose"), F.when(loose, T.ascii_stream(piece)).alias("a"), F.when(loose, T.ascii_stream(F.col("supporting_span"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    either = (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))
    status = (
        F.when(F.col("source").isNull(), "no opinion").when(~F.col("loose"), "exact").when(either, "located")
        .when((b != "") & F.contains(F.col("source_stream"), F.substring(b, 1, 200)), "found").otherwise("missing")
    )
    return both.select("pair_id", status.alias("status"))


def longest_shared_run(pairs: DataFrame, a: str = "answer", b: str = "supporting_span", key: str = "pair_id") -> DataFrame:
    """(key, longest_run): the longest run of words that both texts of a row have in the same order without gaps; 0 if none.

    A row is looked at by itself, so nothing is shuffled. Repeated rows come out repeated.
    """
    rows = spread(pairs.select(F.col(key), F.col(a).alias("a"), F.col(b).alias("b")))
    return rows.select(key, longest_run(T.blank(F.col("a")), T.blank(F.col("b"))).alias("longest_run"))


def counterfactual(span: Column) -> Column:
    """A quotation with its sense changed: its first 'not' left out, else its first 'no', else 'never' put into its middle."""
    words = F.split(T.squeeze(T.blank(span)), " ")
    middle = F.greatest(F.lit(1), F.floor(F.size(words) / 2).cast("int"))
    inserted = F.array_join(F.array_insert(words, middle + 1, F.lit("never")), " ")
    once = lambda w: F.concat(F.substring_index(span, w, 1), F.lit(" "), F.substring(span, F.instr(span, F.lit(w)) + len(w), F.length(span)))
    return F.when(F.contains(span, F.lit(" not ")), once(" not ")).when(F.contains(span, F.lit(" no ")), once(" no ")).otherwise(inserted)


# Fixed value: a sentence that no opinion holds.
FABRICATED = "The Court further held that the statute was enacted in response to widespread public concern about the practice."


def provenance(pairs: DataFrame, opinions: DataFrame, around: int = 450) -> DataFrame:
    """One row for each pair with an opinion: the chain from the pair back to its source and the guard's answer to changed quotations.

    (pair_id, cluster_id, case_name, citation, text_chars, text_words, depth_pct, window_start, window_end, slice,
    slice_is_span, found_step, offsets_hold, altered_found, fabricated_found). The window reaches ``around`` characters
    to both sides of the recorded offsets and is null without them; found_step is that of first_method() by the span as
    it is; altered_found and fabricated_found say whether a verbatim, normalised or word match takes counterfactual() or
    FABRICATED for a quotation.
    """
    span = F.col("supporting_span")
    p = pairs.select("pair_id", "cluster_id", span.alias("span"), "span_start", F.coalesce("span_end", "span_start").alias("span_end"), F.when(T.blank(span) != "", counterfactual(span)).alias("altered"))
    about = opinions.where("text IS NOT NULL").select("cluster_id", "case_name", "citation", "text", F.length("text").alias("text_chars"), T.word_count(F.col("text")).alias("text_words"))
    lists = chunked(p, about).select("cluster_id", "case_name", "citation", "text_chars", "text_words", "items", *_forms())
    of = lambda c: F.transform("items", lambda x: x[c])
    offset = lambda c: F.transform("items", lambda x: F.coalesce(x[c].cast("long"), F.lit(-1)))
    hit = lambda s: exact_hit(s, F.col("source")) | normalised_hit(s, F.col("source_normalised")) | word_hit(s, F.col("source_words"))
    traced = lists.select(
        "cluster_id", "case_name", "citation", "text_chars", "text_words", "items", hit(F.lit(FABRICATED)).alias("fabricated_found"),
        recorded("source", of("span"), offset("span_start"), offset("span_end")).alias("r"), _steps("span", False).alias("steps"), _steps("altered", False).alias("altered"),
    )
    rows = traced.withColumn("x", F.explode(F.arrays_zip("items", "r", "steps", "altered")))
    n, start, end, piece = F.col("text_chars"), F.col("x.items.span_start"), F.col("x.items.span_end"), F.col("x.r.slice")
    return rows.select(
        "x.items.pair_id", "cluster_id", "case_name", "citation", "text_chars", "text_words", F.round(100 * start / F.greatest(n, F.lit(1)), 4).alias("depth_pct"),
        F.when(start.isNotNull(), F.greatest(F.lit(0), start - around)).alias("window_start"), F.when(start.isNotNull(), F.least(n.cast("long"), end + around)).alias("window_end"),
        piece, F.coalesce(piece == F.col("x.items.span"), F.lit(False)).alias("slice_is_span"), F.col("x.steps").alias("found_step"),
        F.col("x.r.holds").alias("offsets_hold"), (F.col("x.altered") < 3).alias("altered_found"), "fabricated_found",
    )


def marked(pairs: DataFrame, opinions: DataFrame, before: str = ">>> ", behind: str = " <<<") -> DataFrame:
    """(pair_id, marked): each pair's opinion with the recorded span between two marks; pairs without an opinion or valid offsets are left out."""
    both = pairs.select("pair_id", "cluster_id", "span_start", "span_end").join(opinions.select("cluster_id", "text"), "cluster_id")
    both = both.where((F.col("span_start") >= 0) & (F.col("span_start") < F.col("span_end")) & (F.col("span_end") <= F.length("text")))
    cut_ = lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))
    start, end = F.col("span_start"), F.col("span_end")
    return both.select("pair_id", F.concat(cut_(F.lit(0), start), F.lit(before), cut_(start, end), F.lit(behind), cut_(end, F.length("text"))).alias("marked"))
