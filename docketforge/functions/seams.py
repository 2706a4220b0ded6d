"""Small interfaces to models and services; deterministic stand-ins make a dry run without either."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketforge.functions.text import blank, sanitised


class Generator(Protocol):
    """Turns a prompt into a reply. Objects are shipped to tasks, so they must pickle and open connections lazily."""

    name: str

    def reply(self, prompt: str) -> str: ...


@dataclass(frozen=True)
class QuotingGenerator:
    """A stand-in that asks about and quotes the first long sentence of what follows the last 'PASSAGE:'."""

    name: str = "quoting-stub"

    def reply(self, prompt: str) -> str:
        passage = prompt.rpartition("PASSAGE:")[2].strip()
        span = next((s for s in re.split(r"(?<=[.!?])\s+", passage) if len(s) >= 40), passage[:200])
        tag = hashlib.md5(span.encode()).hexdigest()[:6]
        pair = {"question": f"What does the opinion say at the place marked {tag}?", "answer": " ".join(reversed(span.split())), "question_type": "facts", "supporting_span": span}
        return "Reply:\n" + json.dumps({"qa_pairs": [pair]}, ensure_ascii=False)


@dataclass(frozen=True)
class RetryPolicy:
    """What a caller does about a failure: fail at once, or wait and try again."""

    tries: int = 5
    base: float = 2.0
    most: float = 120.0

    def wait(self, attempt: int, status: int | None, retry_after: float | None = None) -> float | None:
        """Seconds until the next try, or None to give up. 400, 401, 403 and 404 never get better; a server's own wait is honoured."""
        if attempt + 1 >= self.tries or status in (400, 401, 403, 404):
            return None
        if retry_after is not None:
            return min(retry_after, self.most)
        return min(self.base * 2**attempt, self.most)


REPLY = "qa_pairs array<struct<question string, answer string, question_type string, supporting_span string>>"


def prompt(text: Column, index: Column, n: Column, position: Column) -> Column:
    return F.format_string("Part %d of %d (%s). Write question and answer pairs on the passage.\nPASSAGE: %s", index + 1, n, position, text)


# The question types that suit each part of a document.
SUITABLE = {"early": ("facts", "procedural", "holding"), "middle": ("legal_principle", "holding", "facts"), "late": ("holding", "outcome", "legal_principle")}
HINTS = {
    "early": "The passage opens the opinion: expect the dispute, how the case came up, and often what was held.",
    "middle": "The passage is from the opinion's body: expect reasoning, readings of the law, and conclusions on single points.",
    "late": "The passage closes the opinion: expect the holding, the disposition, and what the lower court has to do.",
}
RULES = (
    "Ask only what the passage answers. Back every answer by a quotation copied from the passage to the letter. "
    "Say the answer in other words than the quotation. Ask for reasons before facts; never for yes or no, for dates, names or authors. "
    "Return an object with the list qa_pairs, each with question, answer, question_type and supporting_span; an empty list if the passage has no substance."
)


def _by_position(position: Column, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), position)


def preferred_types(position: Column) -> Column:
    return _by_position(position, {k: ", ".join(v) for k, v in SUITABLE.items()})


def pair_prompt(windows: DataFrame, pairs: int = 3) -> Column:
    """The prompt for each window's pairs: what is asked for, the case, the part, hint and types of its position, and the passage without characters that JSON can't carry."""
    w = windows
    head = F.format_string("Write %d question and answer pairs on the passage.\nCASE: %s\nDECIDED: %s\nCITATION: %s\nPART: %d of %d\n", F.lit(pairs), F.coalesce(sanitised(w["case_name"]), F.lit("Unknown")), F.coalesce(w["date_filed"], F.lit("Unknown")), F.coalesce(F.nullif(w["citation"], F.lit("")), F.lit("not available")), w["chunk_index"] + 1, w["n_chunks"])
    return F.concat(head, _by_position(w["position"], HINTS), F.lit("\nTYPES: "), preferred_types(w["position"]), F.lit("\n" + RULES + "\nPASSAGE: "), sanitised(w["text"]))


#: Answered examples that go before a question without its passage.
EXAMPLES = (
    ("By what measure did the Court judge whether the search was lawful?", "It weighed the intrusion against the public need in all the circumstances and asked for no warrant as a fixed rule."),
    ("Why was the petitioner's reading of the statute turned down?", "Its words and structure reach the conduct, and the narrower reading would leave a clause beside it without work."),
    ("How was the case disposed of?", "The judgment below was reversed, and the open questions went back to the lower court."),
)


def baseline_prompts(pairs: DataFrame, opinions: DataFrame, around: int = 900) -> DataFrame:
    """(pair_id, system, prompt) for the systems open_book, closed_book and few_shot of every pair.

    Only open_book has the passage around the pair's span; the others never see it, and few_shot has EXAMPLES before the
    question. Name and date are the pair's, else the opinion's. A pair without opinion has an empty passage.
    """
    from docketforge.operators.corpus import passage

    known = opinions.select("cluster_id", F.col("case_name").alias("o_name"), F.col("date_filed").alias("o_date"), F.col("text").alias("o_text"))
    both = pairs.select("pair_id", "cluster_id", "case_name", "date_filed", "question", "span_start", "span_end").join(known, "cluster_id", "left")
    first = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b), F.lit(""))
    case = F.concat(F.lit("CASE: "), first("case_name", "o_name"), F.lit(" ("), first("date_filed", "o_date"), F.lit(")\n"))
    asked = F.concat(F.lit("QUESTION: "), blank(F.col("question")), F.lit("\n"))
    task = F.lit("Answer in 20 to 100 words. Say so if you don't know.")
    shown = F.concat(F.lit("PASSAGE: "), blank(passage(F.col("span_start"), F.col("span_end"), F.col("o_text"), around)), F.lit("\n"))
    shots = F.lit("".join(f"QUESTION: {q}\nANSWER: {a}\n" for q, a in EXAMPLES))
    each = {"open_book": F.concat(case, shown, asked, F.lit("Answer from the passage only. "), task), "closed_book": F.concat(case, asked, task), "few_shot": F.concat(shots, case, asked, task)}
    return both.select("pair_id", F.explode(F.array(*[F.struct(F.lit(n).alias("system"), p.alias("prompt")) for n, p in each.items()])).alias("x")).select("pair_id", "x.*")


class GaveUp(RuntimeError):
    """A call that failed for good; ``status`` is the service's last answer."""

    def __init__(self, status: int | None, tries: int):
        super().__init__(f"gave up after {tries} tries, last status {status}")
        self.status = status


def call(send: Callable[[str], tuple[int, str, float | None]], text: str, policy: RetryPolicy = RetryPolicy(), sleep: Callable[[float], None] = time.sleep) -> str:
    """The body that ``send`` returns for text. send: (status, body, the server's own wait); a raised OSError counts as no status."""
    attempt = 0
    while True:
        try:
            status, body, wait = send(text)
        except OSError:
            status, body, wait = None, "", None
        if status is not None and status < 400:
            return body
        pause = policy.wait(attempt, status, wait)
        if pause is None:
            raise GaveUp(status, attempt + 1)
        sleep(pause)
        attempt += 1


def in_batches(items: list, run: Callable[[list], list], size: int = 16) -> list:
    """run() over the items in batches; a batch that raises MemoryError is tried again in halves, down to single items."""
    out: list = []
    todo = [items[i : i + size] for i in range(0, len(items), size)][::-1]
    while todo:
        batch = todo.pop()
        try:
            out += run(batch)
        except MemoryError:
            if len(batch) < 2:
                raise
            half = len(batch) // 2
            todo += [batch[half:], batch[:half]]
    return out


@dataclass(frozen=True)
class LengthJudge:
    """A stand-in for a judge: its verdict goes by the answer's length, from 1 to 5."""

    name: str = "length-stub"

    def reply(self, prompt: str) -> str:
        words = len(prompt.rpartition("ANSWER:")[2].split())
        return "Verdict: " + json.dumps({"faithful": min(5, max(1, words // 10)), "useful": 4})


VERDICT = "faithful double, useful double"


def judged(pairs: DataFrame, judge: Generator) -> DataFrame:
    """(pair_id, faithful, useful): a judge's verdict on each pair; a reply without an object, or a field that isn't a number, gives nulls."""
    asked = pairs.select("pair_id", F.concat(F.lit("QUESTION: "), blank(F.col("question")), F.lit("\nQUOTATION: "), blank(F.col("supporting_span")), F.lit("\nANSWER: "), blank(F.col("answer"))).alias("prompt"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"pair_id": pdf["pair_id"], "reply": [judge.reply(p) for p in pdf["prompt"]]})

    return asked.mapInPandas(run, "pair_id long, reply string").select("pair_id", F.from_json(json_object(F.col("reply")), VERDICT).alias("v")).select("pair_id", "v.faithful", "v.useful")


def json_object(reply: Column) -> Column:
    """What stands between a reply's first opening brace and its last closing one; '' if there is no such part."""
    return F.regexp_extract(blank(reply), r"(?s)\{.*\}", 0)


def parsed(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """replies with ``pairs``, the pairs of each reply's object, and ``state``: 'ok', 'no_pairs' (an object without the list) or 'broken' (no object, or one that can't be read)."""
    schema = REPLY + ", _broken string"
    out = replies.withColumn("__j", F.from_json(json_object(F.col(reply)), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    broken = (json_object(F.col(reply)) == "") | F.col("__j").isNull() | F.col("__j._broken").isNotNull()
    state = F.when(broken, "broken").when(F.col("__j.qa_pairs").isNull(), "no_pairs").otherwise("ok")
    return out.withColumn("state", state).withColumn("pairs", F.when(F.col("state") == "ok", F.col("__j.qa_pairs"))).drop("__j")


def generate(windows: DataFrame, generator: Generator, most_chars: int = 60_000) -> DataFrame:
    """(cluster_id, chunk_index, generator, question, answer, question_type, supporting_span) for each window's reply.

    Windows whose prompt is too long are left out; a reply without an object gives no rows.
    """
    asked = windows.withColumn("prompt", prompt(F.col("text"), F.col("chunk_index"), F.col("n_chunks"), F.col("position"))).where(F.length("prompt") <= most_chars)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"cluster_id": pdf["cluster_id"], "chunk_index": pdf["chunk_index"], "reply": [generator.reply(p) for p in pdf["prompt"]]})

    replies = asked.select("cluster_id", "chunk_index", "prompt").mapInPandas(run, "cluster_id long, chunk_index int, reply string")
    return parsed(replies).select("cluster_id", "chunk_index", F.lit(generator.name).alias("generator"), F.explode("pairs").alias("p")).select("cluster_id", "chunk_index", "generator", "p.*")
