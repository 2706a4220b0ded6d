"""Settings as frozen values, read from a TOML or JSON file, and what is wrong with them."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """What a run depends on. Defaults are the fixed values that the results are compared by."""

    model: str = ""
    temperature: float = 0.2
    chunk_words: int = 900
    chunk_overlap: int = 150
    pairs_per_chunk: int = 3
    least_question_words: int = 8
    most_question_words: int = 45
    least_answer_words: int = 15
    most_answer_words: int = 90
    least_span_chars: int = 40
    most_copied_words: int | None = 10
    most_prompt_chars: int = 60_000
    abort_after_empty: int | None = 25
    least_words: int = 500
    most_words: int = 80_000

    @classmethod
    def read(cls, path: str) -> Settings:
        """From a file; a section named 'settings' counts as the whole, unknown keys are dropped, missing ones keep their default."""
        with open(path, "rb") as f:
            given = tomllib.load(f) if path.endswith(".toml") else json.load(f)
        given = given.get("settings", given)
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in given.items() if k in known})

    def problems(self) -> list[str]:
        """What keeps a run from being started; empty if nothing does."""
        checks = {
            "model is missing": not self.model,
            "temperature lies outside 0 to 1": not 0 <= self.temperature <= 1,
            "chunk_overlap isn't below chunk_words: windows would not advance": self.chunk_overlap >= self.chunk_words,
            "least_answer_words isn't below most_answer_words: every pair would be rejected": self.least_answer_words >= self.most_answer_words,
            "least_question_words isn't below most_question_words: every pair would be rejected": self.least_question_words >= self.most_question_words,
            "least_words isn't below most_words: every document would be rejected": self.least_words >= self.most_words,
        }
        return [problem for problem, is_so in checks.items() if is_so]

    def warnings(self) -> list[str]:
        """Guards that are switched off."""
        return [f"{name} isn't set" for name in ("most_copied_words", "abort_after_empty") if getattr(self, name) is None]
