"""Text sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from functools import lru_cache
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies; every operator takes another as a parameter.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(folder: str = TOKENIZERS, name: str = VOCABULARY):
    """The byte-level tokenizer of a .tiktoken file, without special tokens."""
    import tiktoken

    with open(os.path.join(folder, name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str, keys: list[str], folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """keys and ``tokens`` (int), the size of each row's text; a null or empty text has 0. Other columns are left out."""
    chosen = df.select(*[F.col(k) for k in keys], F.col(text).alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, name).encode_ordinary
        for batch in batches:
            sizes = [len(encode(x)) if x else 0 for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int32())], names=[*keys, "tokens"])

    return chosen.mapInArrow(run, fields + "tokens int")
