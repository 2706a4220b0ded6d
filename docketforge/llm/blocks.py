"""Sums of count blocks of a fixed size that tasks send, added up in rounds."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks that a task adds up at most.
FAN = 16
BLOCKS = "part int, block int, cells binary"


def block_rows(part: int, table: np.ndarray, wide: bool = False) -> pa.RecordBatch:
    """One row for each row of the table."""
    n = len(table)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array([row.astype(np.int64).tobytes() for row in table], pa.binary())], names=["part", "block", "cells"])


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(pdf["cells"].iloc[0]) // 8, np.int64)
    for x in pdf["cells"]:
        total += np.frombuffer(x, np.int64)
    return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "block": [int(pdf["block"].iloc[0])], "cells": [total.tobytes()]})


def tree_sum(blocks: DataFrame, parts: int, n: int, size: int) -> np.ndarray:
    """The (n, size) sum of the blocks (part, block, cells) of ``parts`` tasks. A task adds up at most FAN blocks of a round; the driver gets n blocks."""
    while parts > 1:
        blocks = blocks.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("part", "block").applyInPandas(_add, BLOCKS)
        parts = -(-parts // FAN)
    out = np.zeros((n, size), np.int64)
    for r in blocks.select("block", "cells").toLocalIterator():
        out[r["block"]] += np.frombuffer(r["cells"], np.int64)
    return out
