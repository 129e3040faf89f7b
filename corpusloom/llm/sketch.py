"""Count-min sketches of one row, built part by part and merged."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNKS = 64


def chunk_rows(counts: np.ndarray) -> tuple[list[int], list[bytes]]:
    """The filled chunks of a part's counters."""
    chunks = counts.reshape(CHUNKS, -1)
    full = [i for i in range(CHUNKS) if chunks[i].any()]
    return full, [np.ascontiguousarray(chunks[i]).tobytes() for i in full]


def merged(rows: DataFrame, width: int) -> np.ndarray:
    """Sum of the chunks (chunk int, counts binary of uint32) of all parts: width counters, whatever the input."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width // CHUNKS, np.uint32)
        for x in table.column("counts"):
            part = np.frombuffer(x.as_buffer(), np.uint32)
            total = np.where(total > np.uint32(0xFFFFFFFF) - part, np.uint32(0xFFFFFFFF), total + part)
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "chunk int, counts binary"
    # two levels, so that no task adds the chunks of very many parts
    first = rows.withColumn("at", F.pmod(F.xxhash64("counts"), F.lit(16))).groupBy("chunk", "at").applyInArrow(add, schema)
    out = np.zeros(width, np.uint32)
    for r in first.groupBy("chunk").applyInArrow(add, schema).collect():  # CHUNKS rows
        n = width // CHUNKS
        out[r["chunk"] * n : (r["chunk"] + 1) * n] = np.frombuffer(r["counts"], np.uint32)
    return out
