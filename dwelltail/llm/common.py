"""Helpers of the corpus operators: bounded text blocks, byte tables, free column names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once.
BLOCK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_blocks(batches, text: str = "text", limit: int = BLOCK_BYTES, per_row: int = 16):
    """Slices of Arrow batches whose texts add up to about ``limit`` bytes; a longer text comes alone.

    ``per_row`` is what a row counts besides its text, for work that also grows with the rows.
    """
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64) + per_row)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes in one array, and the n + 1 offsets; NULL counts as empty."""
    texts = [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def sums_between(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring offsets."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def byte_table(characters: str) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[np.frombuffer(characters.encode("ascii"), np.uint8)] = True
    return flags


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def without(df: DataFrame, names) -> list[str]:
    """Columns of ``df`` that the names about to be added do not replace."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]
