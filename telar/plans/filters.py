"""Filters of fixed size for a set of hashes of any size: made where the hashes are, sent to every task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.plans.shared import Shared

LEAST_BITS, MOST_BITS, BITS_EACH = 1 << 18, 1 << 28, 32  # beyond MOST_BITS a filter only lets more pass


def bit_filter(df: DataFrame, column: str) -> np.ndarray:
    """One bit for each hash (bigint) in a column of a written table, as bytes whose number is a power of two.

    The bit of a hash stands at its remainder by the number of bits.  It is made in parts of 4 KB by partial aggregates; no hash goes to the
    driver, only those parts: ``MOST_BITS`` bits at most.
    """
    size = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, df.count() * BITS_EACH - 1).bit_length()))
    at = df.select(F.col(column).bitwiseAND(F.lit(size - 1)).alias("at"))
    parts = at.groupBy(F.floor(F.col("at") / 32768).alias("part")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for r in parts.toLocalIterator():  # at most size / 32,768 rows
        out[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def hits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of some hashes (int64) a filter may have."""
    at = hashes.view(np.uint64) & np.uint64(len(bits) * 8 - 1)
    return ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def keep(df: DataFrame, column: str, of: DataFrame, of_column: str | None = None) -> DataFrame:
    """The rows of ``df`` whose hash in ``column`` may be among those of a written table: all that are, and a few more, without a shuffle."""
    shared = Shared(df.sparkSession, bit_filter(of, of_column or column))
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            mask = hits(bits, batch.column(at).to_numpy(zero_copy_only=False))
            if mask.any():
                yield batch.filter(pa.array(mask))

    return df.mapInArrow(run, df.schema)
