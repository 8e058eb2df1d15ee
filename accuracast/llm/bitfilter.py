"""A bit table of fixed size that tells which 64-bit hashes can be left out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a table: 2^26, hence 8 MB, however many hashes are filed.
BITS = 26


def bit_filter(hashes: DataFrame, bits: int = BITS) -> Broadcast:
    """Broadcast table of the column ``hash`` (bigint): bit number ``hash >>> (64 - bits)`` of each is set.

    Executors fold the hashes into 2^(bits - 6) words; these, never the hashes, reach the driver. A full
    table only stops sparing work: callers must be right whatever else it lets through.
    """
    word, bit = F.shiftrightunsigned("hash", 64 - bits + 6), F.shiftrightunsigned("hash", 64 - bits).bitwiseAND(F.lit(63)).cast("int")
    ones = hashes.select(word.cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("b"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    for row in ones.groupBy("w").agg(F.bit_or("b").alias("b")).mapInArrow(_packed, "w binary, b binary").toLocalIterator():
        out[np.frombuffer(row.w, np.int32)] = np.frombuffer(row.b, np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(out)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A cell of words and one of their bits per batch, so that the driver gets bytes and no rows."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.column(c).to_numpy().tobytes()], pa.binary()) for c in ("w", "b")], ["w", "b"])


def filed(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False for hashes that were surely not filed."""
    bits = np.uint64(len(table).bit_length() - 1 + 6)
    word = (hashes >> (np.uint64(64 + 6) - bits)).astype(np.int64)
    bit = (hashes >> (np.uint64(64) - bits)) & np.uint64(63)
    return (table[word] >> bit) & np.uint64(1) == np.uint64(1)


def may_be_filed(table: Broadcast, value: Column) -> Column:
    """Whether the hash of ``value`` may be among the ``xxhash64(value)`` of ``table``; only hashes go to Python."""

    @F.pandas_udf("boolean")
    def run(hashes: pd.Series) -> pd.Series:
        return pd.Series(filed(table.value, hashes.to_numpy().view(np.uint64)))

    return run(F.xxhash64(value))
