"""k-mers of sequences: one row for each position without a masked base.

Sequences become digits once and codes by doubling (codes of 2, 4, 8 and 16 bases
from their halves), in Arrow batches of bounded size: time grows with the length
of a sequence, however long it is, and no k-mer is ever a string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..plans.shipping import ship
from .params import SEED

#: Bases that are coded at once, and the most rows of a batch that is given out.
SLICE = 1 << 16
_MASKED = 4
_DIGIT = np.full(256, _MASKED, np.uint8)
_DIGIT[list(b"ACGT")] = range(4)


def codes(digits: np.ndarray, k: int) -> np.ndarray:
    """The code of each k consecutive digits (0 to 3), lowest first; k up to 31."""
    n = len(digits) - k + 1
    power, width = digits.astype(np.int64), 1
    out, done = np.zeros(max(n, 0), np.int64), 0
    while n > 0:
        if k & width:
            out |= power[done : done + n] << (2 * done)
            done += width
        if done == k:
            break
        power = power[:-width] | (power[width:] << (2 * width))
        width *= 2
    return out


def reverse_complements(code: np.ndarray, k: int) -> np.ndarray:
    """The codes of the reverse complements: pairs of bits change places in ever
    larger groups, then all are inverted."""
    out = code.astype(np.uint64)
    for width, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        shift, some = np.uint64(width), np.uint64(mask)
        out = ((out >> shift) & some) | ((out & some) << shift)
    return (~out >> np.uint64(64 - 2 * k)).view(np.int64)


def _cut(digits: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sequence, position, code) of the unmasked k-mers of sequences that lie end
    to end, some SLICE of them at a time."""
    for low in range(0, len(digits) - k + 1, SLICE):
        part = digits[low : low + SLICE + k - 1]
        masked = np.concatenate([[0], np.cumsum(part == _MASKED)])
        at = np.flatnonzero(masked[k:] == masked[:-k])
        seq = np.searchsorted(offsets, at + low, "right") - 1
        inside = at + low + k <= offsets[seq + 1]
        at, seq = at[inside], seq[inside]
        yield seq, at + low - offsets[seq], codes(part & 3, k)[at]


def kmers(df: DataFrame, seq: str = "seq", k: int = SEED, position: str = "pos", reverse: bool = False) -> DataFrame:
    """The other columns of ``df`` with ``position`` (from 0) and ``kmer``, the code;
    on demand also ``reverse``, the code of its reverse complement.

    A sequence shorter than k, or null, has no row; any letter but A, C, G and T
    is masked.
    """
    ship(df.sparkSession)
    others = [c for c in df.columns if c != seq]
    given = df.select(*others, seq)
    schema = StructType([*given.schema.fields[:-1], StructField(position, IntegerType()), StructField("kmer", LongType()), *([StructField("reverse", LongType())] if reverse else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(others)).cast(pa.large_binary()).fill_null(b"")
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = texts.buffers()[2]
            raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
            for row, at, code in _cut(_DIGIT[raw], offsets - offsets[0], k):
                if len(row):
                    rest = batch.select(range(len(others))).take(pa.array(row)).columns if others else []
                    both = [code, reverse_complements(code, k)] if reverse else [code]
                    yield pa.RecordBatch.from_arrays([*rest, pa.array(at.astype(np.int32)), *map(pa.array, both)], names=schema.names)

    return given.mapInArrow(run, schema)


def reference_seeds(refs: DataFrame, k: int = SEED) -> DataFrame:
    """(ref_ord, refpos, strand, kmer): reads stay forward; a reference k-mer is
    listed as it is (strand 0) and as its reverse complement (1).  k is odd, so no
    k-mer is its own reverse complement."""
    forward = kmers(refs.select("ref_ord", "seq"), "seq", k, "refpos", reverse=True)
    strands = F.array(F.struct(F.lit(0).alias("strand"), F.col("kmer")), F.struct(F.lit(1).alias("strand"), F.col("reverse").alias("kmer")))
    return forward.select("ref_ord", "refpos", F.inline(strands))


def prefix_offsets(refs: DataFrame) -> DataFrame:
    """(ref_ord, len, abs_offset): where each reference would start if all were laid
    end to end.  Sums by blocks of ordinals first, so no task orders all rows."""
    from pyspark.sql import Window

    sized = refs.select("ref_ord", F.length("seq").alias("len"), F.floor(F.col("ref_ord") / 4096).alias("_block"))
    blocks = sized.groupBy("_block").agg(F.sum("len").alias("_sum"))
    before = blocks.select("_block", (F.sum("_sum").over(Window.orderBy("_block")) - F.col("_sum")).alias("_before"))
    inner = F.sum("len").over(Window.partitionBy("_block").orderBy("ref_ord")) - F.col("len")
    return sized.withColumn("_inner", inner).join(before, "_block").select("ref_ord", "len", (F.col("_before") + F.col("_inner")).alias("abs_offset"))
