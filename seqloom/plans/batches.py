"""Hit estimates and the plan of memory-bounded batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from ..operators.kmers import kmers
from ..operators.params import SEED
from ..operators.refdb import frequency_cutoff, frequency_histogram, frequency_table, seed_counts
from .shipping import ship

#: Bytes of memory for a hit, and for a base of a read.
HIT_BYTES, BASE_BYTES = 12, 24


def hit_upper_bound(mates: DataFrame, table: DataFrame, cutoff: DataFrame) -> DataFrame:
    """(read_ord, hits): over all k-mers of both strands, 2**bin of the frequency
    table, or 2**cutoff for those it lacks (a left join with a default)."""
    forward = kmers(mates.select("read_ord", "seq"), "seq", SEED, "pos", reverse=True)
    both = forward.select("read_ord", F.explode(F.array("kmer", "reverse")).alias("kmer"))
    bounded = both.join(table, "kmer", "left").join(F.broadcast(cutoff))
    return bounded.groupBy("read_ord").agg(F.sum(F.expr("shiftleft(1L, coalesce(bin, cutoff))")).alias("hits"))


def memory_batches(mates: DataFrame, refs: DataFrame, limit: int) -> DataFrame:
    """(read_ord, batch) for ``search_batches``: the plan from the references' own
    k-mer counts."""
    counts = seed_counts(refs)
    cutoff = frequency_cutoff(frequency_histogram(counts))
    mates = mates.withColumn("seq", dna.recode_read(F.col("seq")))
    hits = hit_upper_bound(mates, frequency_table(counts, cutoff), cutoff)
    return batch_plan(mates, hits, limit).select("read_ord", "batch")


def batch_plan(mates: DataFrame, hits: DataFrame, limit: int) -> DataFrame:
    """(read_ord, bytes, batch): reads in order, a new batch where the sum of bytes
    would exceed ``limit``; a read beyond it alone is an error.

    The sum starts anew with each batch, so this is one pass in order: a single task
    that streams two numbers for each read and holds none.
    """
    ship(mates.sparkSession)
    sized = mates.groupBy("read_ord").agg(F.sum(F.length("seq")).alias("bases")).join(hits, "read_ord", "left")
    costs = sized.select("read_ord", (F.coalesce("hits", F.lit(0)) * HIT_BYTES + F.col("bases") * BASE_BYTES).cast("bigint").alias("bytes"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, number = 0, 0
        for batch in batches:
            out = []
            for cost in batch.column(1).to_pylist():
                if cost > limit:
                    raise MemoryError(f"a read needs {cost} bytes of {limit}")
                if used + cost > limit:
                    used, number = 0, number + 1
                used += cost
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=["read_ord", "bytes", "batch"])

    return costs.repartition(1).sortWithinPartitions("read_ord").mapInArrow(fold, "read_ord bigint, bytes bigint, batch bigint")
