"""Reads: pairs, slices, length filter, counters.

Long form: read_ord, mate (0, 1), seq.  Wide form: read_ord, read_id, mate1, mate2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from .params import MAX_LENGTH


def read_slice(reads: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """Reads of ordinals first to last, both included."""
    kept = reads.filter(F.col("read_ord") >= first)
    return kept if last is None else kept.filter(F.col("read_ord") <= last)


def zip_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two sources (read_ord, read_id, seq) by position; unequal counts and ids
    that do not belong together raise an error."""
    a = first.select("read_ord", F.col("read_id").alias("id1"), F.col("seq").alias("mate1"))
    b = second.select("read_ord", F.col("read_id").alias("id2"), F.col("seq").alias("mate2"))
    both = a.join(b, "read_ord", "full_outer")
    read_id = F.when(F.col("id1").isNull() | F.col("id2").isNull(), F.raise_error(F.lit("the mate sources differ in length"))).otherwise(dna.require(dna.combine_ids(F.col("id1"), F.col("id2")), "mate ids do not match"))
    return both.select("read_ord", read_id.alias("read_id"), "mate1", "mate2")


def interleaved_pairs(records: DataFrame) -> DataFrame:
    """Records 2i and 2i + 1 (by read_ord) are the mates of read i."""
    mate = F.col("read_ord") % 2
    paired = records.groupBy(F.floor(F.col("read_ord") / 2).alias("pair")).agg(*(F.max(F.when(mate == k, F.col(c))).alias(f"{c}{k}") for c in ("read_id", "seq") for k in (0, 1)))
    read_id = dna.require(dna.combine_ids(F.col("read_id0"), F.col("read_id1")), "an odd record, or mate ids that do not match")
    return paired.select(F.col("pair").alias("read_ord"), read_id.alias("read_id"), F.col("seq0").alias("mate1"), F.col("seq1").alias("mate2"))


def spot_reads(spots: DataFrame) -> DataFrame:
    """(acc, spot_ord from 0, fragments): two fragments are a pair, of any other
    number the first alone counts; spots without any are left out."""
    paired = F.size("fragments") == 2
    read = spots.filter("size(fragments) > 0")
    return read.select(F.col("spot_ord").alias("read_ord"), F.concat_ws(".", "acc", (F.col("spot_ord") + 1).cast("string")).alias("read_id"), F.get("fragments", F.lit(0)).alias("mate1"), F.when(paired, F.get("fragments", F.lit(1))).alias("mate2"))


def to_mates(pairs: DataFrame) -> DataFrame:
    """Wide to long; a missing second mate has no row."""
    mates = F.array(F.struct(F.lit(0).alias("mate"), F.col("mate1").alias("seq")), F.struct(F.lit(1).alias("mate"), F.col("mate2").alias("seq")))
    return pairs.select("read_ord", "read_id", F.inline(mates)).filter("seq IS NOT NULL")


def length_filter(mates: DataFrame, limit: int = MAX_LENGTH) -> DataFrame:
    """Reads all of whose mates are shorter than ``limit``."""
    long = mates.filter(F.length("seq") >= limit).select("read_ord").distinct()
    return mates.join(long, "read_ord", "left_anti")


def failed_spots(spots: DataFrame) -> DataFrame:
    """One row: the spots that could not be read (no fragments)."""
    return spots.agg(F.coalesce(F.sum((F.col("fragments").isNull() | (F.size("fragments") < 1)).cast("bigint")), F.lit(0).cast("bigint")).alias("failed"))


def duplicate_ids(reads: DataFrame) -> DataFrame:
    """(read_id, reads): ids that more than one read has."""
    return reads.select("read_ord", "read_id").distinct().groupBy("read_id").agg(F.count(F.lit(1)).alias("reads")).filter("reads > 1")


def require_unique(mates: DataFrame) -> DataFrame:
    """``mates``, or an error when a read's id is that of another read."""
    again = duplicate_ids(mates).select(F.col("read_id").alias("_again"))
    found = mates.join(again, F.col("read_id") == F.col("_again"), "left")
    return found.withColumn("read_id", F.when(F.col("_again").isNotNull(), F.raise_error(F.concat(F.lit("duplicate id: "), "_again"))).otherwise(F.col("read_id"))).drop("_again")


def screened_mates(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: the mates that a prescreen emptied."""
    filled = lambda df: df.filter("length(seq) > 0").agg(F.count(F.lit(1)).alias("n"))
    return filled(before).join(F.broadcast(filled(after).withColumnRenamed("n", "m"))).select((F.col("n") - F.col("m")).alias("n_screened"))


def counters(mates: DataFrame, limit: int = MAX_LENGTH) -> DataFrame:
    """One row: reads, pairs, mates, bases, masked bases, reads beyond the limit."""
    by_read = mates.groupBy("read_ord").agg(F.count(F.lit(1)).alias("mates"), F.sum(F.length("seq")).alias("bases"), F.sum(F.length("seq") - F.length(F.translate("seq", "N", ""))).alias("masked"), F.max(F.length("seq")).alias("longest"))
    return by_read.agg(
        F.count(F.lit(1)).alias("n_reads"),
        F.sum((F.col("mates") > 1).cast("bigint")).alias("n_pairs"),
        F.sum("mates").alias("n_mates"),
        F.sum("bases").alias("n_bases"),
        F.sum("masked").cast("bigint").alias("n_masked"),
        F.sum((F.col("longest") >= limit).cast("bigint")).alias("n_skipped"),
    )
