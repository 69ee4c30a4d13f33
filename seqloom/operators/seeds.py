"""Seed join and prescreen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kmers import kmers
from .params import FRAME, SCREEN, SEED


def seed_hits(mates: DataFrame, seeds: DataFrame) -> DataFrame:
    """(read_ord, mate, strand, ref_ord, readpos, refpos, diag, len).

    An equi-join on k-mers; the planner picks broadcast or shuffle by size, and
    splits hot k-mers at run time.  Positions of strand 1 are those in the reverse
    complement of the read.
    """
    reads = kmers(mates.select("read_ord", "mate", "seq", F.length("seq").alias("len")), "seq", SEED, "_pos")
    joined = reads.join(seeds, "kmer")
    readpos = F.when(F.col("strand") == 0, F.col("_pos")).otherwise(F.col("len") - SEED - F.col("_pos"))
    hits = joined.select("read_ord", "mate", "strand", "ref_ord", readpos.cast("int").alias("readpos"), F.col("refpos").cast("int").alias("refpos"), "len")
    return hits.withColumn("diag", F.col("refpos") - F.col("readpos"))


def prescreen(mates: DataFrame, words: DataFrame) -> DataFrame:
    """Mates with an unmasked frame of six consecutive known 16-mers keep their
    sequence, others become empty."""
    found = kmers(mates.select("read_ord", "mate", "seq"), "seq", SCREEN, "pos").withColumnRenamed("kmer", "word").join(words, "word", "left_semi")
    # positions p and p + 5 that are five apart in the sorted list hold six in a row;
    # then the 21 bases under them are unmasked
    at = found.groupBy("read_ord", "mate").agg(F.sort_array(F.collect_list("pos")).alias("_at"))
    runs = at.filter(F.exists(F.sequence(F.lit(0), F.greatest(F.size("_at") - FRAME, F.lit(0))), lambda i: F.get("_at", i + (FRAME - 1)) == F.get("_at", i) + (FRAME - 1)))
    passed = runs.select("read_ord", "mate").withColumn("_passed", F.lit(True))
    kept = mates.join(passed, ["read_ord", "mate"], "left")
    return kept.withColumn("seq", F.when(F.col("_passed"), F.col("seq")).otherwise("")).select(*mates.columns)
