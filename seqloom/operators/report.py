"""Reports: FASTA records of marked reads, and the run's summary."""

from __future__ import annotations

from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna


def report(mates: DataFrame, marks: DataFrame, per_mate: bool = False) -> DataFrame:
    """(read_ord, mate, header, seq) of marked reads with a sequence.

    ``mates`` has read_ord, read_id, mate, seq.  A read with two mates gets .1 and
    .2; in read mode both carry the figures of the mate that succeeded.
    """
    ratio = dna.general_format(F.col("covered_bases").cast("float") / F.col("len").cast("float"))
    won = marks.select("read_ord", *(["mate"] if per_mate else []), F.concat_ws(" ", F.when(F.col("covered_bases") == 0, "0").otherwise(ratio), F.col("covered_bases").cast("string")).alias("_figures"))
    paired = mates.groupBy("read_ord").agg((F.max("mate") > 0).alias("_paired"))
    rows = mates.join(won, ["read_ord", "mate"] if per_mate else ["read_ord"]).join(paired, "read_ord").filter(F.length("seq") > 0)
    name = F.when(F.col("_paired"), F.concat_ws(".", "read_id", (F.col("mate") + 1).cast("string"))).otherwise(F.col("read_id"))
    return rows.select("read_ord", "mate", F.concat(F.lit(">"), name, F.lit(" "), "_figures").alias("header"), dna.recode_read(F.col("seq")).alias("seq"))


def write_report(rows: DataFrame, path: str) -> None:
    """FASTA text in the order of the reads; as many files as partitions."""
    rows.orderBy("read_ord", "mate").select(F.concat_ws("\n", "header", "seq").alias("value")).write.mode("overwrite").text(path)


def print_report(rows: DataFrame, out: TextIO) -> None:
    """The same to a stream, a partition at a time."""
    for row in rows.orderBy("read_ord", "mate").select("header", "seq").toLocalIterator():
        out.write(f"{row.header}\n{row.seq}\n")


def run_summary(mates: DataFrame, marks: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row: reads searched, reads that could not be read (``failed``, one row, as
    of ``failed_spots``) and marks."""
    total = mates.agg(F.count_distinct("read_ord").alias("total_reads"))
    total = total.join(F.broadcast(failed.select(F.col("failed").alias("failed_reads")))) if failed is not None else total.withColumn("failed_reads", F.lit(0).cast("bigint"))
    return total.join(F.broadcast(marks.agg(F.count(F.lit(1)).alias("mapped"))))
