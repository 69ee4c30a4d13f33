"""Reads from any supported source, in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna
from ..operators.ingest import interleaved_pairs, read_slice, spot_reads, to_mates, zip_pairs
from .accessions import read_spots
from .fastx import read_fastx


def open_reads(spark: SparkSession, files: Sequence[str], fmt: str = "fasta", interleaved: bool = False, first: int = 0, last: int | None = None) -> DataFrame:
    """(read_ord, read_id, mate, seq) from one file, two mate files, interleaved
    records, or (fmt "sra" or "spots") the spots of an accession or table."""
    if not files:
        raise ValueError("no input")
    if len(files) > 2 or (len(files) == 2 and interleaved):
        raise ValueError("input is one file, one interleaved file, or two files of mates")
    if fmt in ("sra", "spots"):
        if len(files) > 1 or interleaved:
            raise ValueError("spots have their mates in one table")
        return to_mates(read_slice(spot_reads(read_spots(spark, files[0])), first, last))
    if len(files) == 2:
        pairs = zip_pairs(*(read_fastx(spark, f, fmt) for f in files))
    elif interleaved:
        pairs = interleaved_pairs(read_fastx(spark, files[0], fmt))
    else:
        pairs = read_fastx(spark, files[0], fmt).select("read_ord", "read_id", F.col("seq").alias("mate1"), F.lit(None).cast("string").alias("mate2"))
    return to_mates(read_slice(pairs, first, last))


def open_references(spark: SparkSession, files: Sequence[str] | str, fmt: str = "fasta") -> DataFrame:
    """(ref_ord, ref_id, seq) in bases and N."""
    rows = read_fastx(spark, files, fmt, reference=True)
    return rows.select(F.col("read_ord").alias("ref_ord"), F.col("read_id").alias("ref_id"), dna.recode_reference(F.col("seq")).alias("seq"))
