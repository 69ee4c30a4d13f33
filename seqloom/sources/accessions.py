"""Reads by accession: a registry of readers, with tables as the one that is built in.

A reader gives (acc, spot_ord from 0, fragments) for an accession; a spot without
fragments could not be read.  Readers over a network can be registered; none is part
of this package.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Reader = Callable[[SparkSession, str], DataFrame]
SPOT = "acc string, spot_ord bigint, fragments array<string>"
_readers: dict[str, Reader] = {}


def register(prefix: str, reader: Reader) -> None:
    """Accessions that begin with ``prefix`` are read by ``reader``; the longest wins."""
    _readers[prefix] = reader


def tables(folder: str) -> Reader:
    """A reader of Parquet tables <folder>/<accession>.parquet."""
    return lambda spark, acc: spark.read.parquet(f"{folder}/{acc}.parquet").withColumn("acc", F.lit(acc))


def read_spots(spark: SparkSession, acc: str) -> DataFrame:
    """The spots of an accession; a path is a table of spots."""
    fits = [p for p in _readers if acc.startswith(p)]
    if fits:
        found = _readers[max(fits, key=len)](spark, acc)
    elif "/" in acc or acc.endswith(".parquet"):
        found = spark.read.parquet(acc)
    else:
        raise ValueError(f"no reader for the accession {acc}")
    return found.select("acc", F.col("spot_ord").cast("bigint"), "fragments")
