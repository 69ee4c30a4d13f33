"""The search as one plan."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from .ingest import length_filter
from .kmers import reference_seeds
from .marking import mark
from .params import SearchParams
from .report import report
from .seeds import prescreen, seed_hits


def search(mates: DataFrame, refs: DataFrame, params: SearchParams = SearchParams(), seeds: DataFrame | None = None, words: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(marks, report) of reads (read_ord, read_id, mate, seq) against references
    (ref_ord, seq, both in bases and N)."""
    mates = length_filter(mates.withColumn("seq", dna.recode_read(F.col("seq"))))
    if params.prescreen:
        if words is None:
            raise ValueError("prescreen needs a word set")
        mates = prescreen(mates, words)
    marks = mark(seed_hits(mates, seeds if seeds is not None else reference_seeds(refs)), params)
    return marks, report(mates, marks, params.per_mate)


def count_batches(mates: DataFrame, size: int) -> DataFrame:
    """(read_ord, batch): at most ``size`` neighbouring ordinals in a batch."""
    if size < 1:
        raise ValueError("a batch has at least one read")
    return mates.select("read_ord").distinct().select("read_ord", F.floor(F.col("read_ord") / size).alias("batch"))


def search_batches(mates: DataFrame, batches: DataFrame, refs: DataFrame, params: SearchParams = SearchParams(), seeds: DataFrame | None = None, words: DataFrame | None = None) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """(batch, marks, report), batch by batch as (read_ord, batch) deals the reads.

    A read's result depends on that read alone, so the batches' results are those of
    one search; only their numbers, one for each batch, come to the driver.
    """
    dealt = mates.join(batches, "read_ord")
    for number in sorted(r.batch for r in batches.select("batch").distinct().collect()):
        yield number, *search(dealt.filter(F.col("batch") == number).drop("batch"), refs, params, seeds, words)
