"""Marking reads: runs on a diagonal, bands of diagonals, the first success.

All steps on hits group by (read_ord, mate, strand, ref_ord) and more, so one exchange
serves them; the few bands that qualify meet by read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .params import SEED, SearchParams

GROUP = ["read_ord", "mate", "strand", "ref_ord"]


def exact_runs(hits: DataFrame) -> DataFrame:
    """(group, diag, run_start, run_end, run_len): contiguous exact matches."""
    return _run_rows(hits).groupBy(*GROUP, "diag", "run_start").agg((F.max("readpos") + SEED).alias("run_end")).withColumn("run_len", F.col("run_end") - F.col("run_start"))


def _run_rows(hits: DataFrame) -> DataFrame:
    order = Window.partitionBy(*GROUP, "diag").orderBy("readpos")
    gap = F.lag("readpos").over(order) + SEED < F.col("readpos")
    begun = hits.withColumn("_start", F.when(F.coalesce(gap, F.lit(True)), F.col("readpos")))
    return begun.withColumn("run_start", F.last("_start", True).over(order))


def band_coverage(hits: DataFrame, delta: int) -> DataFrame:
    """(group, len, diag, bases): bases of the read covered by hits of diagonals
    diag to diag + delta, for each diagonal with a hit.

    Each hit is listed for the bands it belongs to, an equi-group instead of a
    range join; covered bases are the sum of the gaps to the next hit, at most 21.
    """
    bands = hits.select(*GROUP, "len", "readpos", "diag", F.explode(F.sequence(F.col("diag") - delta, F.col("diag"))).alias("band"))
    places = bands.groupBy(*GROUP, "len", "band", "readpos").agg(F.max(F.col("diag") == F.col("band")).alias("_own"))
    order = Window.partitionBy(*GROUP, "len", "band").orderBy("readpos")
    gaps = places.withColumn("_gap", F.least(F.lit(SEED), F.coalesce(F.lead("readpos").over(order) - F.col("readpos"), F.lit(SEED))))
    covered = gaps.groupBy(*GROUP, "len", "band").agg(F.sum("_gap").alias("bases"), F.max("_own").alias("_own")).filter("_own")
    return covered.select(*GROUP, "len", F.col("band").alias("diag"), "bases")


def _enough(bases: Column, params: SearchParams) -> Column:
    """In single precision, as the thresholds are defined."""
    ratio = F.lit(params.coverage_ratio).cast("float") * F.col("len").cast("float") <= bases.cast("float")
    return ratio & (bases >= params.covered_bases)


def mark(hits: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """(read_ord, mate, len, covered_bases): the first success of each read, or of
    each mate; groups in the order of mate, strand, reference; a run before bands,
    bands by diagonal."""
    hits = hits.repartition(*GROUP)
    results = []
    if params.continuous_bases > SEED:
        runs = _run_rows(hits).withColumn("clen", F.col("readpos") - F.col("run_start") + SEED).filter(F.col("clen") >= params.continuous_bases)
        first = runs.groupBy(*GROUP, "len").agg(F.min_by("clen", F.struct("diag", "readpos")).alias("bases"))
        results.append(first.filter(_enough(F.col("bases"), params)).select(*GROUP, "len", F.lit(0).alias("step"), F.lit(0).alias("diag"), F.col("bases").cast("bigint").alias("bases")))
        hits = hits.join(first.select(*GROUP), GROUP, "left_semi")
    if params.covered_bases == 0 and params.coverage_ratio == 0:
        # with no threshold the first band is accepted before anything is added
        bands = hits.groupBy(*GROUP, "len").agg(F.min("diag").alias("diag")).withColumn("bases", F.lit(0).cast("bigint"))
    else:
        bands = band_coverage(hits, params.max_diag_delta).filter(_enough(F.col("bases"), params))
    results.append(bands.select(*GROUP, "len", F.lit(1).alias("step"), "diag", "bases"))
    found = results[0] if len(results) == 1 else results[0].unionByName(results[1])
    keys = ["read_ord", "mate"] if params.per_mate else ["read_ord"]
    order = Window.partitionBy(*keys).orderBy("mate", "strand", "ref_ord", "step", "diag")
    return found.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").select("read_ord", "mate", "len", F.col("bases").alias("covered_bases"))
