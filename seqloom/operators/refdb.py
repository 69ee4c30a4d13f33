"""The reference database: sequences, seeds, statistics, screening words."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dna
from .kmers import kmers, reference_seeds
from .params import SCREEN, SEED

#: Occurrences above which a k-mer is a repeat, an exact repeat;
#: distinct words that a frequency table may hold.
REPEAT, EXACT_REPEAT, TABLE_LIMIT = 16, 128, 128 * 1024 * 1024
#: Fixed value: bytes of an index entry.
INDEX_BYTES = 8


def reference_stats(refs: DataFrame) -> DataFrame:
    return refs.agg(F.count(F.lit(1)).alias("n_refs"), F.sum(F.length("seq")).alias("total_len"), F.min(F.length("seq")).alias("min_len"), F.max(F.length("seq")).alias("max_len"))


def seed_counts(refs: DataFrame) -> DataFrame:
    """(kmer, n) of the forward strand."""
    return kmers(refs.select("ref_ord", "seq"), "seq", SEED, "refpos").groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def memory_use(refs: DataFrame, seeds: DataFrame) -> DataFrame:
    """One row: bytes of the sequences at two bits, of their masks, and of an index."""
    held = refs.agg(F.sum(F.ceil(F.length("seq") / 4)).alias("seq_bytes"), F.sum(F.ceil(F.length("seq") / 8)).alias("mask_bytes"))
    return held.join(F.broadcast(seeds.agg((F.count(F.lit(1)) * INDEX_BYTES).alias("index_bytes"))))


def anchor_histogram(seeds: DataFrame) -> DataFrame:
    """(anchor, n, first): entries by anchor, and those before it; at most 4**9 rows."""
    counts = seeds.groupBy(dna.anchor_of(F.col("kmer")).alias("anchor")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("first", F.sum("n").over(Window.orderBy("anchor")) - F.col("n"))


def repeat_summary(counts: DataFrame) -> DataFrame:
    many, exact = F.col("n") > REPEAT, F.col("n") > EXACT_REPEAT
    total = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0)).cast("bigint")
    return counts.agg(F.count(F.lit(1)).alias("n_words"), total(many, F.lit(1)).alias("repeat_words"), total(many, F.col("n")).alias("repeat_positions"), total(exact, F.lit(1)).alias("exact_words"), total(exact, F.col("n")).alias("exact_positions"))


def frequency_histogram(counts: DataFrame) -> DataFrame:
    """(bin, words): distinct words by the power of two that holds their count."""
    return counts.groupBy(dna.log2_bin(F.col("n")).alias("bin")).agg(F.count(F.lit(1)).alias("words"))


def frequency_cutoff(histogram: DataFrame, limit: int = TABLE_LIMIT) -> DataFrame:
    """One row: the first bin that no longer fits when bins are taken from the top
    (0 if all fit).  A histogram has at most 64 bins."""
    above = histogram.withColumn("_sum", F.sum("words").over(Window.orderBy(F.desc("bin"))))
    return above.agg(F.coalesce(F.max(F.when(F.col("_sum") > limit, F.col("bin"))), F.lit(0)).cast("int").alias("cutoff"))


def frequency_table(counts: DataFrame, cutoff: DataFrame) -> DataFrame:
    """(kmer, bin) above the cutoff (one row, so the join broadcasts it)."""
    binned = counts.select("kmer", dna.log2_bin(F.col("n")).cast("int").alias("bin"))
    return binned.join(F.broadcast(cutoff), F.col("bin") > F.col("cutoff")).select("kmer", "bin")


def screening_words(refs: DataFrame) -> DataFrame:
    """Distinct 16-mers of both strands."""
    forward = kmers(refs.select("seq"), "seq", SCREEN, "pos", reverse=True).select("kmer", "reverse")
    return forward.select(F.explode(F.array("kmer", "reverse")).alias("word")).distinct()


def word_bitmaps(words: DataFrame) -> DataFrame:
    """(bucket, bitmap): the word set as bitmaps of 32768 bits."""
    return words.groupBy(F.expr("bitmap_bucket_number(word)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(word))").alias("bitmap"))


def build_db(refs: DataFrame, path: str, index: bool = False, word_set: bool = False) -> None:
    """Write refs, and on demand the seed index (sorted by k-mer) and the words.

    An index or word set of earlier references goes first, so that none is stale.
    """
    folder = refs.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(refs.sparkSession._jsc.hadoopConfiguration())
    for old in ("seeds", "words"):
        store.delete(refs.sparkSession._jvm.org.apache.hadoop.fs.Path(folder, old), True)
    refs.select("ref_ord", "ref_id", "seq").write.mode("overwrite").parquet(f"{path}/refs")
    refs = refs.sparkSession.read.parquet(f"{path}/refs")
    if index:
        reference_seeds(refs).repartitionByRange("kmer").sortWithinPartitions("kmer").write.mode("overwrite").parquet(f"{path}/seeds")
    if word_set:
        screening_words(refs).repartitionByRange("word").sortWithinPartitions("word").write.mode("overwrite").parquet(f"{path}/words")


def open_db(spark: SparkSession, path: str, prescreen: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(refs, seeds, words): seeds are derived if the index is missing; words must
    be there if they are asked for."""
    refs = spark.read.parquet(f"{path}/refs")
    try:
        seeds = spark.read.parquet(f"{path}/seeds")
    except AnalysisException:
        seeds = reference_seeds(refs)
    words = None
    if prescreen:
        try:
            words = spark.read.parquet(f"{path}/words")
        except AnalysisException as error:
            raise ValueError(f"{path} has no word set, which prescreen needs") from error
    return refs, seeds, words


