"""Reads and references derived from the driver's text tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna
from .shipping import shared_root

TILE = 150


def spread(df: DataFrame) -> DataFrame:
    """Rows of fewer files than there are cores are dealt to all; more files are
    left where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_ord, ref_id, seq) of the benchmark passages."""
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("ref_ord"), F.concat(F.lit("p"), F.col("item_id").cast("string")).alias("ref_id"), dna.text_to_dna(F.col("text")).alias("seq"))


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_ord, read_id, mate, seq): 100 bases of the references, every 40, by
    read_ord % 4 exact, reverse complement, without base 51, with two masks."""
    cuts = refs(spark, sf_dir).filter("length(seq) >= 100").select("ref_ord", "seq", F.explode(F.expr("sequence(0, (length(seq) - 100) div 40)")).alias("t"))
    cuts = cuts.select((F.col("ref_ord") * 1000 + F.col("t")).alias("read_ord"), F.substring("seq", F.col("t") * 40 + 1, F.lit(100)).alias("s"))
    kind = F.col("read_ord") % 4
    seq = (
        F.when(kind == 1, dna.reverse_complement(F.col("s")))
        .when(kind == 2, F.concat(F.substring("s", 1, 50), F.substring("s", 52, 49)))
        .when(kind == 3, F.concat(F.substring("s", 1, 30), F.lit("N"), F.substring("s", 32, 29), F.lit("N"), F.substring("s", 62, 39)))
        .otherwise(F.col("s"))
    )
    return cuts.select("read_ord", F.concat(F.lit("r"), F.col("read_ord").cast("string")).alias("read_id"), F.lit(0).alias("mate"), seq.alias("seq"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_ord, read_id, mate, seq): the documents as reads of up to 150 bases."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", dna.text_to_dna(F.col("text")).alias("seq"))
    cut = docs.select("doc_id", F.posexplode(F.regexp_extract_all("seq", F.lit(f".{{1,{TILE}}}"), F.lit(0))).alias("tile", "seq"))
    # tiles from 1000 on would have the ids of the next document: theirs are negative, with room for any text
    ord_ = F.when(F.col("tile") < 1000, F.col("doc_id") * 1000 + F.col("tile")).otherwise(-(F.col("doc_id") * (1 << 24) + F.col("tile")))
    return cut.select(ord_.alias("read_ord"), F.concat(F.lit("r"), ord_.cast("string")).alias("read_id"), F.lit(0).alias("mate"), "seq")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_ord, id1, id2, mate1, mate2): neighbouring shots of one passage."""
    one = shots(spark, sf_dir)
    a = one.filter("read_ord % 2 = 0").select(F.col("read_ord"), F.col("seq").alias("mate1"))
    b = one.filter("read_ord % 2 = 1").select((F.col("read_ord") - 1).alias("read_ord"), F.col("seq").alias("mate2"))
    name = F.concat(F.lit("r"), F.col("read_ord").cast("string"))
    return a.join(b, "read_ord").select("read_ord", F.concat(name, F.lit("/1")).alias("id1"), F.concat(name, F.lit("/2")).alias("id2"), "mate1", "mate2")


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(acc, spot_ord, fragments) with one, two or three fragments."""
    p = pairs(spark, sf_dir)
    return p.select(F.lit("ACC1").alias("acc"), F.col("read_ord").alias("spot_ord"), F.expr("CASE read_ord % 3 WHEN 0 THEN array(mate1) WHEN 1 THEN array(mate1, mate2) ELSE array(mate1, mate2, mate1) END").alias("fragments"))


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_ord, seq): whole references, each up to 200 times in a row."""
    return refs(spark, sf_dir).select("ref_ord", F.expr("repeat(seq, element_at(array(1, 17, 20, 129, 200), cast(ref_ord % 5 + 1 AS int)))").alias("seq"))


def broken_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spots, some of which could not be read."""
    return spots(spark, sf_dir).withColumn("fragments", F.expr("CASE spot_ord % 8 WHEN 6 THEN NULL WHEN 4 THEN array() ELSE fragments END"))


def folder(spark: SparkSession, label: str) -> str:
    """A new folder that executors see, gone when the application ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def text_files(records: DataFrame, order: str, value: Column, label: str, **options) -> list[str]:
    """Records as text, in order, in several files: their paths."""
    spark = records.sparkSession
    path = folder(spark, label)
    records.repartitionByRange(3, order).sortWithinPartitions(order).select(value.alias("value")).write.options(**options).text(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = [f.getPath().toString() for f in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)]
    return sorted(f for f in files if "/part-" in f)


def fasta(name: Column, seq: Column) -> Column:
    """A record with a description, its sequence in lines of 60."""
    return F.concat(F.lit(">"), name, F.lit(" of the benchmark\n"), F.regexp_replace(seq, "(.{60})", "$1\n"))


def fastq(name: Column, seq: Column) -> Column:
    """A record whose qualities look like headers."""
    return F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), F.regexp_replace(seq, ".", "@"))
