import gzip

import pytest
from pyspark.sql import functions as F

from seqloom.cli import main
from seqloom.functions import dna
from seqloom.operators.ingest import interleaved_pairs, zip_pairs
from seqloom.sources.fastx import FormatError, parse_fasta, parse_fastq, read_fastx
from seqloom.sources.reads import open_references


def put(path, text):
    path.write_bytes(text.encode("latin-1"))
    return str(path)


def test_fasta(tmp_path):
    f = put(tmp_path / "multi.fa", "#c\n\n>a b c\nACGT\n#x\nAC\n>b\tz\n>c\r\nAC\r\n")
    assert list(parse_fasta(f)) == [("a", "ACGTAC"), ("b", ""), ("c", "AC")]
    assert list(parse_fasta(f, reference=True)) == [("a", "ACGTAC"), ("c", "AC")]
    with pytest.raises(FormatError):
        list(parse_fasta(put(tmp_path / "bad.fa", "ACGT\n>a\n")))
    with pytest.raises(FormatError):
        list(parse_fasta(put(tmp_path / "noid.fa", "> x\nACGT\n"), reference=True))


def test_fastq(tmp_path):
    f = put(tmp_path / "q.fq", "@a x\nACGT\nAC\n+\n@III\nII\n@b\nAC\n+b\n+@\n")
    assert list(parse_fastq(f)) == [("a", "ACGTAC"), ("b", "AC")]
    for bad in ("@a\nACGT\n", "@a\nACGT\n+\nIII\n", "ACGT\n", "@a\nAC\n+\nIII\n@b\nA\n+\nI\n"):
        with pytest.raises(FormatError):
            list(parse_fastq(put(tmp_path / "bad.fq", bad)))


def test_gzip_and_order(spark, tmp_path):
    path = tmp_path / "m.fa.gz"
    path.write_bytes(gzip.compress(b">a\nAC\n") + gzip.compress(b">b\nGT\n"))
    assert [tuple(r) for r in read_fastx(spark, str(path)).orderBy("read_ord").collect()] == [(0, "a", "AC"), (1, "b", "GT")]
    with pytest.raises(ValueError):
        read_fastx(spark, str(path), "sam")


def test_pairs(spark):
    one = spark.createDataFrame([(0, "a/1", "AC"), (1, "b.1", "GT")], "read_ord bigint, read_id string, seq string")
    two = spark.createDataFrame([(0, "a/2", "CC"), (1, "b.2", "GG")], "read_ord bigint, read_id string, seq string")
    assert [r.read_id for r in zip_pairs(one, two).orderBy("read_ord").collect()] == ["a", "b"]
    with pytest.raises(Exception, match="differ in length"):
        zip_pairs(one, two.filter("read_ord = 0")).collect()
    mixed = spark.createDataFrame([(0, "x_1", "AC"), (1, "x_2", "GT"), (2, "y", "A"), (3, "y", "C")], "read_ord bigint, read_id string, seq string")
    assert [tuple(r) for r in interleaved_pairs(mixed).orderBy("read_ord").collect()] == [(0, "x", "AC", "GT"), (1, "y", "A", "C")]
    with pytest.raises(Exception, match="odd"):
        interleaved_pairs(mixed.filter("read_ord < 3")).collect()


@pytest.mark.parametrize("a,b,want", [("a/1", "a/2", "a"), ("a_1", "a_2", "a"), ("a", "a", "a"), ("a1", "a2", None), ("a.2", "a.1", None), ("a.1", "ab.2", None), ("a.1", "b.2", None), ("a.1", "a/2", None)])
def test_ids(spark, a, b, want):
    assert spark.range(1).select(dna.combine_ids(F.lit(a), F.lit(b))).first()[0] == want


def test_letters(spark):
    row = spark.createDataFrame([("acgtuRYN-*",)], "s string").select(dna.recode_read(F.col("s")), dna.recode_reference(F.col("s"))).first()
    assert tuple(row) == ("ACGTNNNNNN", "ACGTTNNN")
    code = spark.range(1).select(dna.kmer_code(F.lit("ACGTACGTTTGCAACGGATCC")), dna.reverse_complement(F.lit("ACGTACGTTTGCAACGGATCC"))).first()
    assert tuple(code) == (1591561151716, "GGATCCGTTGCAAACGTACGT")


def test_general_format(spark):
    values = [(a / b, "%g" % __import__("numpy").float32(a / b)) for a, b in ((1, 1), (1, 2), (2, 3), (21, 100), (33, 107), (21, 32767), (99, 100), (5, 64))]
    got = spark.createDataFrame([(v,) for v, _ in values], "x double").select(dna.general_format(F.col("x").cast("float"))).collect()
    assert [r[0] for r in got] == [w for _, w in values]


def test_command_line(spark, tmp_path):
    ref = "ACGTTGCAACCTGATTGACCATGGTACCAGTTCAGGACTTACGA"
    refs = put(tmp_path / "r.fa", f">ref1\n{ref}\n")
    reads = put(tmp_path / "q.fa", f">hit\n{ref[5:40]}\n>miss\n{'AC' * 20}\n")
    main(["mkdb", "-i", refs, "-o", str(tmp_path / "db"), "--mkidx", "--mkws"], spark)
    main(["search", "-d", str(tmp_path / "db"), "-i", reads, "-o", str(tmp_path / "out"), "--prescreen"], spark)
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))) == f">hit 1 35\n{ref[5:40]}\n"
    assert open_references(spark, refs).first().ref_id == "ref1"


def test_command_line_batches(spark, tmp_path, capsys):
    """Batches by count and by memory give the reads of one search; without a folder to standard output."""
    ref = "ACGTTGCAACCTGATTGACCATGGTACCAGTTCAGGACTTACGA"
    refs = put(tmp_path / "r.fa", f">ref1\n{ref}\n")
    reads = put(tmp_path / "q.fa", "".join(f">q{i}\n{ref[i : i + 30] if i % 2 else 'AC' * 20}\n" for i in range(9)))
    main(["mkdb", "-i", refs, "-o", str(tmp_path / "db")], spark)
    want = "".join(f">q{i} 1 30\n{ref[i : i + 30]}\n" for i in range(1, 9, 2))
    search = ["search", "-d", str(tmp_path / "db"), "-i", reads, "-c", "0.9"]
    main(search, spark)
    assert capsys.readouterr().out == want
    for extra in (["-b", "4"], ["-M", "1"]):
        main([*search, *extra], spark)
        assert capsys.readouterr().out == want
    main([*search, "-b", "4", "-o", str(tmp_path / "out")], spark)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["batch=0", "batch=1", "batch=2"]
    with pytest.raises(ValueError, match="at least one"):
        main([*search, "--batch-size=-1"], spark)


def test_accessions(spark, tmp_path, capsys):
    from seqloom.sources import accessions
    from seqloom.sources.reads import open_reads

    ref = "ACGTTGCAACCTGATTGACCATGGTACCAGTTCAGGACTTACGA"
    data = [(0, [ref[:30], ref[10:40]]), (1, None), (2, [ref[5:40]]), (3, []), (4, ["AC" * 20, "A", "C"])]
    spark.createDataFrame([("x", *row) for row in data], accessions.SPOT).write.parquet(str(tmp_path / "RUN7.parquet"))
    accessions.register("RUN", accessions.tables(str(tmp_path)))
    got = sorted((r.read_ord, r.read_id, r.mate, r.seq) for r in open_reads(spark, ["RUN7"], "sra").collect())
    assert got == [(0, "RUN7.1", 0, ref[:30]), (0, "RUN7.1", 1, ref[10:40]), (2, "RUN7.3", 0, ref[5:40]), (4, "RUN7.5", 0, "AC" * 20)]
    with pytest.raises(ValueError, match="no reader"):
        open_reads(spark, ["OTHER1"], "sra")
    main(["mkdb", "-i", put(tmp_path / "r.fa", f">ref1\n{ref}\n"), "-o", str(tmp_path / "db")], spark)
    main(["search", "-d", str(tmp_path / "db"), "-i", "RUN7", "-F", "sra"], spark)
    assert [x.split(" ")[0] for x in capsys.readouterr().out.splitlines()[::2]] == [">RUN7.1.1", ">RUN7.1.2", ">RUN7.3"]


def test_refused_input(spark, tmp_path):
    """No file is dropped in silence, no old index is used, ids may be asked to differ."""
    from seqloom.operators.ingest import require_unique
    from seqloom.operators.refdb import build_db, open_db
    from seqloom.sources.reads import open_reads

    f = put(tmp_path / "a.fa", ">a\nACGT\n>a\nAC\n")
    for files, interleaved in (([f, f, f], False), ([f, f], True), ([], False)):
        with pytest.raises(ValueError):
            open_reads(spark, files, interleaved=interleaved)
    assert open_reads(spark, [f]).count() == 2
    with pytest.raises(Exception, match="duplicate id: a"):
        require_unique(open_reads(spark, [f])).collect()
    with pytest.raises(Exception, match="not a strand"):
        spark.range(1).select(dna.strand_of(F.lit("x"))).collect()
    one, two = (spark.createDataFrame([(0, "r", s)], "ref_ord bigint, ref_id string, seq string") for s in ("ACGTTGCAACCTGATTGACCATGG", "TTTTTGCAACCTGATTGACCATGGA"))
    path = str(tmp_path / "db")
    build_db(one, path, index=True, word_set=True)
    assert open_db(spark, path, True)[2].count() > 0
    build_db(two, path)
    assert open_db(spark, path)[1].count() == 2 * (25 - 20)
    with pytest.raises(ValueError, match="no word set"):
        open_db(spark, path, True)


def test_stream(spark, tmp_path):
    from seqloom.streaming.search import search_stream

    ref = "ACGTTGCAACCTGATTGACCATGGTACCAGTTCAGGACTTACGA"
    refs = spark.createDataFrame([(0, ref)], "ref_ord bigint, seq string")
    for k in range(2):
        spark.createDataFrame([(k, f"r{k}", 0, ref[k : k + 30])], "read_ord bigint, read_id string, mate int, seq string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    reads = spark.readStream.schema("read_ord bigint, read_id string, mate int, seq string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = search_stream(reads, refs, str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True)
    query.awaitTermination(120)
    assert sorted(r.read_ord for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1]
