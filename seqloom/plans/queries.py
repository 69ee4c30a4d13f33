"""One query for each operator, and the SQL that must give the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna
from ..operators import ingest, kmers, marking, refdb, report, seeds
from ..operators import search as search_
from ..operators.params import SearchParams
from ..sources import accessions, reads
from ..sources.fastx import read_fastx
from ..streaming.search import search_stream
from . import batches, fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CUTOFF_LIMIT, BATCH_BYTES = 1_000, 600_000

# ------------------------------------------------------------------ SQL pieces


def _dna(x: str) -> str:
    return f"translate(regexp_replace(regexp_replace(lower({x}), '[0-9]', 'N', 'g'), '[^a-zN]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"


def _rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def _code(x: str, k: int = 21) -> str:
    return f"list_sum(list_transform(range(0, {k}), lambda i: (strpos('ACGT', substr({x}, i::INT + 1, 1)) - 1)::BIGINT << (2 * i)::INT))::BIGINT"


_REFS = f"refs AS (SELECT item_id AS ref_ord, 'p' || item_id AS ref_id, {_dna('text')} AS seq FROM benchmark)"
_CUTS = "cuts AS (SELECT ref_ord * 1000 + t AS read_ord, substr(seq, t::INT * 40 + 1, 100) AS s FROM (SELECT ref_ord, seq, unnest(range(0, (length(seq) - 100) // 40 + 1)) AS t FROM refs WHERE length(seq) >= 100))"
_SHOTS = f"""shots AS (SELECT read_ord, 'r' || read_ord AS read_id, 0 AS mate, CASE read_ord % 4 WHEN 1 THEN {_rc('s')} WHEN 2 THEN substr(s, 1, 50) || substr(s, 52, 49)
  WHEN 3 THEN substr(s, 1, 30) || 'N' || substr(s, 32, 29) || 'N' || substr(s, 62, 39) ELSE s END AS seq FROM cuts)"""
_TILES = f"""docs AS (SELECT doc_id, {_dna('text')} AS seq FROM documents),
tiles AS (SELECT doc_id * 1000 + t AS read_ord, 'r' || (doc_id * 1000 + t) AS read_id, 0 AS mate, substr(seq, t::INT * 150 + 1, 150) AS seq FROM (SELECT doc_id, seq, unnest(range(0, (length(seq) - 1) // 150 + 1)) AS t FROM docs WHERE length(seq) > 0))"""
_PAIRS = "pairs AS (SELECT a.read_ord, 'r' || a.read_ord || '/1' AS id1, 'r' || a.read_ord || '/2' AS id2, a.seq AS mate1, b.seq AS mate2 FROM shots a JOIN shots b ON a.read_ord % 2 = 0 AND b.read_ord = a.read_ord + 1)"
_MATES = "mates AS (SELECT read_ord, 'r' || read_ord AS read_id, 0 AS mate, mate1 AS seq FROM pairs UNION ALL SELECT read_ord, 'r' || read_ord, 1, mate2 FROM pairs)"
_REPEATS = "reps AS (SELECT ref_ord, repeat(seq, [1, 17, 20, 129, 200][ref_ord % 5 + 1]) AS seq FROM refs)"
_SHOT_BASE = f"{_REFS}, {_CUTS}, {_SHOTS}"
_PAIR_BASE = f"{_SHOT_BASE}, {_PAIRS}, {_MATES}"


def _kmers(name: str, source: str, columns: str, k: int = 21, position: str = "pos") -> str:
    return f"{name} AS (SELECT * FROM (SELECT {columns}, p AS {position}, substr(seq, p::INT + 1, {k}) AS kmer FROM (SELECT *, unnest(range(0, length(seq) - {k - 1})) AS p FROM {source} WHERE length(seq) >= {k})) WHERE kmer NOT LIKE '%N%')"


def _hits(reads: str) -> str:
    """hits of the table ``reads`` (read_ord, mate, seq), the reads reversed."""
    return f"""stranded AS (SELECT read_ord, mate, 0 AS strand, seq, length(seq) AS len FROM {reads} UNION ALL SELECT read_ord, mate, 1, {_rc('seq')}, length(seq) FROM {reads}),
{_kmers('rk', 'stranded', 'read_ord, mate, strand, len', position='readpos')},
{_kmers('fk', 'refs', 'ref_ord', position='refpos')},
hits AS (SELECT read_ord, mate, strand, ref_ord, readpos, refpos, refpos - readpos AS diag, len FROM rk JOIN fk ON rk.kmer = fk.kmer)"""


_G = "read_ord, mate, strand, ref_ord"
_RUNS = f"""flagged AS (SELECT *, CASE WHEN coalesce(lag(readpos) OVER w + 21 < readpos, true) THEN readpos END AS st FROM hits WINDOW w AS (PARTITION BY {_G}, diag ORDER BY readpos)),
runrows AS (SELECT *, max(st) OVER (PARTITION BY {_G}, diag ORDER BY readpos) AS run_start FROM flagged)"""


def _bands(delta: int) -> str:
    return f"""ds AS (SELECT DISTINCT {_G}, len, diag FROM hits),
places AS (SELECT DISTINCT ds.read_ord, ds.mate, ds.strand, ds.ref_ord, ds.len, ds.diag, h.readpos FROM ds JOIN hits h ON ds.read_ord = h.read_ord AND ds.mate = h.mate AND ds.strand = h.strand AND ds.ref_ord = h.ref_ord AND h.diag BETWEEN ds.diag AND ds.diag + {delta}),
gaps AS (SELECT *, least(21, coalesce(lead(readpos) OVER (PARTITION BY {_G}, diag ORDER BY readpos) - readpos, 21)) AS gap FROM places),
bands AS (SELECT {_G}, len, diag, sum(gap)::BIGINT AS bases FROM gaps GROUP BY ALL)"""


def _marks(p: SearchParams) -> str:
    ok = f"{p.coverage_ratio}::FLOAT * len::FLOAT <= bases::FLOAT AND bases >= {p.covered_bases}"
    keys = "read_ord, mate" if p.per_mate else "read_ord"
    parts = [_bands(p.max_diag_delta)]
    both = f"SELECT {_G}, len, 1 AS step, diag, bases FROM bands WHERE {ok}"
    if p.covered_bases == 0 and p.coverage_ratio == 0:
        both = f"SELECT {_G}, len, 1 AS step, min(diag) AS diag, 0 AS bases FROM hits GROUP BY ALL"
    if p.continuous_bases > 21:
        parts += [_RUNS, f"firsts AS (SELECT {_G}, len, first(readpos - run_start + 21 ORDER BY diag, readpos) AS bases FROM runrows WHERE readpos - run_start + 21 >= {p.continuous_bases} GROUP BY ALL)"]
        both = f"SELECT x.* FROM ({both}) x SEMI JOIN firsts f USING ({_G}) UNION ALL SELECT {_G}, len, 0, 0, bases FROM firsts WHERE {ok}"
    return ",\n".join(parts) + f",\nmarks AS (SELECT read_ord, mate, len, bases AS covered_bases FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY mate, strand, ref_ord, step, diag) AS r FROM ({both})) WHERE r = 1)"


def _query(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


# -------------------------------------------------------------------- scalars

_docs = lambda s, d: s.read.parquet(f"{d}/documents.parquet")

_query("recode_read", lambda s, d: _docs(s, d).select("doc_id", dna.recode_read(F.col("text")).alias("seq")), "SELECT doc_id, regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^ACGT]', 'N', 'g') AS seq FROM documents")
_query("recode_ref", lambda s, d: _docs(s, d).select("doc_id", dna.recode_reference(F.col("text")).alias("seq")), "SELECT doc_id, regexp_replace(replace(regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^ACGTURYSWKMBDHVN]', '', 'g'), 'U', 'T'), '[^ACGT]', 'N', 'g') AS seq FROM documents")
_query("ambiguity_test", lambda s, d: _docs(s, d).select("doc_id", dna.is_ambiguous(F.col("text")).alias("ambiguous")), "SELECT doc_id, regexp_matches(text, '[^ACGTacgt]') AS ambiguous FROM documents")
_query("reverse_complement", lambda s, d: fixtures.tiles(s, d).select("read_ord", dna.reverse_complement(F.col("seq")).alias("rc"), dna.complement(F.col("seq")).alias("comp")), f"WITH {_TILES} SELECT read_ord, {_rc('seq')} AS rc, translate(seq, 'ACGT', 'TGCA') AS comp FROM tiles")
_query("two_bit_digits", lambda s, d: fixtures.refs(s, d).select("ref_ord", dna.to_digits(F.col("seq")).alias("digits"), dna.from_digits(dna.to_digits(F.col("seq"))).alias("back")), f"WITH {_REFS} SELECT ref_ord, translate(seq, 'ACGT', '0123') AS digits, seq AS back FROM refs")
_query("letters", lambda s, d: fixtures.refs(s, d).select("ref_ord", dna.letter_at(F.col("seq"), F.lit(10)).alias("letter"), dna.with_letter(F.col("seq"), F.lit(10), F.lit("N")).alias("masked")), f"WITH {_REFS} SELECT ref_ord, substr(seq, 11, 1) AS letter, substr(seq, 1, 10) || 'N' || substr(seq, 12) AS masked FROM refs")
_query("kmer_encode21", lambda s, d: kmers.kmers(fixtures.refs(s, d).select("ref_ord", "seq")), f"WITH {_REFS}, {_kmers('k', 'refs', 'ref_ord')} SELECT ref_ord, pos, {_code('kmer')} AS kmer FROM k")
_query("kmer_encode16", lambda s, d: kmers.kmers(fixtures.refs(s, d).select("ref_ord", "seq"), k=16), f"WITH {_REFS}, {_kmers('k', 'refs', 'ref_ord', 16)} SELECT ref_ord, pos, {_code('kmer', 16)} AS kmer FROM k")
_query("kmer_parts", lambda s, d: kmers.kmers(fixtures.shots(s, d).select("read_ord", "seq")).select("read_ord", "pos", dna.anchor_of(F.col("kmer")).alias("anchor"), dna.word_of(F.col("kmer")).alias("word"), F.bit_count("kmer").alias("bits"), dna.trailing_zeros(F.col("kmer") + 1).alias("zeros")), f"WITH {_SHOT_BASE}, {_kmers('k', 'shots', 'read_ord')}, c AS (SELECT read_ord, pos, {_code('kmer')} AS k FROM k) SELECT read_ord, pos, k >> 24 AS anchor, k & 16777215 AS word, bit_count(k)::INT AS bits, strpos(reverse(bin(k + 1)), '1') - 1 AS zeros FROM c")
_query("exact_prefix", lambda s, d: fixtures.pairs(s, d).select("read_ord", dna.exact_prefix(F.col("mate1"), F.col("mate2")).alias("n")), f"WITH {_SHOT_BASE}, {_PAIRS} SELECT read_ord, (SELECT count(*) FROM range(1, least(length(mate1), length(mate2)) + 1) t(i) WHERE substr(mate1, 1, i::INT) = substr(mate2, 1, i::INT) AND substr(mate1, 1, i::INT) NOT LIKE '%N%')::INT AS n FROM pairs")
_query("mate_id_combine", lambda s, d: fixtures.pairs(s, d).select("read_ord", dna.combine_ids(F.col("id1"), F.col("id2")).alias("id"), dna.combine_ids(F.col("id1"), F.col("id1")).alias("same"), dna.combine_ids(F.col("id2"), F.col("id1")).alias("swapped")), f"WITH {_SHOT_BASE}, {_PAIRS} SELECT read_ord, 'r' || read_ord AS id, id1 AS same, NULL::VARCHAR AS swapped FROM pairs")
_query("defline_id", lambda s, d: _docs(s, d).select("doc_id", dna.defline_id(F.concat(F.lit(">"), F.col("text"))).alias("id"), dna.is_gzip(F.concat("source", F.lit(".gz"))).alias("gz")), "SELECT doc_id, regexp_extract('>' || text, '^[>@]([^ \\t]*)', 1) AS id, length(source || '.gz') > 3 AS gz FROM documents")

_query("bit_runs", lambda s, d: kmers.kmers(fixtures.shots(s, d).select("read_ord", "seq")).select("read_ord", "pos", dna.trailing_zeros(F.col("kmer")).alias("clear"), dna.trailing_ones(F.col("kmer")).alias("set"), dna.bit_field(F.col("kmer"), 4, 20).alias("field")), f"WITH {_SHOT_BASE}, {_kmers('k', 'shots', 'read_ord')}, c AS (SELECT read_ord, pos, {_code('kmer')} AS k FROM k) SELECT read_ord, pos, CASE WHEN k = 0 THEN 64 ELSE strpos(reverse(bin(k)), '1') - 1 END AS clear, strpos(reverse(bin(k)) || '0', '0') - 1 AS set, (k >> 4) & 65535 AS field FROM c")
_query("strand_codes", lambda s, d: _mates(s, d).select("read_ord", "mate", dna.strand_of(F.when(F.col("mate") == 0, "+").otherwise("-")).alias("strand"), dna.code_of(F.col("mate")).alias("code"), dna.index_of(dna.code_of(F.col("mate"))).alias("back")), f"WITH {_PAIR_BASE} SELECT read_ord, mate, mate + 1 AS strand, mate + 1 AS code, mate AS back FROM mates")
_query("exact_prefix_reverse", lambda s, d: fixtures.shots(s, d).select("read_ord", dna.exact_prefix_reverse(F.col("seq"), F.concat(F.lit("T"), dna.reverse_complement(F.substring("seq", 1, 40)))).alias("n")), f"WITH {_SHOT_BASE} SELECT read_ord, (SELECT count(*) FROM range(1, least(length(seq), 41) + 1) t(i) WHERE substr(seq, 1, i::INT) = substr(substr(seq, 1, 40) || 'A', 1, i::INT) AND substr(seq, 1, i::INT) NOT LIKE '%N%')::INT AS n FROM shots")
_query("poly_a_tail", lambda s, d: fixtures.shots(s, d).select("read_ord", dna.poly_a_tail(F.concat("seq", F.lit("AAACAAAANAACAA")), 10, 0.6).alias("tail"), dna.poly_a_tail(F.col("seq"), 12, 0.3).alias("plain")), f"""WITH {_SHOT_BASE}, t AS (SELECT read_ord, 1 AS kind, reverse(seq || 'AAACAAAANAACAA') AS s, 10 AS least, 0.6::FLOAT AS r FROM shots UNION ALL SELECT read_ord, 2, reverse(seq), 12, 0.3::FLOAT FROM shots),
l AS (SELECT read_ord, kind, least, i, (length(substr(s, 1, i::INT)) - length(replace(substr(s, 1, i::INT), 'A', '')))::FLOAT >= i::FLOAT * r AS rich FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM t)),
m AS (SELECT read_ord, kind, least, max(CASE WHEN rich AND i <= least THEN i END) AS short, min(CASE WHEN NOT rich AND i >= least THEN i END) AS stop, max(i) AS n FROM l GROUP BY ALL),
a AS (SELECT read_ord, kind, CASE WHEN coalesce(stop, n + 1) > least THEN coalesce(stop, n + 1) - 1 ELSE coalesce(short, 0) END::INT AS tail FROM m)
SELECT x.read_ord, x.tail, y.tail AS plain FROM a x JOIN a y ON x.read_ord = y.read_ord AND x.kind = 1 AND y.kind = 2""")
_query("intron_penalty", lambda s, d: fixtures.refs(s, d).select("ref_ord", F.round(dna.intron_penalty(0.5, 0.001, F.length("seq"), F.col("ref_ord")), 6).alias("penalty")), f"WITH {_REFS} SELECT ref_ord, round(ref_ord * 0.5::DOUBLE * (exp(length(seq) * 0.001::DOUBLE) - 1), 6) AS penalty FROM refs")

# --------------------------------------------------------------------- ingest

_query("read_slice", lambda s, d: ingest.read_slice(fixtures.shots(s, d), 2000, 15000).select("read_ord", "seq"), f"WITH {_SHOT_BASE} SELECT read_ord, seq FROM shots WHERE read_ord BETWEEN 2000 AND 15000")
_query("length_filter", lambda s, d: ingest.length_filter(_docs(s, d).select(F.col("doc_id").alias("read_ord"), dna.text_to_dna(F.col("text")).alias("seq")), 10_000).select("read_ord", F.length("seq").alias("len")), f"SELECT doc_id AS read_ord, length({_dna('text')}) AS len FROM documents WHERE length({_dna('text')}) < 10000")
_query("mask_filter", lambda s, d: kmers.kmers(fixtures.tiles(s, d).select("read_ord", "seq")).groupBy("read_ord").agg(F.count(F.lit(1)).alias("n")), f"WITH {_TILES}, {_kmers('k', 'tiles', 'read_ord')} SELECT read_ord, count(*) AS n FROM k GROUP BY read_ord")


def _records(s: SparkSession, d: str) -> DataFrame:
    mates = F.array(F.struct(F.lit(0).alias("m"), F.col("id1").alias("read_id"), F.col("mate1").alias("seq")), F.struct(F.lit(1).alias("m"), F.col("id2").alias("read_id"), F.col("mate2").alias("seq")))
    return fixtures.pairs(s, d).select("read_ord", F.inline(mates)).select((F.col("read_ord") * 2 + F.col("m")).alias("read_ord"), "read_id", "seq")


_query("interleave_pairs", lambda s, d: ingest.interleaved_pairs(_records(s, d)), f"WITH {_SHOT_BASE}, {_PAIRS} SELECT read_ord, 'r' || read_ord AS read_id, mate1, mate2 FROM pairs")
_query("zip_pairs", lambda s, d: ingest.zip_pairs(*(fixtures.pairs(s, d).select("read_ord", F.col(f"id{k}").alias("read_id"), F.col(f"mate{k}").alias("seq")) for k in (1, 2))), f"WITH {_SHOT_BASE}, {_PAIRS} SELECT read_ord, 'r' || read_ord AS read_id, mate1, mate2 FROM pairs")
_query("spot_pairs", lambda s, d: ingest.spot_reads(fixtures.spots(s, d)), f"WITH {_SHOT_BASE}, {_PAIRS} SELECT read_ord, 'ACC1.' || (read_ord + 1) AS read_id, mate1, CASE WHEN read_ord % 3 = 1 THEN mate2 END AS mate2 FROM pairs")
_query("input_counters", lambda s, d: ingest.counters(_mates(s, d)), f"WITH {_PAIR_BASE} SELECT count(DISTINCT read_ord) AS n_reads, count(DISTINCT read_ord) AS n_pairs, count(*) AS n_mates, sum(length(seq))::BIGINT AS n_bases, sum(length(seq) - length(replace(seq, 'N', '')))::BIGINT AS n_masked, 0::BIGINT AS n_skipped FROM mates")


_query("duplicate_ids", lambda s, d: ingest.duplicate_ids(fixtures.shots(s, d).withColumn("read_id", F.concat(F.lit("d"), F.floor(F.col("read_ord") / 3).cast("string")))), f"WITH {_SHOT_BASE} SELECT 'd' || (read_ord // 3) AS read_id, count(*) AS reads FROM shots GROUP BY 1 HAVING count(*) > 1")
_query("failed_spots", lambda s, d: ingest.failed_spots(fixtures.broken_spots(s, d)), f"WITH {_SHOT_BASE}, {_PAIRS} SELECT count(*) FILTER (read_ord % 8 IN (4, 6)) AS failed FROM pairs")


def _accession(s: SparkSession, d: str) -> DataFrame:
    folder = fixtures.folder(s, "accessions")
    fixtures.broken_spots(s, d).write.parquet(f"{folder}/ACC1.parquet")
    accessions.register("ACC", accessions.tables(folder))
    return reads.open_reads(s, ["ACC1"], "sra")


_query("accession_scan", _accession, f"WITH {_SHOT_BASE}, {_PAIRS}, good AS (SELECT * FROM pairs WHERE read_ord % 8 NOT IN (4, 6)) SELECT read_ord, 'ACC1.' || (read_ord + 1) AS read_id, 0 AS mate, mate1 AS seq FROM good UNION ALL SELECT read_ord, 'ACC1.' || (read_ord + 1), 1, mate2 FROM good WHERE read_ord % 3 = 1")

# ---------------------------------------------------------------------- files


def _shot_files(s: SparkSession, d: str, form: Callable, label: str, **options) -> list[str]:
    return fixtures.text_files(fixtures.shots(s, d), "read_ord", form(F.col("read_id"), F.col("seq")), label, **options)


def _mate_files(s: SparkSession, d: str) -> DataFrame:
    one, two = (read_fastx(s, fixtures.text_files(fixtures.pairs(s, d), "read_ord", fixtures.fasta(F.col(f"id{k}"), F.col(f"mate{k}")), f"mates{k}")) for k in (1, 2))
    return ingest.zip_pairs(one, two).select("read_id", "mate1", "mate2")


def _reference_file(s: SparkSession, d: str) -> DataFrame:
    record = F.concat(F.lit("# a comment\n"), fixtures.fasta(F.col("ref_id"), F.lower("seq")), F.lit("\n-*"))
    return reads.open_references(s, fixtures.text_files(fixtures.refs(s, d), "ref_ord", record, "references")).select("ref_id", "seq")


_read_rows = f"WITH {_SHOT_BASE} SELECT read_id, seq FROM shots"
_query("fasta_scan", lambda s, d: read_fastx(s, _shot_files(s, d, fixtures.fasta, "fasta")).select("read_id", "seq"), _read_rows)
_query("fastq_scan", lambda s, d: read_fastx(s, _shot_files(s, d, fixtures.fastq, "fastq"), "fastq").select("read_id", "seq"), _read_rows)
_query("gzip_scan", lambda s, d: read_fastx(s, _shot_files(s, d, fixtures.fastq, "zfastq", compression="gzip"), "zfastq").select("read_id", "seq"), _read_rows)
_query("mate_files", _mate_files, f"WITH {_SHOT_BASE}, {_PAIRS} SELECT 'r' || read_ord AS read_id, mate1, mate2 FROM pairs")
_query("reference_scan", _reference_file, f"WITH {_REFS} SELECT ref_id, seq FROM refs")


def _mates(s: SparkSession, d: str) -> DataFrame:
    p = fixtures.pairs(s, d)
    return ingest.to_mates(p.select("read_ord", dna.combine_ids(F.col("id1"), F.col("id2")).alias("read_id"), "mate1", "mate2"))


# ------------------------------------------------------------------ references

_counts = f"{_REFS}, {_REPEATS}, {_kmers('k', 'reps', 'ref_ord')}, counts AS (SELECT kmer, count(*) AS n FROM k GROUP BY kmer)"
_bin = "CASE WHEN n > 1 THEN length(bin(n - 1)) ELSE 0 END"
_hist = f"{_counts}, hist AS (SELECT {_bin} AS bin, count(*) AS words FROM counts GROUP BY 1)"
_cut = f"{_hist}, above AS (SELECT bin, sum(words) OVER (ORDER BY bin DESC) AS s FROM hist), cut AS (SELECT coalesce(max(bin) FILTER (s > {CUTOFF_LIMIT}), 0)::INT AS cutoff FROM above), freq AS (SELECT kmer, {_bin} AS bin FROM counts, cut WHERE {_bin} > cutoff)"


def _repeat_counts(s: SparkSession, d: str) -> DataFrame:
    return refdb.seed_counts(fixtures.repeats(s, d))


def _cutoff(s: SparkSession, d: str) -> DataFrame:
    return refdb.frequency_cutoff(refdb.frequency_histogram(_repeat_counts(s, d)), CUTOFF_LIMIT)


def _table(s: SparkSession, d: str) -> DataFrame:
    return refdb.frequency_table(_repeat_counts(s, d), _cutoff(s, d))


_query("ref_stats", lambda s, d: refdb.reference_stats(fixtures.refs(s, d)), f"WITH {_REFS} SELECT count(*) AS n_refs, sum(length(seq))::BIGINT AS total_len, min(length(seq)) AS min_len, max(length(seq)) AS max_len FROM refs")
_query("ref_offsets", lambda s, d: kmers.prefix_offsets(fixtures.refs(s, d)), f"WITH {_REFS} SELECT ref_ord, length(seq) AS len, (sum(length(seq)) OVER (ORDER BY ref_ord) - length(seq))::BIGINT AS abs_offset FROM refs")
_query("ref_kmers", lambda s, d: kmers.reference_seeds(fixtures.refs(s, d)), f"WITH {_REFS}, {_kmers('k', 'refs', 'ref_ord', position='refpos')} SELECT ref_ord, refpos, 0 AS strand, {_code('kmer')} AS kmer FROM k UNION ALL SELECT ref_ord, refpos, 1, {_code(_rc('kmer'))} FROM k")
_query("read_kmers", lambda s, d: kmers.kmers(fixtures.shots(s, d).select("read_ord", "mate", "seq"), position="readpos"), f"WITH {_SHOT_BASE}, {_kmers('k', 'shots', 'read_ord, mate', position='readpos')} SELECT read_ord, mate, readpos, {_code('kmer')} AS kmer FROM k")
_query("anchor_histogram", lambda s, d: refdb.anchor_histogram(kmers.kmers(fixtures.refs(s, d).select("ref_ord", "seq"))), f"WITH {_REFS}, {_kmers('k', 'refs', 'ref_ord')}, a AS (SELECT {_code('kmer')} >> 24 AS anchor, count(*) AS n FROM k GROUP BY 1) SELECT anchor, n, (sum(n) OVER (ORDER BY anchor) - n)::BIGINT AS first FROM a")
_query("repeat_summary", lambda s, d: refdb.repeat_summary(_repeat_counts(s, d)), f"WITH {_counts} SELECT count(*) AS n_words, count(*) FILTER (n > 16) AS repeat_words, sum(n) FILTER (n > 16)::BIGINT AS repeat_positions, count(*) FILTER (n > 128) AS exact_words, sum(n) FILTER (n > 128)::BIGINT AS exact_positions FROM counts")
_query("freq_histogram", lambda s, d: refdb.frequency_histogram(_repeat_counts(s, d)), f"WITH {_hist} SELECT bin, words FROM hist")
_query("freq_cutoff", _cutoff, f"WITH {_cut} SELECT cutoff FROM cut")
_query("freq_table", _table, f"WITH {_cut} SELECT {_code('kmer')} AS kmer, bin FROM freq")
_query("word_set16", lambda s, d: refdb.screening_words(fixtures.refs(s, d)), f"WITH {_REFS}, {_kmers('k', 'refs', 'ref_ord', 16)} SELECT {_code('kmer', 16)} AS word FROM k UNION SELECT {_code(_rc('kmer'), 16)} FROM k")
_query("word_bitmap_counts", lambda s, d: refdb.word_bitmaps(refdb.screening_words(fixtures.refs(s, d))).select("bucket", F.expr("bitmap_count(bitmap)").alias("words")), f"WITH {_REFS}, {_kmers('k', 'refs', 'ref_ord', 16)}, w AS (SELECT {_code('kmer', 16)} AS word FROM k UNION SELECT {_code(_rc('kmer'), 16)} FROM k) SELECT CASE WHEN word > 0 THEN 1 + (word - 1) // 32768 ELSE word // 32768 END AS bucket, count(*) AS words FROM w GROUP BY 1")

_query("read_anchor_histogram", lambda s, d: refdb.anchor_histogram(kmers.kmers(fixtures.tiles(s, d).select("read_ord", "seq"))), f"WITH {_TILES}, {_kmers('k', 'tiles', 'read_ord')}, a AS (SELECT {_code('right(kmer, 9)', 9)} AS anchor, count(*) AS n FROM k GROUP BY right(kmer, 9)) SELECT anchor, n, (sum(n) OVER (ORDER BY anchor) - n)::BIGINT AS first FROM a")
_query("reference_memory", lambda s, d: refdb.memory_use(fixtures.refs(s, d), kmers.reference_seeds(fixtures.refs(s, d))), f"WITH {_REFS}, {_kmers('k', 'refs', 'ref_ord')} SELECT (SELECT sum((length(seq) + 3) // 4)::BIGINT FROM refs) AS seq_bytes, (SELECT sum((length(seq) + 7) // 8)::BIGINT FROM refs) AS mask_bytes, (SELECT count(*) * 16 FROM k) AS index_bytes")


def _database(s: SparkSession, d: str, prescreen: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """A database written and opened again."""
    path = fixtures.folder(s, "database")
    refdb.build_db(fixtures.refs(s, d), path, index=True, word_set=prescreen)
    return refdb.open_db(s, path, prescreen)


_query("database_refs", lambda s, d: _database(s, d)[0], f"WITH {_REFS} SELECT ref_ord, ref_id, seq FROM refs")
_query("database_index", lambda s, d: _database(s, d)[1], ORACLES["ref_kmers"])
_query("database_words", lambda s, d: _database(s, d, True)[2], ORACLES["word_set16"])

# ------------------------------------------------------------------- screening

_words = f"{_kmers('w0', 'refs', 'ref_ord', 16)}, words AS (SELECT kmer AS word FROM w0 UNION SELECT {_rc('kmer')} FROM w0)"


def _screen(reads: str) -> str:
    return f"""{_words}, {_kmers('s0', reads, 'read_ord, mate', 16)}, s1 AS (SELECT * FROM s0 SEMI JOIN words ON s0.kmer = words.word),
s2 AS (SELECT *, pos - row_number() OVER (PARTITION BY read_ord, mate ORDER BY pos) AS run FROM s1),
s3 AS (SELECT DISTINCT read_ord, mate FROM (SELECT read_ord, mate, run FROM s2 GROUP BY ALL HAVING count(*) >= 6)),
screened AS (SELECT m.read_ord, m.read_id, m.mate, CASE WHEN s3.read_ord IS NULL THEN '' ELSE m.seq END AS seq FROM {reads} m LEFT JOIN s3 ON m.read_ord = s3.read_ord AND m.mate = s3.mate)"""


def _prescreened(s: SparkSession, d: str, reads: DataFrame) -> DataFrame:
    return seeds.prescreen(reads, refdb.screening_words(fixtures.refs(s, d)))


_query("prescreen", lambda s, d: _prescreened(s, d, fixtures.tiles(s, d)).select("read_ord", "mate", "seq"), f"WITH {_REFS}, {_TILES}, {_screen('tiles')} SELECT read_ord, mate, seq FROM screened")

_query("screened_mates", lambda s, d: ingest.screened_mates(_mates(s, d), _prescreened(s, d, _mates(s, d).withColumn("seq", F.when(F.col("read_ord") % 4 == 0, dna.reverse_complement(F.reverse("seq"))).otherwise(F.col("seq"))))), f"WITH {_PAIR_BASE}, turned AS (SELECT read_ord, read_id, mate, CASE WHEN read_ord % 4 = 0 THEN translate(seq, 'ACGT', 'TGCA') ELSE seq END AS seq FROM mates), {_screen('turned')} SELECT (SELECT count(*) FROM mates WHERE length(seq) > 0) - (SELECT count(*) FROM screened WHERE length(seq) > 0) AS n_screened")

# ---------------------------------------------------------------------- search


def _shot_hits(s: SparkSession, d: str) -> DataFrame:
    return seeds.seed_hits(fixtures.shots(s, d), kmers.reference_seeds(fixtures.refs(s, d)))


def _mate_hits(s: SparkSession, d: str) -> DataFrame:
    return seeds.seed_hits(_mates(s, d), kmers.reference_seeds(fixtures.refs(s, d)))


_HITS = f"{_SHOT_BASE}, {_hits('shots')}"
_MATE_HITS = f"{_PAIR_BASE}, {_hits('mates')}"
_query("seed_hits", _shot_hits, f"WITH {_HITS} SELECT read_ord, mate, strand, ref_ord, readpos, refpos, len, diag FROM hits")
_query("hit_count_by_strand", lambda s, d: seeds.seed_hits(fixtures.tiles(s, d), kmers.reference_seeds(fixtures.refs(s, d))).groupBy("strand").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("read_ord").alias("reads")), f"WITH {_REFS}, {_TILES}, {_hits('tiles')} SELECT strand, count(*) AS hits, count(DISTINCT read_ord) AS reads FROM hits GROUP BY strand")
_query("diagonals", lambda s, d: _shot_hits(s, d).groupBy("read_ord", "mate", "strand", "ref_ord", "diag").agg(F.count(F.lit(1)).alias("n")), f"WITH {_HITS} SELECT {_G}, diag, count(*) AS n FROM hits GROUP BY ALL")
_query("exact_runs", lambda s, d: marking.exact_runs(_shot_hits(s, d)), f"WITH {_HITS}, {_RUNS} SELECT {_G}, diag, run_start, max(readpos) + 21 AS run_end, max(readpos) + 21 - run_start AS run_len FROM runrows GROUP BY {_G}, diag, run_start")
_query("band_coverage", lambda s, d: marking.band_coverage(_shot_hits(s, d), 4), f"WITH {_HITS}, {_bands(4)} SELECT {_G}, len, diag, bases FROM bands")
_query("interval_union", lambda s, d: marking.band_coverage(_shot_hits(s, d), 0).groupBy("read_ord").agg(F.max("bases").alias("bases")), f"WITH {_HITS}, {_bands(0)} SELECT read_ord, max(bases) AS bases FROM bands GROUP BY read_ord")

for _name, _params in {
    "mark_reads_default": SearchParams(),
    "mark_reads_cont": SearchParams(continuous_bases=60),
    "mark_reads_bases": SearchParams(covered_bases=80, coverage_ratio=0.6),
    "mark_reads_strict": SearchParams(continuous_bases=40, covered_bases=70, coverage_ratio=0.9, max_diag_delta=0),
    "mark_reads_degenerate": SearchParams(coverage_ratio=0.0),
}.items():
    _query(_name, lambda s, d, p=_params: marking.mark(_shot_hits(s, d), p), f"WITH {_HITS}, {_marks(_params)} SELECT * FROM marks")
for _name, _params in {"mark_pairs": SearchParams(coverage_ratio=0.95), "mark_mates": SearchParams(coverage_ratio=0.95, per_mate=True)}.items():
    _query(_name, lambda s, d, p=_params: marking.mark(_mate_hits(s, d), p), f"WITH {_MATE_HITS}, {_marks(_params)} SELECT * FROM marks")
_query("mark_reads_documents", lambda s, d: marking.mark(seeds.seed_hits(fixtures.tiles(s, d), kmers.reference_seeds(fixtures.refs(s, d)))), f"WITH {_REFS}, {_TILES}, {_hits('tiles')}, {_marks(SearchParams())} SELECT * FROM marks")

# --------------------------------------------------------------------- reports


def _report_sql(table: str, per_mate: bool) -> str:
    on = "m.read_ord = k.read_ord" + (" AND m.mate = k.mate" if per_mate else "")
    ratio = "CASE WHEN covered_bases = 0 THEN '0' ELSE regexp_replace(regexp_replace(CASE WHEN q >= 1 THEN printf('%.5f', q) WHEN q >= 0.1 THEN printf('%.6f', q) ELSE printf('%.7f', q) END, '0+$', ''), '\\.$', '') END"
    return f"""SELECT read_ord, mate, '>' || read_id || CASE WHEN paired THEN '.' || (mate + 1) ELSE '' END || ' ' || {ratio} || ' ' || covered_bases AS header, seq FROM
(SELECT m.read_ord, m.mate, m.read_id, m.seq, k.covered_bases, (k.covered_bases::FLOAT / k.len::FLOAT)::DOUBLE AS q, max(m.mate) OVER (PARTITION BY m.read_ord) > 0 AS paired FROM {table} m JOIN marks k ON {on}) WHERE length(seq) > 0"""


def _report(s: SparkSession, d: str, reads: DataFrame, params: SearchParams) -> DataFrame:
    marks = marking.mark(seeds.seed_hits(reads, kmers.reference_seeds(fixtures.refs(s, d))), params)
    return report.report(reads, marks, params.per_mate)


_query("report_reads", lambda s, d: _report(s, d, fixtures.shots(s, d), SearchParams()), f"WITH {_HITS}, {_marks(SearchParams())} {_report_sql('shots', False)}")
_query("report_pairs", lambda s, d: _report(s, d, _mates(s, d), SearchParams()), f"WITH {_MATE_HITS}, {_marks(SearchParams())} {_report_sql('mates', False)}")
_query("report_mates", lambda s, d: _report(s, d, _mates(s, d), SearchParams(per_mate=True)), f"WITH {_MATE_HITS}, {_marks(SearchParams(per_mate=True))} {_report_sql('mates', False).replace('m.read_ord = k.read_ord', 'm.read_ord = k.read_ord AND m.mate = k.mate')}")
_query("prescreened_report", lambda s, d: _report(s, d, _prescreened(s, d, _mates(s, d)), SearchParams()), f"WITH {_PAIR_BASE}, {_screen('mates')}, {_hits('screened')}, {_marks(SearchParams())} {_report_sql('screened', False)}")
_query("run_summary", lambda s, d: report.run_summary(fixtures.shots(s, d), marking.mark(_shot_hits(s, d), SearchParams(coverage_ratio=0.95)), ingest.failed_spots(fixtures.broken_spots(s, d))), f"WITH {_HITS}, {_marks(SearchParams(coverage_ratio=0.95))} SELECT (SELECT count(*) FROM shots) AS total_reads, (SELECT count(*) FILTER (read_ord % 8 IN (4, 6)) FROM (SELECT a.read_ord FROM shots a JOIN shots b ON a.read_ord % 2 = 0 AND b.read_ord = a.read_ord + 1)) AS failed_reads, (SELECT count(*) FROM marks) AS mapped")


def _stream(s: SparkSession, d: str) -> DataFrame:
    """The reads as a stream of files, a file a batch."""
    path = fixtures.folder(s, "stream")
    fixtures.shots(s, d).repartition(3, "read_ord").write.parquet(f"{path}/in")
    given = s.readStream.schema("read_ord bigint, read_id string, mate int, seq string").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    search_stream(given, fixtures.refs(s, d), f"{path}/out", f"{path}/checkpoint", availableNow=True).awaitTermination()
    return s.read.parquet(f"{path}/out").select("read_ord", "mate", "header", "seq")


def _in_batches(s: SparkSession, d: str, dealt: DataFrame) -> DataFrame:
    refs = fixtures.refs(s, d)
    found = [marks for _, marks, _ in search_.search_batches(fixtures.shots(s, d), dealt, refs, seeds=kmers.reference_seeds(refs).persist())]
    return functools.reduce(DataFrame.unionByName, found)


_query("stream_report", _stream, ORACLES["report_reads"])
_query("batches_by_count", lambda s, d: _in_batches(s, d, search_.count_batches(fixtures.shots(s, d), 15_000)), ORACLES["mark_reads_default"])
_query("batches_by_memory", lambda s, d: _in_batches(s, d, batches.memory_batches(fixtures.shots(s, d), fixtures.refs(s, d), 2_000_000)), ORACLES["mark_reads_default"])

# -------------------------------------------------------------------- planning

_bound = f"""{_cut}, {_CUTS}, {_SHOTS}, {_kmers('f', 'shots', 'read_ord')}, b AS (SELECT read_ord, kmer FROM f UNION ALL SELECT read_ord, {_rc('kmer')} FROM f),
bound AS (SELECT read_ord, sum(1::BIGINT << coalesce(bin, cutoff)::INT)::BIGINT AS hits FROM b LEFT JOIN freq ON b.kmer = freq.kmer, cut GROUP BY read_ord)"""
_query("hit_upper_bound", lambda s, d: batches.hit_upper_bound(fixtures.shots(s, d), _table(s, d), _cutoff(s, d)), f"WITH {_bound} SELECT read_ord, hits FROM bound")
_query(
    "batch_plan",
    lambda s, d: batches.batch_plan(fixtures.shots(s, d), batches.hit_upper_bound(fixtures.shots(s, d), _table(s, d), _cutoff(s, d)), BATCH_BYTES),
    f"""WITH RECURSIVE {_bound}, costs AS (SELECT read_ord, coalesce(hits, 0) * 12 + length(seq) * 24 AS bytes, row_number() OVER (ORDER BY read_ord) AS i FROM shots LEFT JOIN bound USING (read_ord)),
walk AS (SELECT i, read_ord, bytes, bytes AS used, 0::BIGINT AS batch FROM costs WHERE i = 1 UNION ALL
  SELECT c.i, c.read_ord, c.bytes, CASE WHEN w.used + c.bytes > {BATCH_BYTES} THEN c.bytes ELSE w.used + c.bytes END, w.batch + (w.used + c.bytes > {BATCH_BYTES})::BIGINT FROM walk w JOIN costs c ON c.i = w.i + 1)
SELECT read_ord, bytes::BIGINT AS bytes, batch FROM walk""",
)
