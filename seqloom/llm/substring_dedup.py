"""Substring dedup by de Bruijn compaction over token k-mers.

Every ``window`` consecutive tokens of a document are an edge of the de Bruijn
graph (its nodes are the tokens but the first, and but the last).  Only paths of
edges that occur again matter.

* Fragments (see ``_repeats``) are stretches of edges that share an anchor.  An
  anchor whose occurrences all carry one content has no branch: the stretch is
  compacted into one edge, which travels and is settled as one row.
* Where contents differ (the graph branches), the stretch is expanded into its
  single edges by a join with the texts; these meet by a 128-bit hash.
* Every later place carries its source, an earlier place of the same path.  A join of
  each piece with the one before it finds the nodes that do not branch: both go on in
  the place as in its source.  Pieces with such a node between them are one path.
* The long spans are verified at both coordinates: joins with the texts and of both
  ends give a 128-bit digest of the words themselves (BLAKE2b) at the place and at the
  source, and only spans with equal digests are removed.  A path's first place stays.

Candidates meet by 64-bit hashes (a stretch by its anchor's and its content's); what is
removed was equal word for word, up to collisions of the digest.  Results do not depend
on partitions, batches or retries.

Defined cases: null and empty texts have no words and come back unchanged (null
text as empty in the digest); null doc_ids sort before all others; rows repeated
with one id and one text count as one place and get equal results, other texts
under the same id are documents of their own (ties by a hash of the text); an
empty table gives an empty result; columns beyond id and text are not read.
Memory grows with the longest single text, not with a group of copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _repeats
from ._common import _FIRST, _SECOND, arrow_map, chunks, column, keyed, keyed_rows, mix, prefix_sums, rewrite, span_hash, stage, table, text_bytes, tidy, word_hashes, words

WINDOW = 20
GRAM = 8


def _fragments(window: int, gram: int):
    def extract(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
        for part in chunks(batch):
            raw, offsets = text_bytes(part.column(part.schema.get_field_index("text")))
            starts, ends, bounds = words(raw, offsets)
            if len(starts) < window:
                continue
            items = word_hashes(raw, starts, ends)
            got = _repeats.fragments_of(items, _repeats.gram_hashes(items, gram), bounds, window, gram)
            seq = got.pop("seq")
            yield got | {"_did": column(part, "_did")[seq], "_key": column(part, "_key")[seq]}

    return extract


EDGES = "first long, second long, _did long, _key long, start int"


def _edges(window: int):
    """Open fragments of texts as single edges, one row for each of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                raw, offsets = text_bytes(part.column(part.schema.get_field_index("text")))
                starts, ends, bounds = words(raw, offsets)
                items = word_hashes(raw, starts, ends)
                spans = part.column(part.schema.get_field_index("spans"))
                flat = spans.flatten()
                row = np.repeat(np.arange(part.num_rows), np.diff(spans.offsets.to_numpy()))
                at, n = (flat.field(k).to_numpy() for k in (0, 1))
                first = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row = np.repeat(row, n)
                edge = bounds[row] + first
                h1 = mix(span_hash(prefix_sums(items, _FIRST), edge, edge + window, _FIRST))
                h2 = mix(span_hash(prefix_sums(items, _SECOND), edge, edge + window, _SECOND))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(column(part, "_did")[row]), pa.array(column(part, "_key")[row]), pa.array(first.astype(np.int32))],
                    names=["first", "second", "_did", "_key", "start"],
                )

    return run


TEXT = ["_did", "_key"]
PLACES = [*TEXT, "start", "n", "sdid", "skey", "sstart"]


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges sorted by hash and place: all but those at the first place, with it."""
    head = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, did, key, start = (column(batch, k) for k in ("first", "second", "_did", "_key", "start"))
        n = len(h1)
        new = np.ones(n, bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if head is not None:
            new[0] = (h1[0], h2[0]) != head[:2]
        at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        same = [np.where(at >= 0, v[at], 0) for v in (did, key, start)]
        if head is not None:
            same = [np.where(at >= 0, v, h) for v, h in zip(same, head[2:])]
        later = ~((did == same[0]) & (key == same[1]) & (start == same[2]))
        i = at[-1]
        if i >= 0:
            head = (h1[i], h2[i], did[i], key[i], start[i])
        if later.any():
            columns = [did[later], key[later], start[later], np.ones(later.sum(), np.int32), *(v[later].astype(x.dtype) for v, x in zip(same, (did, key, start)))]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=PLACES)


@tidy
def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(_did, _key, start, n): windows of ``keyed`` docs that started earlier."""
    known = _repeats.verdicts(docs, _fragments(window, gram), False, "debruijn", traced=True)
    branching = _repeats.spans_by_text(known.filter("open and not copy").select("_did", "_key", "start", "n"))
    joined = docs.select("_did", "_key", "text").join(branching, ["_did", "_key"])
    edges = arrow_map(joined, _edges(window), EDGES).repartition("first").sortWithinPartitions("first", "second", "_did", "_key", "start")
    later = arrow_map(edges, _later, "_did long, _key long, start int, n int, sdid long, skey long, sstart int")
    found = known.filter("copy").select(*PLACES).unionByName(later)
    return stage(verified(docs, stage(compacted(found), "debruijn-paths"), window), "debruijn-spans")


def compacted(pieces: DataFrame) -> DataFrame:
    """Pieces united to paths.

    A piece that joins the end of another, in the place and in its source alike, goes
    on with its path; any other begins one.  Paths of one place and source lie on one
    diagonal, so a running count of beginnings names them, without a round of joins
    for each doubling of the length.  Pieces that overlap are one path as well.
    """
    line = [*TEXT, "sdid", "skey", "diagonal"]
    ends = pieces.withColumns({"end": F.col("start") + F.col("n"), "diagonal": F.col("start") - F.col("sstart")})
    before = ends.select(*line, F.col("end").alias("start")).distinct().withColumn("goes_on", F.lit(True))
    linked = ends.join(before, [*line, "start"], "left")
    order = Window.partitionBy(*line).orderBy("start", "end")
    numbered = linked.withColumn("path", F.sum(F.col("goes_on").isNull().cast("int")).over(order))
    paths = numbered.groupBy(*line, "path").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("n"), F.min("sstart").alias("sstart"))
    return paths.select(*PLACES)


def _digests(window: int):
    """A digest of the words under each span of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                raw, offsets = text_bytes(part.column(part.schema.get_field_index("text")))
                data = raw.tobytes()
                starts, ends, bounds = words(raw, offsets)
                rows, first, n, digest = [], [], [], []
                for i, spans in enumerate(part.column(part.schema.get_field_index("spans"))):
                    a, b = bounds[i], bounds[i + 1]
                    text = b" ".join([data[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist())])
                    at = np.concatenate([[0], np.cumsum(ends[a:b] - starts[a:b] + 1)]).tolist()
                    for x, count in zip(*(spans.values.field(k).to_pylist() for k in (0, 1))):
                        stop = x + count + window - 1
                        if 0 <= x and stop < len(at):
                            rows.append(i)
                            first.append(x)
                            n.append(count)
                            digest.append(hashlib.blake2b(text[at[x] : at[stop] - 1], digest_size=16).digest())
                took = np.array(rows, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(column(part, "_did")[took]), pa.array(column(part, "_key")[took]), pa.array(first, pa.int32()), pa.array(n, pa.int32()), pa.array(digest, pa.binary())], names=[*TEXT, "start", "n", "digest"])

    return run


def verified(docs: DataFrame, paths: DataFrame, window: int) -> DataFrame:
    """(_did, _key, start, n) of the paths whose words are those of their source."""
    sources = paths.select(F.col("sdid").alias("_did"), F.col("skey").alias("_key"), F.col("sstart").alias("start"), "n")
    asked = _repeats.spans_by_text(paths.select(*TEXT, "start", "n").unionByName(sources).distinct())
    joined = docs.select(*TEXT, "text").join(asked, TEXT)
    told = arrow_map(joined, _digests(window), "_did long, _key long, start int, n int, digest binary")
    told = stage(told.dropDuplicates([*TEXT, "start", "n"]), "debruijn-words")
    source = told.select(F.col("_did").alias("sdid"), F.col("_key").alias("skey"), F.col("start").alias("sstart"), "n", F.col("digest").alias("other"))
    return paths.join(told, [*TEXT, "start", "n"]).join(source, ["sdid", "skey", "sstart", "n"]).filter("digest = other").select(*TEXT, "start", "n")


RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<start:int,stop:int>>, kept string"


def _apply(window: int):
    """Texts with their spans: what is removed (in words), and the kept text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                raw, offsets = text_bytes(part.column(part.schema.get_field_index("text")))
                data = raw.tobytes()
                starts, ends, bounds = words(raw, offsets)
                out: list[tuple] = []
                for i, (doc_id, spans) in enumerate(zip(part.column(part.schema.get_field_index("doc_id")).to_pylist(), part.column(part.schema.get_field_index("spans")))):
                    a, b = bounds[i], bounds[i + 1]
                    s, e = starts[a:b], ends[a:b]
                    gone = np.zeros(b - a, bool)
                    if spans.is_valid and len(spans.values):
                        at, n = (spans.values.field(k).to_numpy() for k in (0, 1))
                        inside = (at >= 0) & (at + n - 1 + window <= b - a)
                        gone = _repeats.covered(b - a, at[inside], n[inside], window)
                    kept = b" ".join(data[x:y] for x, y in zip(s[~gone].tolist(), e[~gone].tolist()))
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                    out.append((doc_id, int(b - a), int(gone.sum()), [{"start": int(x), "stop": int(y)} for x, y in edge.reshape(-1, 2)], kept.decode("utf-8", "replace")))
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.string()))], names=["doc_id", "n_words", "n_removed", "removed", "kept"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, removed word spans, kept.

    A word goes if some window of ``window`` words that covers it also starts
    earlier (smaller id, or same document and earlier start).  ``kept`` is what
    remains, joined by single spaces.
    """
    base = keyed(docs, id_col, text_col)
    spans = _repeats.spans_by_text(repeated_spans(base, window, gram))
    joined = base.join(spans, ["_did", "_key"], "left").select("doc_id", "text", "spans")
    return arrow_map(joined, _apply(window), RESULT)


def cut(text: str, starts: np.ndarray, counts: np.ndarray, window: int) -> str:
    """The text without the words of the windows, and the space behind them."""
    raw = np.frombuffer(text.encode(), np.uint8)
    begins, ends, bounds = words(raw, np.array([0, len(raw)]))
    inside = (starts >= 0) & (starts + counts - 1 + window <= len(begins))
    gone = _repeats.covered(len(begins), starts[inside], counts[inside], window)
    data, out, at = raw.tobytes(), [], 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]))).reshape(-1, 2)
    for a, b in edge.tolist():
        out.append(data[at : begins[a]])
        at = int(begins[b]) if b < len(begins) else len(data)
    return (b"".join(out) + data[at:]).decode()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs``, all rows and columns, with what repeats cut out of the texts.

    A text without repeats is unchanged; one that is cut keeps its other words and
    their spacing, and may become empty.
    """
    rows = keyed_rows(docs, id_col, text_col)
    texts = rows.select(*TEXT, F.coalesce("_text", F.lit("")).alias("text"))
    spans = _repeats.spans_by_text(repeated_spans(texts, window, gram))

    def without(text: str, found: pa.Array) -> str:
        return cut(text, found.field(0).to_numpy(), found.field(1).to_numpy(), window)

    return rewrite(rows.join(spans, ["_did", "_key"], "left"), docs, text_col, "spans", without)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


#: Windows by DuckDB: the words, each window as text, and its first place.
ORACLE = """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
win AS (SELECT doc_id, words, unnest(range(0, len(words) - 19)) AS s FROM w WHERE len(words) >= 20),
keyed AS (SELECT doc_id, s, md5(array_to_string(words[s + 1:s + 20], ' ')) AS k FROM win),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM keyed) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM later),
g AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_filter(words, lambda x, i: g.ps IS NULL OR NOT list_contains(g.ps, i - 1)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id
"""
