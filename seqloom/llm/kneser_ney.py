"""Interpolated modified Kneser-Ney language model over word bigrams.

Counting.  Spark counts words (64-bit hashes, summed within tasks first).  They
become sorted arrays, one shard for each range of hashes; a word's id is its rank.
Bigrams are counted as pairs of ids: a task sums some millions of tokens and sends
one compressed block for each bucket.  A context's bigrams share a bucket, except
those of contexts with more tokens than a bucket should have, which are dealt by
the pair.  Buckets become sorted key arrays with their counts.  From the buckets
Spark sums, for each context, how many followers were seen once, twice, ..., and
for each word after how many contexts it was seen.

Scoring.  Workers map the arrays and look up whole batches of tokens by binary
search; nothing is gathered on the driver but one row of totals for each shard.

    p(w | v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) p(w)
    p(w)     = max(b(w) - D'(b(w)), 0) / B + g' / (V + 1)

c are counts, b(w) counts the contexts of w, B their sum; g and g' are what the
discounts left.  D has three values (count 1, 2, more) from counts of counts.  A
text is its words and one end, which also stands before its first word.  An
unknown word has the share of one word in V + 1; after an unknown context the
model is p(w).

Defined cases: null and empty texts are the end alone; a null id is as an empty
text for the choice of training rows; repeated rows count and are scored each; an
empty table gives an empty result, and without training rows all probabilities
are 1 / (V + 1) = 1; columns beyond id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import _LOWER, U64, arrow_map, chunks, column, mix, new_path, stage, table, text_bytes, word_hashes, words
from ._store import map_array, names, write_array

#: Tokens that a task sums at once; distinct words of a shard; tokens of a bucket.
SUMMED, SHARD, BUCKET = 4_000_000, 250_000, 2_000_000
#: The hash of the end of a text, which no word is given.
END = U64(1)
CONTEXT = ("one", "two", "three", "four", "more", "before")


def tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts (words, then one end), n + 1 offsets."""
    raw, offsets = text_bytes(part.column(part.schema.get_field_index("text")))
    raw = _LOWER[raw]
    starts, ends, bounds = words(raw, offsets)
    hashes = word_hashes(raw, starts, ends)
    hashes[hashes == END] = U64(2)
    return np.insert(hashes, bounds[1:], END), bounds + np.arange(len(bounds))


def contexts_of(ids: np.ndarray, offsets: np.ndarray, end: int) -> np.ndarray:
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[offsets[:-1]] = end
    return before


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Which range of hashes: shards are in the order of the hashes."""
    return ((hashes >> U64(40)) * U64(shards)) >> U64(24)


# --------------------------------------------------------------------- model


@dataclass
class Layout:
    """Where the arrays are, and the totals of the model."""

    folder: str
    offsets: list[int]  # of the ids of each shard, with the end
    buckets: int
    hot: int
    end: int = -1  # id of the end, and its count
    hot_end: int = 0
    total: int = 0
    discount: tuple = (0.0, 0.0, 0.0)
    discount_words: tuple = (0.0, 0.0, 0.0)
    bigrams: int = 0
    spare: float = 1.0  # g'

    @property
    def vocabulary(self) -> int:
        return self.offsets[-1]


@dataclass
class Arrays:
    """A worker's view of the arrays, opened when first needed."""

    layout: Layout
    opened: dict = field(default_factory=dict)

    def get(self, name: str, dtype) -> np.ndarray:
        if name not in self.opened:
            self.opened[name] = map_array(self.layout.folder, name, dtype)
        return self.opened[name]

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted, distinct hashes."""
        offsets = self.layout.offsets
        out, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        bounds = np.searchsorted(shard_of(hashes, len(offsets) - 1), np.arange(len(offsets)))
        for s, (a, b) in enumerate(zip(bounds, bounds[1:])):
            known = self.get(f"words-{s}", U64) if b > a else ()
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes[a:b]), len(known) - 1)
                found = known[at] == hashes[a:b]
                out[a:b][found] = at[found] + offsets[s]
                counts[a:b][found] = self.get(f"counts-{s}", np.int64)[at[found]]
        return out, counts

    def statistics(self, ids: np.ndarray) -> np.ndarray:
        """Rows of CONTEXT of ids (of an ascending array; -1 gives zeros)."""
        out = np.zeros((len(ids), len(CONTEXT)), np.int64)
        bounds = np.searchsorted(ids, self.layout.offsets)
        for s, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if b > a:
                out[a:b] = self.get(f"context-{s}", np.int64).reshape(-1, len(CONTEXT))[ids[a:b] - self.layout.offsets[s]]
        return out

    def bigrams(self, keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Counts of distinct keys, 0 for unknown ones."""
        out = np.zeros(len(keys), np.int64)
        order = np.lexsort((keys, bucket))
        bounds = np.searchsorted(bucket[order], np.arange(self.layout.buckets + 1))
        for k in np.flatnonzero(bounds[1:] > bounds[:-1]):
            some = order[bounds[k] : bounds[k + 1]]
            known = self.get(f"keys-{k}", U64)
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, keys[some]), len(known) - 1)
            found = known[at] == keys[some]
            some, at = some[found], at[found]
            counts = self.get(f"few-{k}", np.uint8)[at].astype(np.int64)
            many = counts == 255
            if many.any():
                where = np.searchsorted(self.get(f"many-at-{k}", np.int64), at[many])
                counts[many] = self.get(f"many-{k}", np.int64)[where]
            out[some] = counts
        return out


@lru_cache(maxsize=2)
def _arrays(folder: str, offsets: tuple, buckets: int, hot: int) -> Arrays:
    return Arrays(Layout(folder, list(offsets), buckets, hot))


def arrays(layout: Layout) -> Arrays:
    return _arrays(layout.folder, tuple(layout.offsets), layout.buckets, layout.hot)


def bucket_of(keys: np.ndarray, count: np.ndarray, layout: Layout) -> np.ndarray:
    """By context, or by the whole pair where the context is hot."""
    return (mix(np.where(count > layout.hot, keys, keys >> U64(32))) % U64(layout.buckets)).astype(np.int64)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney from the counts of counts 1 to 4."""
    one, two, three, four = n
    y = one / (one + 2 * two) if one else 0.0
    raw = (1 - 2 * y * two / one if one else 0.5, 2 - 3 * y * three / two if two else 1.0, 3 - 4 * y * four / three if three else 1.5)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw))


# ------------------------------------------------------------------- counting


def _sum_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def give() -> pa.RecordBatch:
        h, n = (np.concatenate(x) for x in zip(*held))
        terms, at = np.unique(h, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(np.bincount(at, n, len(terms)).astype(np.int64))], names=["hash", "n"])

    for batch in batches:
        for part in chunks(batch):
            hashes, _ = tokens(part)
            held.append(np.unique(hashes, return_counts=True))
            size += len(hashes)
            if size >= SUMMED:
                yield give()
                held, size = [], 0
    if held:
        yield give()


def _write_words(folder: str, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(column(b, "shard"), column(b, "hash").view(U64), column(b, "n")) for b in batches if b.num_rows]
        rows = []
        if got:
            shard, hashes, n = (np.concatenate(x) for x in zip(*got))
            order = np.lexsort((hashes, shard))
            shard, hashes, n = shard[order], hashes[order], n[order]
            for s in np.unique(shard):
                a, b = np.searchsorted(shard, [s, s + 1])
                write_array(folder, f"words-{s}", hashes[a:b])
                write_array(folder, f"counts-{s}", n[a:b].astype(np.int64))
                rows.append((int(s), int(b - a), int(n[a:b].sum())))
        cols = zip(*rows) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["shard", "words", "tokens"])

    return run


def _encode(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts: byte planes of small numbers, compressed."""
    left = (keys >> U64(32)).astype(np.uint32)
    parts = [np.diff(left, prepend=np.uint32(0)), keys.astype(np.uint32), counts.astype(np.uint32)]
    planes = b"".join(p.view(np.uint8).reshape(-1, 4).T.tobytes() for p in parts)
    return len(keys).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(planes)


def _decode(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(block[:4], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block[4:], max_output_size=12 * n), np.uint8).reshape(3, 4, n)
    left, right, counts = (np.ascontiguousarray(p.T).view(np.uint32).ravel() for p in planes)
    return (np.cumsum(left, dtype=np.uint32).astype(U64) << U64(32)) | right.astype(U64), counts.astype(np.int64)


def _sum_bigrams(layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = arrays(layout)
        held, size = [], 0

        def give() -> pa.RecordBatch:
            keys, n, hot = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(keys)
            keys, n, hot = keys[order], n[order], hot[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
            keys, hot, n = keys[first], hot[first], np.add.reduceat(n, first)
            bucket = bucket_of(keys, np.where(hot, layout.hot + 1, 0), layout)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(layout.buckets + 1))
            full = np.flatnonzero(bounds[1:] > bounds[:-1])
            blocks = [_encode(keys[order[bounds[k] : bounds[k + 1]]], n[order[bounds[k] : bounds[k + 1]]]) for k in full]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(blocks, pa.binary())], names=["bucket", "block"])

        for batch in batches:
            for part in chunks(batch):
                hashes, offsets = tokens(part)
                distinct, at = np.unique(hashes, return_inverse=True)
                ids, counts = model.ids(distinct)
                right = ids[at]
                left = contexts_of(right, offsets, layout.end)
                keys, first, n = np.unique((left.astype(U64) << U64(32)) | right.astype(U64), return_index=True, return_counts=True)
                hot = contexts_of(counts[at], offsets, layout.hot_end)[first] > layout.hot
                held.append((keys, n, hot))
                size += len(hashes)
                if size >= SUMMED:
                    yield give()
                    held, size = [], 0
        if held:
            yield give()

    return run


_SUMS = "shard long, id long, one long, two long, three long, four long, more long, before long"


def _write_bigrams(layout: Layout):
    """Blocks sorted by bucket -> arrays; sums by context and by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current = None

        def give() -> pa.RecordBatch:
            keys, counts = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            keys, counts = keys[first], np.add.reduceat(counts, first)
            many = np.flatnonzero(counts >= 255)
            write_array(layout.folder, f"many-at-{current}", many.astype(np.int64))
            write_array(layout.folder, f"many-{current}", counts[many].astype(np.int64))
            write_array(layout.folder, f"few-{current}", np.minimum(counts, 255).astype(np.uint8))
            write_array(layout.folder, f"keys-{current}", keys)
            left, right = (keys >> U64(32)).astype(np.int64), (keys & U64(0xFFFFFFFF)).astype(np.int64)
            contexts, at = np.unique(left, return_inverse=True)
            kinds = np.bincount(at * 5 + np.minimum(counts, 5) - 1, minlength=5 * len(contexts)).reshape(-1, 5)
            followers, before = np.unique(right, return_counts=True)
            table = np.zeros((len(contexts) + len(followers), 7), np.int64)
            table[: len(contexts), 0], table[: len(contexts), 1:6] = contexts, kinds
            table[len(contexts) :, 0], table[len(contexts) :, 6] = followers, before
            shard = np.searchsorted(layout.offsets, table[:, 0], "right") - 1
            return pa.RecordBatch.from_arrays([pa.array(shard), *(pa.array(table[:, k]) for k in range(7))], names=["shard", "id", *CONTEXT])

        for batch in batches:
            for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != current and held:
                    yield give()
                    held = []
                current = bucket
                held.append(_decode(block.as_py()))
        if held:
            yield give()

    return run


def _write_contexts(layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [np.stack([column(b, k) for k in ("shard", "id", *CONTEXT)], axis=1) for b in batches if b.num_rows]
        rows = []
        if got:
            data = np.concatenate(got)
            data = data[np.lexsort((data[:, 1], data[:, 0]))]
            for s in np.unique(data[:, 0]):
                a, b = np.searchsorted(data[:, 0], [s, s + 1])
                part = data[a:b, 2:]
                write_array(layout.folder, f"context-{s}", part)
                before = part[:, 5]
                rows.append((*part[:, :4].sum(0).tolist(), *((before == k).sum() for k in range(1, 5)), (before > 2).sum(), before.sum()))
        cols = zip(*rows) if rows else [[]] * 10
        yield pa.RecordBatch.from_arrays([pa.array([int(v) for v in c], pa.int64()) for c in cols], names=[f"c{k}" for k in range(10)])

    return run


def train(texts: DataFrame) -> Layout:
    """Count the ``text`` column; the model's arrays go to the shared folder."""
    spark = texts.sparkSession
    folder = new_path(spark, "bigrams")
    texts = texts.select("text")
    counted = arrow_map(texts, _sum_words, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    counted = stage(counted, "words")
    shards = max(1, -(-counted.count() // SHARD))
    # the shard of an unsigned hash, as shard_of has it
    counted = counted.withColumn("shard", F.floor(F.shiftrightunsigned("hash", 40) * F.lit(shards) / F.lit(1 << 24)).cast("long"))
    sizes = arrow_map(counted.repartition(shards, "shard").select("shard", "hash", "n"), _write_words(folder, shards), "shard long, words long, tokens long").collect()  # a row for each shard
    by_shard = {r.shard: r for r in sizes}
    offsets = [0]
    for s in range(shards):
        if s not in by_shard:
            write_array(folder, f"words-{s}", np.empty(0, U64))
        offsets.append(offsets[-1] + (by_shard[s].words if s in by_shard else 0))
    if offsets[-1] >= 1 << 32:
        raise ValueError("more words than 32-bit ids")
    total = sum(r.tokens for r in sizes)
    buckets = max(1, -(-total // BUCKET))
    layout = Layout(folder, offsets, buckets, max(total // buckets // 4, 1), total=total)
    if not total:
        return layout
    ids, counts = arrays(layout).ids(np.array([END]))
    layout.end, layout.hot_end = int(ids[0]), int(counts[0])
    blocks = arrow_map(texts, _sum_bigrams(layout), "bucket long, block binary").repartition(layout.buckets, "bucket").sortWithinPartitions("bucket")
    sums = arrow_map(blocks, _write_bigrams(layout), _SUMS).groupBy("shard", "id").agg(*(F.sum(k).alias(k) for k in CONTEXT))
    rows = arrow_map(sums.repartition(shards, "shard").select("shard", "id", *CONTEXT), _write_contexts(layout), ", ".join(f"c{k} long" for k in range(10))).collect()  # a row for each shard
    c = np.array([list(r) for r in rows], np.int64).sum(0)
    known = names(spark, folder)
    for k in range(layout.buckets):
        if f"keys-{k}" not in known:  # a bucket without bigrams is an empty array
            write_array(folder, f"keys-{k}", np.empty(0, U64))
    layout.discount = discounts(c[:4].tolist())
    layout.discount_words = discounts(c[4:8].tolist())
    layout.bigrams = int(c[9])
    d = layout.discount_words
    layout.spare = float((d[0] * c[4] + d[1] * c[5] + d[2] * c[8]) / c[9])
    return layout


# -------------------------------------------------------------------- scoring


def _less(counts: np.ndarray, discount: tuple) -> np.ndarray:
    """Counts with their discounts taken off."""
    d = np.array([0.0, *discount])
    return np.maximum(counts - d[np.minimum(counts, 3)], 0.0)


def token_scores(part: pa.RecordBatch, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens: training counts and log10 p; n + 1 offsets of the texts."""
    hashes, offsets = tokens(part)
    distinct, at = np.unique(hashes, return_inverse=True)
    vocabulary = layout.vocabulary
    if not vocabulary:
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes)), offsets
    model = arrays(layout)
    ids, counts = model.ids(distinct)
    order = np.argsort(ids, kind="stable")
    stats = np.empty((len(ids), len(CONTEXT)), np.int64)
    stats[order] = model.statistics(ids[order])
    alone = _less(stats[:, 5], layout.discount_words) / layout.bigrams + layout.spare / (vocabulary + 1)
    d = layout.discount
    safe = np.maximum(counts, 1)
    spare = np.where(counts > 0, (d[0] * stats[:, 0] + d[1] * stats[:, 1] + d[2] * stats[:, 2:5].sum(1)) / safe, 1.0)
    end = int(np.searchsorted(distinct, END))
    before = contexts_of(at, offsets, end)
    p = spare[before] * alone[at]
    both = np.flatnonzero((ids[before] >= 0) & (ids[at] >= 0))
    keys, where = np.unique((ids[before[both]].astype(U64) << U64(32)) | ids[at[both]].astype(U64), return_inverse=True)
    context_count = np.zeros(len(keys), np.int64)
    context_count[where] = counts[before[both]]
    seen = model.bigrams(keys, bucket_of(keys, context_count, layout))
    p[both] += (_less(seen, d) / np.maximum(context_count, 1))[where]
    return counts[at], np.log10(p), offsets


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                counts, logs, offsets = token_scores(part, layout)
                base = np.log10((counts + 1) / (layout.total + layout.vocabulary + 1))
                starts = offsets[:-1]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(np.diff(offsets)),
                        pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)),
                        pa.array(np.full(len(starts), layout.total)),
                        pa.array(np.add.reduceat(base, starts)),
                        pa.array(np.add.reduceat(logs, starts)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score(docs: DataFrame, layout: Layout, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole texts under the model: log10 probability, and the unigram base."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(base, _score(layout), _SCORES)


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity of each text."""
    return scores.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    model = train(docs.filter(~held_out).select(F.col("text").cast("string").alias("text")))
    return perplexity(score(docs, model, held_out))
