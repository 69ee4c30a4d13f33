"""Suffix-array dedup by longest-previous-factor arrays.

Texts are sequences of bytes.  A byte goes if a string of ``length`` bytes that
covers it also starts elsewhere.

* Fragments (see ``_repeats``) bring together whatever can be equal; those with
  one content need no suffix array, a copy of a whole fragment is settled by its
  first place.
* Fragments of one anchor and several contents are cut out of the texts and meet
  by anchor.  Their suffixes are sorted by prefix doubling to a depth of
  ``length``; in that order the previous and the next smaller position are the
  only candidates for the longest earlier match, and the larger of the two common
  prefixes is the longest previous factor (LPF).  A start with LPF >= length is a
  later copy.  The mirror array (longest next factor, from the previous and next
  larger positions) finds earlier copies of what comes later.
* An anchor with more than ``HOT`` contents is not gathered: its windows meet by
  their hashes (two of 64 bits) in compressed blocks, one row for each window and
  task, after copies within a task are settled.

``keep="first"`` removes later copies only; ``keep="none"`` removes all copies.

Defined cases: null text counts as empty; texts shorter than ``length`` come back
unchanged; null doc_ids sort before all others; rows repeated with one id and one
text are one place, so they are no copies of each other; other texts under the
same id are documents of their own; an empty table gives an empty result; columns
beyond id and text are not read.  Matches never cross documents.  Memory grows
with the longest text and with ``HOT`` fragments, not with a group of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _repeats
from ._common import _TABLE, arrow_map, byte_sums, chunks, column, keyed, mix, span_hash, stage, table, text_bytes, tidy

LENGTH = 400
GRAM = 64
#: Fragments of one anchor up to which a suffix array is built at once.
HOT = 2000
#: Windows of hot anchors that a task settles at once, and of a bucket.
WINDOWS = 500_000
#: Bytes of text from which a suffix array is built and given out.
BLOCK = 1 << 20


# ---------------------------------------------------------------- suffix order


def prefix_ranks(raw: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(width, ranks) of ever longer prefixes, the last of ``depth`` bytes: ranks of
    raw[i:i+width] for each start with as many bytes left (ties equal).

    Prefix doubling: ranks to 7 bytes from the bytes, then to twice as many, and
    at last to exactly ``depth`` by two overlapping parts.
    """
    have = 7 if depth >= 7 else 1
    n = max(len(raw) - have + 1, 0)
    ranks = np.zeros(n, np.int64)
    for i in range(have):
        ranks = (ranks << 8) | raw[i : n + i]
    levels = []
    while True:
        ranks = np.unique(ranks, return_inverse=True)[1].astype(np.int32)
        levels.append((have, ranks))
        if have == depth or not len(ranks):
            return levels
        step = min(have, depth - have)
        ranks = (ranks[: max(len(ranks) - step, 0)].astype(np.int64) << 32) | ranks[step:]
        have += step


def common_prefixes(raw: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at a[k] and b[k], up to
    the depth: the widths from the greatest down, each at most once, then bytes."""
    depth, ranks = levels[-1]
    out = np.where(ranks[a] == ranks[b], depth, 0).astype(np.int64)
    open_ = np.flatnonzero(out == 0)
    x, y = a[open_], b[open_]
    found = np.zeros(len(open_), np.int64)
    for width, ranks in levels[-2::-1]:
        same = (x + found < len(ranks)) & (y + found < len(ranks))
        at = np.flatnonzero(same)
        same[at] = ranks[x[at] + found[at]] == ranks[y[at] + found[at]]
        found[same] += width
    for _ in range(levels[0][0] - 1):
        same = (x + found < len(raw)) & (y + found < len(raw))
        at = np.flatnonzero(same)
        same[at] = raw[x[at] + found[at]] == raw[y[at] + found[at]]
        if not same.any():
            break
        x, y, found, open_, gone = x[same], y[same], found[same] + 1, open_[same], (open_[~same], found[~same])
        out[gone[0]] = gone[1]
    out[open_] = found
    return np.minimum(out, depth)


def nearest_smaller(values: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i: the nearest j < i with values[j] < values[i] (or -1), and the
    least of links[j+1..i]; links[i] belongs between i - 1 and i.

    All entries jump at once over what is larger, as pointers do in a stack.
    """
    n = len(values)
    at = np.arange(n) - 1
    least = links.copy()
    todo = np.flatnonzero(at >= 0)
    todo = todo[values[at[todo]] > values[todo]]
    while len(todo):
        to = at[todo]
        least[todo] = np.minimum(least[todo], least[to])
        at[todo] = at[to]
        todo = todo[at[todo] >= 0]
        todo = todo[values[at[todo]] > values[todo]]
    least[at < 0] = 0
    return at, least


def longest_factors(raw: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and next factor at ``starts`` (ascending), up to ``depth``;
    starts must have ``depth`` bytes left.

    Previous: the longest common prefix with any smaller start.  Next: with any
    larger one.
    """
    previous, following = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    if not len(starts):
        return previous, following
    levels = prefix_ranks(raw, depth)
    order = np.lexsort((starts, levels[-1][1][starts]))
    links = np.zeros(len(order), np.int64)
    links[1:] = common_prefixes(raw, levels, starts[order[:-1]], starts[order[1:]])
    back = np.append(links[1:], 0)[::-1]  # the same order read from its end: back[i] lies between i - 1 and i
    for out, values in ((previous, starts[order]), (following, -starts[order])):
        _, before = nearest_smaller(values, links)
        _, after = nearest_smaller(values[::-1], back)
        out[order] = np.maximum(before, after[::-1])
    return previous, following


# ------------------------------------------------------------------- fragments


def _fragments(length: int, gram: int):
    def extract(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
        for part in chunks(batch):
            raw, offsets = text_bytes(part.column(part.schema.get_field_index("text")))
            if len(raw) < length:
                continue
            items = _TABLE[raw]
            got = _repeats.fragments_of(items, _repeats.gram_hashes(items, gram), offsets, length, gram)
            seq = got.pop("seq")
            yield got | {"_did": column(part, "_did")[seq], "_key": column(part, "_key")[seq]}

    return extract


SEGMENTS = "anchor long, hot boolean, _did long, _key long, start int, n int, segment binary"


def _segments(length: int):
    """Open fragments cut out of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for did, key, text, spans in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("_did", "_key", "text", "spans"))):
                data = text.encode()
                rows += [(x["anchor"], x["hot"], did, key, x["start"], x["n"], data[x["start"] : x["start"] + x["n"] + length - 1]) for x in spans]
            for low in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, type=t) for v, t in zip(zip(*rows[low : low + 2000]), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                    names=["anchor", "hot", "_did", "_key", "start", "n", "segment"],
                )

    return run


_SPANS = [("_did", pa.int64()), ("_key", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]
SPANS = "_did long, _key long, start int, n int"


def _runs(mask: np.ndarray, did, key, start, bounds) -> pa.RecordBatch | None:
    """Marked windows of segments, neighbours united, as spans of their texts."""
    seg = np.repeat(np.arange(len(did)), np.diff(bounds))
    new = mask.copy()
    new[1:] &= ~mask[:-1] | (seg[1:] != seg[:-1])
    stop = mask.copy()
    stop[:-1] &= ~mask[1:] | (seg[1:] != seg[:-1])
    a, b = np.flatnonzero(new), np.flatnonzero(stop) + 1
    if not len(a):
        return None
    s = seg[a]
    return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, (_, t) in zip((did[s], key[s], start[s] + a - bounds[s], b - a), _SPANS)], names=[k for k, _ in _SPANS])


def _suffixes(length: int, both: bool):
    """Segments sorted by anchor -> spans; whole anchors, about BLOCK at a time."""

    def solve(held: list[tuple]) -> pa.RecordBatch | None:
        held.sort(key=lambda r: r[1:4])
        raw = np.frombuffer(b"".join(r[5] for r in held), np.uint8)
        did, key, start, n = (np.array([r[k] for r in held], np.int64) for k in (1, 2, 3, 4))
        offsets = np.concatenate([[0], np.cumsum([len(r[5]) for r in held])[:-1]])
        bounds = np.concatenate([[0], np.cumsum(n)])
        starts = np.repeat(offsets - bounds[:-1], n) + np.arange(bounds[-1])
        previous, following = longest_factors(raw, starts, length)
        return _runs((previous >= length) | (both & (following >= length)), did, key, start, bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, current = [], 0, None
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("anchor", "_did", "_key", "start", "n", "segment")]
            for row in zip(*cols):
                if row[0] != current and size >= BLOCK:
                    if (out := solve(held)) is not None:
                        yield out
                    held, size = [], 0
                current = row[0]
                held.append(row)
                size += len(row[5])
        if held and (out := solve(held)) is not None:
            yield out

    return run


BLOCKS = "bucket long, block binary, _did long, _key long, start int, n int"
_PLACE = np.dtype([("first", "<u8"), ("second", "<u8"), ("did", "<i8"), ("key", "<i8"), ("start", "<i4"), ("copied", "u1")])


def _same(rows: np.ndarray) -> np.ndarray:
    """Of sorted windows: whether each equals the one before it."""
    out = np.zeros(len(rows), bool)
    out[1:] = (rows["first"][1:] == rows["first"][:-1]) & (rows["second"][1:] == rows["second"][:-1])
    return out


def _settle(rows: np.ndarray, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sorted windows -> the first place of each (``copied`` if there are others),
    and the places that go."""
    rows = rows[np.lexsort((rows["start"], rows["key"], rows["did"], rows["second"], rows["first"]))]
    same = _same(rows)
    again = same.copy()  # the very place of the row before
    again[1:] &= (rows["did"][1:] == rows["did"][:-1]) & (rows["key"][1:] == rows["key"][:-1]) & (rows["start"][1:] == rows["start"][:-1])
    group = np.cumsum(~same) - 1
    copied = (np.bincount(group, ~again) > 1) | (np.bincount(group, rows["copied"]) > 0)
    first = rows[~same]
    first["copied"] = copied
    gone = rows[(same & ~again) | (both & copied[group])]
    return first, gone


def _as_spans(gone: np.ndarray) -> tuple[np.ndarray, ...]:
    """Single starts as runs: did, key, start, n."""
    gone = np.unique(gone[["did", "key", "start"]])
    new = np.ones(len(gone), bool)
    new[1:] = (gone["did"][1:] != gone["did"][:-1]) | (gone["key"][1:] != gone["key"][:-1]) | (gone["start"][1:] != gone["start"][:-1] + 1)
    at = np.flatnonzero(new)
    return gone["did"][at], gone["key"][at], gone["start"][at], np.diff(np.append(at, len(gone)))


def _window_blocks(length: int, both: bool, buckets: int):
    """Windows of hot segments, some at a time: what is settled among them as
    spans, and their first places as one block for each bucket of hashes."""

    def give(held: list[np.ndarray]) -> pa.RecordBatch:
        first, gone = _settle(np.concatenate(held), both)
        did, key, start, n = _as_spans(gone)
        bounds = np.searchsorted((first["first"] >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24), np.arange(buckets + 1))
        full = np.flatnonzero(bounds[1:] > bounds[:-1])
        blocks = [zstandard.ZstdCompressor(level=1).compress(first[bounds[k] : bounds[k + 1]].tobytes()) for k in full]
        none = len(full)
        columns = [
            pa.array([*full.tolist(), *(mix(start.astype(np.uint64)) % np.uint64(buckets)).tolist()], pa.int64()),
            pa.array(blocks + [None] * len(did), pa.binary()),
            *(pa.array([0] * none + v.tolist(), type=t) for v, t in zip((did, key, start, n), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "block", "_did", "_key", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                raw, offsets = text_bytes(part.column(part.schema.get_field_index("segment")))
                n = column(part, "n").astype(np.int64)
                seg = np.repeat(np.arange(len(n)), n)
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = offsets[seg] + inner
                rows = np.zeros(len(seg), _PLACE)
                for name, second in (("first", False), ("second", True)):
                    sums, powers = byte_sums(raw, second)
                    rows[name] = mix(span_hash(sums, at, at + length, powers))
                rows["did"], rows["key"], rows["start"] = column(part, "_did")[seg], column(part, "_key")[seg], column(part, "start")[seg] + inner
                held.append(rows)
                size += len(rows)
                if size >= WINDOWS:
                    yield give(held)
                    held, size = [], 0
        if held:
            yield give(held)

    return run


def _window_spans(both: bool):
    """Blocks sorted by bucket -> spans; a bucket holds one row for each window
    and task, however many copies there are."""

    def give(held: list[np.ndarray]) -> pa.RecordBatch:
        _, gone = _settle(np.concatenate(held), both)
        return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, (_, t) in zip(_as_spans(gone), _SPANS)], names=[k for k, _ in _SPANS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            settled = batch.filter(batch.column(1).is_null())
            if settled.num_rows:
                yield pa.RecordBatch.from_arrays(settled.columns[2:], names=[k for k, _ in _SPANS])
            blocks = batch.filter(batch.column(1).is_valid())
            for bucket, block in zip(blocks.column(0).to_pylist(), blocks.column(1)):
                if bucket != current and held:
                    yield give(held)
                    held = []
                current = bucket
                held.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(block.as_py()), _PLACE))
        if held:
            yield give(held)

    return run


def _hot_spans(hot: DataFrame, length: int, both: bool) -> DataFrame:
    total = hot.agg(F.sum(F.col("n").cast("long")).alias("n")).first()["n"] or 0
    buckets = max(1, -(-total // WINDOWS))
    blocks = arrow_map(hot, _window_blocks(length, both, buckets), BLOCKS)
    return arrow_map(blocks.repartition("bucket").sortWithinPartitions("bucket"), _window_spans(both), SPANS)


@tidy
def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: str = "first", hot: int = HOT) -> DataFrame:
    """(_did, _key, start, n): starts of strings that occur elsewhere as well
    (keep="none") or earlier (keep="first"), of ``keyed`` docs."""
    both = keep == "none"
    known = _repeats.verdicts(docs, _fragments(length, gram), both, "suffixes")
    crowded = stage(known.filter("open").groupBy("anchor").count().filter(F.col("count") > hot).select("anchor", F.lit(True).alias("hot")), "hot-anchors")
    branching = known.filter("open").join(crowded, "anchor", "left")
    branching = branching.groupBy("_did", "_key").agg(F.collect_list(F.struct("anchor", F.coalesce("hot", F.lit(False)).alias("hot"), "start", "n")).alias("spans"))
    joined = docs.select("_did", "_key", "text").join(branching, ["_did", "_key"])
    segments = stage(arrow_map(joined, _segments(length), SEGMENTS), "segments")
    by_anchor = segments.filter("not hot").repartition("anchor").sortWithinPartitions("anchor")
    found = arrow_map(by_anchor, _suffixes(length, both), SPANS).unionByName(_hot_spans(segments.filter("hot"), length, both))
    return stage(known.filter("copy").select("_did", "_key", "start", "n").unionByName(found), "suffix-spans")


RESULT = "doc_id long, n_bytes long, n_removed long, removed array<struct<start:int,stop:int>>, kept binary"


def _apply(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.binary())
        for batch in batches:
            for part in chunks(batch):
                raw, offsets = text_bytes(part.column(part.schema.get_field_index("text")))
                out: list[tuple] = []
                for i, (doc_id, spans) in enumerate(zip(part.column(part.schema.get_field_index("doc_id")).to_pylist(), part.column(part.schema.get_field_index("spans")))):
                    data = raw[offsets[i] : offsets[i + 1]]
                    if not (spans.is_valid and len(spans.values)):
                        out.append((doc_id, len(data), 0, [], data.tobytes()))
                        continue
                    at, n = (spans.values.field(k).to_numpy() for k in (0, 1))
                    inside = (at >= 0) & (at + n - 1 + length <= len(data))
                    gone = _repeats.covered(len(data), at[inside], n[inside], length)
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]))).reshape(-1, 2)
                    out.append((doc_id, len(data), int(gone.sum()), [{"start": int(x), "stop": int(y)} for x, y in edge], data[~gone].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out), types)], names=["doc_id", "n_bytes", "n_removed", "removed", "kept"])

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep: str = "first", hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, removed byte spans, kept
    bytes (which may cut a character)."""
    base = keyed(docs, id_col, text_col)
    spans = _repeats.spans_by_text(repeated_spans(base, length, gram, keep, hot))
    joined = base.join(spans, ["_did", "_key"], "left").select("doc_id", "text", "spans")
    return arrow_map(joined, _apply(length), RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All copies go: a string that starts anywhere else, earlier or later."""
    found = suffix_dedup(table(spark, sf_dir, "documents"), keep="none")
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Windows as byte strings by DuckDB; removed runs; what lies between them.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, s, md5(b[s + 1:s + 400]) AS k FROM (SELECT r, b, unnest(range(0, octet_length(b) - 399)) AS s FROM d WHERE octet_length(b) >= 400)),
again AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
runs AS (SELECT r, s, (s > coalesce(lag(s) OVER (PARTITION BY r ORDER BY s) + 400, -1))::INT AS begins FROM again),
spans AS (SELECT r, min(s) AS a, max(s) + 400 AS z FROM (SELECT r, s, sum(begins) OVER (PARTITION BY r ORDER BY s) AS g FROM runs) GROUP BY r, g),
sums AS (SELECT r, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY r),
gaps AS (SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS z FROM spans UNION ALL SELECT r, max(z), NULL FROM spans GROUP BY r),
kept AS (SELECT gaps.r, string_agg(hex(b[gaps.a + 1:coalesce(gaps.z, octet_length(b))]), '' ORDER BY gaps.a) AS h FROM gaps JOIN d ON gaps.r = d.r GROUP BY gaps.r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN h IS NULL THEN b ELSE unhex(h) END) AS kept_sha256
FROM d LEFT JOIN sums ON d.r = sums.r LEFT JOIN kept ON d.r = kept.r
"""
