"""Packing documents into windows by best-fit decreasing.

A document's ids (with an end id) are first cut into full windows; what remains
is an item.  Items, longest first, go to the open window with the least capacity
that still holds them, found in a segment tree over remaining capacities.

Packing needs no shuffle: each task packs what it reads, in groups of at most
``GROUP`` tokens of remainders, so memory is bounded and a lost executor's work
is redone alone with the same result.  At the end of a group the emptiest windows
are cut up to fill gaps of ``MIN_CUT`` tokens or more elsewhere, and the one that
is left is cut at powers of two, which need no padding.

Ids: ``tokenizers`` with a JSON file; or, for files that exist in both forms, the
same vocabulary as ranks through ``tiktoken`` with equal ids, several times
faster, given the special tokens that the JSON file adds.  Their strings in a text
are these tokens, as ``tokenizers`` has it unless told otherwise.

Defined cases: null and empty texts are the end id alone; null doc_ids stay null;
repeated rows are packed once each; an empty table gives an empty result; columns
beyond id and text are not read.  sequence_id is unique over the whole result.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, table

WINDOW = 2048
END = 1
MIN_CUT = 16
GROUP = 1 << 24

RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_TYPES = dict.fromkeys(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), pa.int64())


class Capacities:
    """Segment tree over remaining capacities 0..size: how many windows are open
    with each, and the least capacity that is at least some length."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.open[node] += by
            node >>= 1

    def tightest(self, length: int) -> int:
        """The least open capacity >= length, or -1."""
        node = length + self.leaves
        if self.open[node]:
            return length
        while node > 1:
            if not node & 1 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """Windows as lists of items; no window exceeds ``window``."""
    tree, at, out = Capacities(window), {}, []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        length = lengths[item]
        room = tree.tightest(length)
        if room < 0:
            number, room = len(out), window
            out.append([])
        else:
            number = at[room].pop()
            tree.add(room, -1)
        out[number].append(item)
        if room - length:
            at.setdefault(room - length, []).append(number)
            tree.add(room - length, 1)
    return out


def pack_items(lengths: list[int], window: int, min_cut: int = MIN_CUT) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, stop); all full but for small gaps, or of
    a power of two."""
    packed = [[(i, 0, lengths[i]) for i in group] for group in best_fit_decreasing(lengths, window)]
    fill = [sum(b - a for _, a, b in s) for s in packed]
    order = sorted(range(len(packed)), key=lambda k: (fill[k], k))
    gaps = [k for k in order if window - fill[k] >= min_cut]
    # the emptiest windows give, the fullest of those with a gap take
    taking = gaps[::-1]
    donor = 0
    for k in taking:
        while donor < len(gaps) and fill[k] < window:
            giver = gaps[donor]
            if giver == k or fill[giver] > fill[k]:
                break
            if not packed[giver]:
                donor += 1
                continue
            item, a, b = packed[giver].pop()
            take = min(b - a, window - fill[k])
            packed[k].append((item, b - take, b))
            if take < b - a:
                packed[giver].append((item, a, b - take))
            fill[k] += take
            fill[giver] -= take
        if donor < len(gaps) and gaps[donor] == k:
            break
    out = []
    for k, pieces in enumerate(packed):
        if not pieces:
            continue
        if window - fill[k] < min_cut:
            out.append(pieces)
            continue
        rest = pieces[::-1]
        for bit in range(window.bit_length() - 1, -1, -1):
            if fill[k] >> bit & 1:
                need, sequence = 1 << bit, []
                while need:
                    item, a, b = rest.pop()
                    take = min(need, b - a)
                    sequence.append((item, a, a + take))
                    if take < b - a:
                        rest.append((item, a + take, b))
                    need -= take
                out.append(sequence)
    return out


def special_tokens(path: str) -> dict[str, int]:
    """The tokens that a JSON file adds to its vocabulary."""
    with open(path, encoding="utf-8") as file:
        return {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}


@lru_cache(maxsize=2)
def _encoder(path: str, special: tuple = ()):
    """texts -> one array of ids for each."""
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(special))
        return lambda texts: [np.array(encoding.encode(x, allowed_special="all", disallowed_special=()) if any(t in x for t, _ in special) else encoding.encode_ordinary(x), np.uint32) for x in texts]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda texts: [np.array(x.ids, np.uint32) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _run(path: str, window: int, end: int, special: tuple):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path, special)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 33
        rows: list[tuple] = []
        items: list[tuple] = []
        held = 0

        def flush() -> list[tuple]:
            nonlocal number, held
            out = []
            for sequence in pack_items([len(x[3]) for x in items], window):
                offset = 0
                for item, a, b in sequence:
                    doc_id, first, total, ids = items[item]
                    out.append((doc_id, first + a, b - a, _crc(ids[a:b]), total, number, offset))
                    offset += b - a
                number += 1
            items.clear()
            held = 0
            return out

        def give(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows), _TYPES.values())], names=list(_TYPES))

        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            for low in range(0, len(texts), 64):
                for doc_id, ids in zip(ids_of[low : low + 64], encode([x or "" for x in texts[low : low + 64]])):
                    ids = np.append(ids, np.uint32(end))
                    total = len(ids)
                    cut = total - total % window
                    for first in range(0, cut, window):
                        rows.append((doc_id, first, window, _crc(ids[first : first + window]), total, number, 0))
                        number += 1
                    if cut < total:
                        items.append((doc_id, cut, total, ids[cut:].astype(np.uint16 if ids.max() < 65536 else np.uint32)))
                        held += total - cut
                    if held >= GROUP:
                        rows += flush()
            if rows:
                yield give(rows)
                rows = []
        rows = flush()
        if rows:
            yield give(rows)

    return pack


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END, special: Mapping[str, int] | None = None) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a vocabulary file, present on every worker;
    ``special`` are the special tokens of one of ranks (see ``special_tokens``).
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(base, _run(tokenizer, window, end, tuple((special or {}).items())), RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), special=special_tokens(public_tokenizers.path("byte_bpe_50k.json")))
