"""Exact search for repeated windows of a fixed length over a whole corpus.

A sequence of items (words or bytes) has a window at each start that leaves
``window`` items.  Of the ``window - gram + 1`` grams in a window, the one of
the least hash (leftmost on ties) is its *anchor*; it depends on the window's
content alone, so equal windows always have equal anchors.  Neighbouring
windows with one anchor form a *fragment*, some ``(window - gram) / 2`` windows
long: one row where the windows would have been many.

1. Each task sorts its own fragments by (anchor, content) and sends one row for
   each distinct one.  Copies within the task are settled on the spot, so a hot
   passage reaches the shuffle once for each task that has it.
2. Rows meet by anchor, sorted, and are read as a stream that holds one row.
   An anchor that has a single row is alone and is dropped.  Copies of one
   content are settled: the first place stays.  Where one anchor has several
   contents (the paths branch), the first place of each is left ``open``.
3. Open fragments are few; the operators look at their single windows.

``traced`` verdicts carry the source of each copy: the first place of its content in
the task that settled it, or else in the corpus.  It is always an earlier place.

Places are (_did, _key, start), in that order.  Lone anchors of a task may hold
memory of at most ``FLUSH`` fragments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import _FIRST, _SECOND, U64, arrow_map, column, mix, prefix_sums, sliding_min, span_hash, stage

FLUSH = 150_000
SLICE = 1 << 22
_LOW = U64((1 << 24) - 1)

#: state: 0 alone so far, 1 has copies elsewhere in its task; 2 settled copy.
FRAGMENTS = "anchor long, content long, _did long, _key long, start int, n int, state tinyint"
TRACED = f"{FRAGMENTS}, source struct<did:long,key:long,start:int>"
_SOURCE = ("sdid", "skey", "sstart")
_TYPES = {"anchor": pa.int64(), "content": pa.int64(), "_did": pa.int64(), "_key": pa.int64(), "start": pa.int32(), "n": pa.int32(), "state": pa.int8()}


def fragments_of(items: np.ndarray, grams: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """Fragments of several sequences laid end to end.

    ``items`` are hashes of single items, ``grams[i]`` that of items[i:i+gram],
    ``offsets`` n + 1 bounds of the sequences.  Returns seq, start (within the
    sequence), n (windows), anchor, content.
    """
    w = window - gram + 1
    found: list[tuple[np.ndarray, ...]] = []
    ends = offsets[1:]
    total = len(items) - window + 1
    for low in range(0, max(total, 0), SLICE):
        high = min(low + SLICE, total)
        part = grams[low : high + w - 1]
        keys = (mix(part) & ~_LOW) | np.arange(len(part), dtype=U64)
        anchor = (sliding_min(keys, w) & _LOW).astype(np.int64)
        at = np.arange(low, high)
        seq = np.searchsorted(ends, at, "right")
        valid = at + window <= ends[seq]
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (seq[1:] != seq[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(at)))
        ok = valid[first]
        found.append((seq[first][ok], at[first][ok], count[ok], part[anchor[first][ok]]))
    if not found:
        empty = np.empty(0, np.int64)
        return {"seq": empty, "start": empty, "n": empty, "anchor": empty.astype(U64), "content": empty.astype(U64)}
    seq, at, n, anchors = (np.concatenate(x) for x in zip(*found))
    content = mix(span_hash(prefix_sums(items, _SECOND), at, at + n + window - 1, _SECOND)) + n.astype(U64)
    return {"seq": seq, "start": at - offsets[seq], "n": n, "anchor": anchors, "content": content}


def gram_hashes(items: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each ``gram`` consecutive items."""
    n = len(items) - gram + 1
    if n <= 0:
        return np.empty(0, U64)
    sums = prefix_sums(items, _FIRST)
    at = np.arange(n)
    return mix(span_hash(sums, at, at + gram, _FIRST))


def _rows(cols: dict[str, np.ndarray], types: dict = _TYPES) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[k].view(np.int64) if cols[k].dtype == U64 else cols[k], type=t) for k, t in types.items()], names=list(types))


def _settle(held: list[dict[str, np.ndarray]], traced: bool) -> pa.RecordBatch:
    """One task's fragments: later copies become settled rows (state 2)."""
    c = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
    order = np.lexsort((c["start"], c["_key"], c["_did"], c["content"], c["anchor"]))
    c = {k: v[order] for k, v in c.items()}
    n = len(order)
    same = np.zeros(n, bool)
    same[1:] = (c["anchor"][1:] == c["anchor"][:-1]) & (c["content"][1:] == c["content"][:-1])
    place = np.zeros(n, bool)  # the very place of the row before: a repeated row
    place[1:] = same[1:] & (c["_did"][1:] == c["_did"][:-1]) & (c["_key"][1:] == c["_key"][:-1]) & (c["start"][1:] == c["start"][:-1])
    keep = ~place
    c, same = {k: v[keep] for k, v in c.items()}, same[keep]
    state = np.where(same, 2, 0).astype(np.int8)
    copied = np.flatnonzero(same)
    firsts = np.flatnonzero(~same)
    state[firsts[np.unique(np.searchsorted(firsts, copied, "right") - 1)]] = 1
    # what is settled no longer meets by anchor; its rows are dealt by place
    settled = state == 2
    c["anchor"] = np.where(settled, mix(c["_did"].view(U64) + c["start"].astype(U64)), c["anchor"])
    out = _rows(c | {"state": state})
    if not traced:
        return out
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    places = [pa.array(c[k][first], type=_TYPES[k]) for k in ("_did", "_key", "start")]
    source = pa.StructArray.from_arrays(places, names=["did", "key", "start"], mask=pa.array(~settled))
    return pa.RecordBatch.from_arrays([*out.columns, source], names=[*out.schema.names, "source"])


def fragment_rows(extract: Callable[[pa.RecordBatch], Iterator[dict[str, np.ndarray]]], traced: bool) -> Callable:
    """mapInArrow function: fragments of texts as rows of FRAGMENTS or TRACED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for got in extract(batch):
                if len(got["start"]):
                    held.append(got)
                    size += len(got["start"])
                if size >= FLUSH:
                    yield _settle(held, traced)
                    held, size = [], 0
        if held:
            yield _settle(held, traced)

    return run


VERDICTS = "anchor long, _did long, _key long, start int, n int, open boolean, copy boolean"
_VERDICTS = {"anchor": pa.int64(), "_did": pa.int64(), "_key": pa.int64(), "start": pa.int32(), "n": pa.int32(), "open": pa.bool_(), "copy": pa.bool_()}
_TRACES = {"sdid": pa.int64(), "skey": pa.int64(), "sstart": pa.int32()}


def _judge(batches: Iterator[pa.RecordBatch], both: bool, traced: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, content, place) -> verdicts, as a stream.

    Only the first row of the content at hand waits, until another content or
    anchor follows.  ``both``: the first of several copies is a copy too.
    """
    wait: dict[str, np.ndarray] | None = None
    last: tuple = ()
    branch = copied = False  # of the waiting row: its anchor had a content before; it has copies
    types = _VERDICTS | _TRACES if traced else _VERDICTS
    for batch in batches:
        if not batch.num_rows:
            continue
        c = {k: column(batch, k) for k in _TYPES}
        if traced:
            source = batch.column(batch.schema.get_field_index("source"))
            c |= {k: source.field(i).fill_null(0).to_numpy(zero_copy_only=False) for i, k in enumerate(_SOURCE)}
        if wait is not None:
            c = {k: np.concatenate([wait[k], c[k]]) for k in c}
        n = len(c["anchor"])
        settled = c["state"] == 2
        new_a, place = np.ones(n, bool), np.zeros(n, bool)
        new_a[1:] = (c["anchor"][1:] != c["anchor"][:-1]) | settled[1:] | settled[:-1]
        new_c = new_a.copy()
        new_c[1:] |= c["content"][1:] != c["content"][:-1]
        place[1:] = ~new_c[1:] & np.logical_and.reduce([c[k][1:] == c[k][:-1] for k in ("_did", "_key", "start")])
        if wait is not None and n > 1:
            place[1] = not new_c[1] and (c["_did"][1], c["_key"][1], c["start"][1]) == last
        group, path = np.cumsum(new_a) - 1, np.cumsum(new_c) - 1
        contents = np.bincount(group, weights=new_c)
        contents[0] += branch
        many = (np.bincount(path, weights=~place) > 1) | (np.bincount(path, weights=c["state"] == 1) > 0)
        many[0] |= copied
        is_open = new_c & (contents[group] > 1) & ~settled
        copy = settled | (~new_c & ~place)
        if both:
            copy |= new_c & many[path]
        hold = int(np.flatnonzero(new_c)[-1])
        give = is_open | copy
        give[hold] = False
        if traced:
            first = np.flatnonzero(new_c)[path]
            trace = {s: np.where(settled, c[s], c[k][first])[give] for s, k in zip(_SOURCE, ("_did", "_key", "start"))}
        if give.any():
            yield _rows({k: c[k][give] for k in ("anchor", "_did", "_key", "start", "n")} | {"open": is_open[give], "copy": copy[give]} | (trace if traced else {}), types)
        branch = not new_a[hold] or (hold == 0 and branch)
        copied = bool(many[-1])
        wait = {k: v[[hold]] for k, v in c.items()}
        last = (c["_did"][-1], c["_key"][-1], c["start"][-1])
    if wait is not None:
        settled = bool(wait["state"][0] == 2)
        is_open, copy = branch and not settled, settled or (both and copied)
        if is_open or copy:
            trace = {s: wait[s if settled else k] for s, k in zip(_SOURCE, ("_did", "_key", "start"))} if traced else {}
            yield _rows({k: wait[k] for k in ("anchor", "_did", "_key", "start", "n")} | {"open": np.array([is_open]), "copy": np.array([copy])} | trace, types)


def verdicts(docs: DataFrame, extract: Callable, both: bool, label: str, traced: bool = False) -> DataFrame:
    """Staged verdicts on the fragments of ``docs`` (doc_id, text, _did, _key)."""
    rows = arrow_map(docs.select("_did", "_key", "text"), fragment_rows(extract, traced), TRACED if traced else FRAGMENTS)
    dealt = rows.repartition("anchor").sortWithinPartitions("anchor", "content", "_did", "_key", "start")
    return stage(arrow_map(dealt, lambda batches: _judge(batches, both, traced), f"{VERDICTS}, sdid long, skey long, sstart int" if traced else VERDICTS), label)


def spans_by_text(spans: DataFrame) -> DataFrame:
    """(_did, _key, spans): all (start, n) of a text, a set bounded by the text."""
    return spans.groupBy("_did", "_key").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def covered(n: int, starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Mask of the items in any of the windows [start, start + n) of a text."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + counts - 1 + window, n), -1)
    return np.cumsum(edge[:-1]) > 0
