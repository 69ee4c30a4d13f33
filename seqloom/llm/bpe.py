"""Byte-level BPE by prefix dynamic programming.

Every byte prefix of a piece has exactly one valid last token: the token that the
encoding of the prefix ends with.  A token fits after another if merging the bytes
of both gives just these two; an encoding is right if all neighbours fit.  So the
last token of a prefix is found from its own suffixes and the last tokens of
shorter prefixes, is stored, and serves every piece that begins with that prefix:
appending bytes is exact and costs nothing for what is there, and after an edit
only what follows within the same piece is computed again.

A piece that is itself a token is that token (as the public encoder has it).

Defined cases: null texts count as empty, which has no ids; null doc_ids stay;
repeated rows each get a row; an empty table gives an empty result; columns beyond
id and text are not read.  Caches are bounded and start anew when full; results do
not depend on them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, table

#: Pieces kept with their ids by each worker; prefixes and pairs of tokens.
PIECES, PREFIXES, PAIRS = 200_000, 300_000, 300_000
#: Pieces up to this length look only at the prefixes that they need.
SHORT = 48
#: White space by Unicode's property, which the regex library's \\s exceeds.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def splitter(pattern: str) -> regex.Pattern:
    """The tokenizer's pattern with \\s and \\S as Unicode's White_Space."""
    pattern = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
    return regex.compile(pattern)


class PrefixEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.bytes = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.split = splitter(pattern).findall
        self.prefixes: dict[bytes, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.stable: dict[int, bool] = {}
        self.pieces: dict[str, tuple[int, str, bytes]] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Plain BPE of a few bytes: the lowest rank first, leftmost on ties."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            a, b = self.bytes[left], self.bytes[right]
            known = self.pairs[left, right] = self.merged(a + b) == [a, b]
        return known

    def whole(self, token: int) -> bool:
        known = self.stable.get(token)
        if known is None:
            known = self.stable[token] = len(self.merged(self.bytes[token])) == 1
        return known

    def last(self, prefix: bytes) -> int:
        """The last token of a short prefix; shorter ones only where needed."""
        known = self.prefixes.get(prefix)
        if known is not None:
            return known
        n = len(prefix)
        for start in range(max(0, n - self.longest), n):
            token = self.ranks.get(prefix[start:])
            if token is not None and (self.whole(token) if not start else self.fits(self.last(prefix[:start]), token)):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        if len(self.prefixes) >= PREFIXES:
            self.prefixes.clear()
        self.prefixes[prefix] = token
        return token

    def table(self, data: bytes, known: Sequence[int] = ()) -> list[int]:
        """Last tokens of all prefixes; ``known`` are those of the first ones."""
        ranks, longest, last = self.ranks, self.longest, list(known)
        for n in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, n - longest), n):
                token = ranks.get(data[start:n])
                if token is not None and (self.whole(token) if not start else self.fits(last[start - 1], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return last

    def read(self, last: Sequence[int]) -> list[int]:
        """The ids of the longest prefix of a table."""
        out, n = [], len(last)
        while n:
            out.append(last[n - 1])
            n -= len(self.bytes[last[n - 1]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) > SHORT:
            return self.read(self.table(data))
        out = []
        while data:
            out.append(self.last(data))
            data = data[: len(data) - len(self.bytes[out[-1]])]
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        return [t for piece in self.split(text) for t in self.encode_piece(piece.encode())]

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join([self.bytes[t] for t in ids])

    def known(self, piece: str) -> tuple[int, str, bytes]:
        """Number of ids, the ids as text, and their bytes again; for the cache."""
        ids = self.encode_piece(piece.encode())
        found = (len(ids), ",".join(map(str, ids)), self.decode(ids))
        if len(piece) <= SHORT:
            if len(self.pieces) >= PIECES:
                self.pieces.clear()
            self.pieces[piece] = found
        return found

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids; SHA-256 of the ids, and of the decoded bytes."""
        pieces, known = self.pieces, self.known
        found = [pieces.get(p) or known(p) for p in self.split(text)]
        return sum([f[0] for f in found]), hashlib.sha256(",".join([f[1] for f in found]).encode()).hexdigest(), hashlib.sha256(b"".join([f[2] for f in found])).hexdigest()


class Editable:
    """A text that stays encoded while it is appended to and edited."""

    def __init__(self, encoder: PrefixEncoder, text: str = "") -> None:
        self.encoder, self.pieces, self.tables = encoder, [], []
        self.replace(0, 0, text)

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    def ids(self) -> list[int]:
        e = self.encoder
        return [t for piece, last in zip(self.pieces, self.tables) for t in ([e.ranks[piece.encode()]] if piece.encode() in e.ranks else e.read(last))]

    def append(self, more: str) -> None:
        n = sum(map(len, self.pieces))
        self.replace(n, n, more)

    def replace(self, start: int, stop: int, new: str) -> None:
        """text[start:stop] = new.  Pieces are split anew from two before the edit
        up to the first old bound behind it; equal beginnings keep their tables."""
        bounds = [0]
        for piece in self.pieces:
            bounds.append(bounds[-1] + len(piece))
        first = max(sum(b < start for b in bounds) - 3, 0)
        tail = [k for k, b in enumerate(bounds) if b >= stop]
        text = self.text
        base = bounds[first]
        region = text[base:start] + new + text[stop:]
        shift = len(new) - (stop - start)
        old = {bounds[k] + shift - base: k for k in tail if bounds[k] + shift - base >= start - base + len(new)}
        pieces, at, keep = [], 0, len(self.pieces)
        for match in self.encoder.split.__self__.finditer(region):
            if at in old and at >= start - base + len(new) and pieces:
                keep = old[at]
                break
            pieces.append(match.group())
            at = match.end()
        else:
            keep = len(self.pieces)
        tables = []
        for k, piece in enumerate(pieces):
            data = piece.encode()
            same = 0
            if first + k < len(self.pieces):
                before = self.pieces[first + k].encode()
                while same < min(len(before), len(data)) and before[same] == data[same]:
                    same += 1
            tables.append(self.encoder.table(data, self.tables[first + k][:same] if same else ()))
        self.pieces[first:keep] = pieces
        self.tables[first:keep] = tables


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> PrefixEncoder:
    return PrefixEncoder(read_ranks(path), pattern)


def _run(path: str, pattern: str, with_ids: bool):
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            found = [encoder.digest(x or "") for x in batch.column(1).to_pylist()]
            cols = [pa.array(v, type=t) for v, t in zip(zip(*found), (pa.int64(), pa.string(), pa.string()))] if found else [pa.array([], t) for t in (pa.int64(), pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encoder.encode(x or "") for x in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return ids if with_ids else digests


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every text; the path must exist on every worker."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(base, _run(ranks_path, pattern, True), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, data) from (doc_id, ids): the bytes; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else encoder.decode(x) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "data"])

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, data binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the decoded bytes."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(base, _run(ranks_path, pattern, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
