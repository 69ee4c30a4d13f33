"""Information-theoretic sanitisation of personal data.

Protected entities are the e-mail addresses, IP addresses, card and telephone
numbers of the texts, and *identifiers*: runs of letters and digits (keys, tokens)
that carry so much information that chance did not write them.  That is measured by
the corpus: -log2 p(b | a) of each pair of bytes, summed over the different pairs of
a run, reaches ``IDENTIFIER`` bits, and ``RATE`` bits for each of its bytes.  An
identifier tells itself, so it is a term span that is removed.

Terms are the words with a letter or digit, outside of entities.  For an entity e
and a term t of its documents, with N documents,

    IC(e)     = -log2(n(e) / N)
    PMI(e; t) =  log2(n(e, t) * N / (n(e) * n(t)))

where n counts documents, over the whole corpus.  PMI reaches IC(e) when t never
occurs without e, that is, when t tells e.  A term that shares ``SUPPORT``
different texts with e (copies of a text count once) is *generalised* from
``GENERALISE`` * IC(e) and *removed* from ``REMOVE`` * IC(e) on, wherever it
occurs in documents that hold e.

One pass counts pairs of bytes (at most 2**16 sums), one finds entities and the
words of documents that hold any, another counts the documents of every word, and
the last those of every entity and word, all summed within tasks before the shuffle.  Entities of fewer than ``SUPPORT`` texts
can have no such term and are left out of it.  Texts are not shuffled by ``find``.

Defined cases: null texts count as empty; null doc_ids stay; repeated rows each
get a row, and count as documents; an empty table gives an empty result; columns
beyond id and text are not read by ``find`` and pass through ``sanitise``.  Numbers
of any length are handled in time proportional to the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import _LOWER, arrow_map, chunks, keyed, keyed_rows, rewrite, stage, table, text_bytes, tidy, word_hashes, words

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT = 3
GENERALISE, REMOVE = 0.9, 0.98
#: Bits that make a run an identifier: as a whole, and for each byte.
IDENTIFIER, RATE = 110.0, 4.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(r"[A-Za-z0-9_-]{15,}")
_ALNUM = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_PAIR = "0246813579"  # Luhn: twice a digit, its digits summed


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every @ with the longest local part before it and a domain behind it."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else int(_PAIR[int(d)]) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, sorted; leftmost, no overlap
    within a kind, failing matches dropped."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(x := g.lstrip("0")) < 4 and int(x or 0) < 256 for g in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def pair_bits(counts: np.ndarray) -> np.ndarray:
    """-log2 p(b | a) for all pairs of bytes from their counts, one added to each."""
    counts = counts.reshape(256, 256) + 1.0
    return -np.log2(counts / counts.sum(1, keepdims=True)).ravel()


def identifiers(text: str, spans: list[tuple[int, int, int]], bits: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind number of terms, stop) of the identifiers that touch no span."""
    out = []
    for m in _RUN.finditer(text):
        low = np.frombuffer(m.group().encode().lower(), np.uint8).astype(np.int64)
        told = bits[np.unique(low[:-1] * 256 + low[1:])].sum()
        if told >= IDENTIFIER and told >= RATE * len(low) and all(b <= m.start() or m.end() <= a for a, _, b in spans):
            out.append((m.start(), 4, m.end()))
    return out


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n): pairs of bytes of the lower-cased texts, summed over a task."""
    sums = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for part in chunks(batch):
            raw, offsets = text_bytes(part.column(0))
            low = _LOWER[raw].astype(np.uint16)
            code = (low[:-1] << 8) | low[1:]
            inside = np.ones(len(code), bool)
            cuts = offsets[1:-1]
            inside[cuts[(cuts > 0) & (cuts < len(low))] - 1] = False
            sums += np.bincount(code[inside], minlength=1 << 16)
    seen = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(sums[seen])], names=["pair", "n"])


def information(docs: DataFrame) -> np.ndarray:
    """``pair_bits`` of the corpus."""
    counted = arrow_map(docs.select("text"), _pairs, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = np.zeros(1 << 16)
    for row in counted.collect():  # at most 2**16 rows, whatever the corpus
        counts[row.pair] = row.n
    return pair_bits(counts)


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x.encode()) - (1 << 63)


def entity_of(text: str, span: tuple[int, int, int]) -> int:
    start, kind, stop = span
    return _hash(f"{kind}:{re.sub('[^A-Za-z0-9.@]', '', text[start:stop]).translate(_ASCII_LOWER)}")


def terms(text: str, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (as ``word_hashes`` of lower-cased words), starts and stops of all
    words with a letter or digit that touch no span."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
    low = _LOWER[raw]
    starts, ends, _ = words(low, np.array([0, len(low)]))
    place = np.cumsum((raw & 0xC0) != 0x80)
    covered = np.zeros(len(text) + 1, np.int64)
    for a, _, b in spans:
        covered[a + 1 : b + 1] = 1
    covered = np.cumsum(covered)
    alnum = np.concatenate([[0], np.cumsum(_ALNUM[raw])])
    begin, stop = place[starts] - 1, place[ends - 1]
    keep = (covered[stop] == covered[begin]) & (alnum[ends] > alnum[starts])
    return word_hashes(low, starts[keep], ends[keep]).view(np.int64), begin[keep].astype(np.int32), stop[keep].astype(np.int32)


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))
FOUND = "doc_id long, _did long, _key long, _row long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, own array<struct<start:int,kind:int,stop:int>>, _copy long, entities array<long>, words array<struct<term:long,start:int,stop:int>>"


def _scan(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 33
        for whole in batches:
            for batch in chunks(whole):
                counts, shas, own, copies, entities, found = [], [], [], [], [], []
                for text in batch.column(3).to_pylist():
                    spans = base_spans(text)
                    counts.append([sum(k == i for _, k, _ in spans) for i in range(4)])
                    shas.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest())
                    spans = sorted(spans + identifiers(text, spans, bits))
                    own.append([{"start": a, "kind": k, "stop": b} for a, k, b in spans])
                    copies.append(_hash(text))
                    entities.append(sorted({entity_of(text, x) for x in spans}))
                    found.append(terms(text, spans) if spans else terms("", []))
                n = batch.num_rows
                flat = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["term", "start", "stop"])
                near = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x[0]) for x in found)]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(np.arange(row, row + n)), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4)), pa.array(shas, pa.string()), pa.array(own, _SPAN), pa.array(copies, pa.int64()), pa.array(entities, pa.list_(pa.int64())), near],
                    names=["doc_id", "_did", "_key", "_row", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "own", "_copy", "entities", "words"],
                )
                row += n

    return run


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entity, term, docs, texts) from (first, entities, words), each row a document
    and the first of its copies or not, summed over some millions of them."""
    held, size = [], 0

    def give() -> pa.RecordBatch:
        entity, term, first = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((term, entity))
        entity, term, first = entity[order], term[order], first[order]
        at = np.flatnonzero(np.concatenate([[True], (entity[1:] != entity[:-1]) | (term[1:] != term[:-1])]))
        docs = np.diff(np.append(at, len(entity)))
        return pa.RecordBatch.from_arrays([pa.array(entity[at]), pa.array(term[at]), pa.array(docs), pa.array(np.add.reduceat(first, at))], names=["entity", "term", "docs", "texts"])

    for batch in batches:
        for i in range(batch.num_rows):
            own = np.unique(batch.column(2).slice(i, 1).flatten().field("term").to_numpy(zero_copy_only=False))
            first = np.full(len(own), int(batch.column(0)[i].as_py()), np.int64)
            for entity in batch.column(1)[i].as_py() if len(own) else ():
                held.append((np.full(len(own), entity, np.int64), own, first))
                size += len(own)
                if size >= 1_000_000:
                    yield give()
                    held, size = [], 0
    if size:
        yield give()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): documents of each word, summed over some millions of words."""
    held, size = [], 0

    def give() -> pa.RecordBatch:
        terms, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], names=["term", "n"])

    for batch in batches:
        for part in chunks(batch):
            raw, offsets = text_bytes(part.column(0))
            raw = _LOWER[raw]
            starts, ends, bounds = words(raw, offsets)
            hashes = word_hashes(raw, starts, ends)
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
            order = np.lexsort((hashes, doc))
            hashes, doc = hashes[order], doc[order]
            first = np.ones(len(hashes), bool)
            first[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
            held.append(hashes[first])
            size += int(first.sum())
            if size >= 3_000_000:
                yield give()
                held, size = [], 0
    if size:
        yield give()


def near_entities(found: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(_row, first, entities, words) of the documents that hold entities of at least
    ``support`` different texts, with these; ``first`` of the copies of a text."""
    held = found.filter("size(entities) > 0").select("_row", "_copy", "entities")
    each = held.select("_row", "_copy", F.explode("entities").alias("entity"))
    often = each.select("entity", "_copy").distinct().groupBy("entity").count().filter(F.col("count") >= support).select("entity")
    rows = each.join(often, "entity").groupBy("_row").agg(F.collect_list("entity").alias("entities"))
    firsts = held.groupBy("_copy").agg(F.min("_row").alias("_row")).select("_row", F.lit(True).alias("first"))
    rows = rows.join(firsts, "_row", "left").select("_row", F.coalesce("first", F.lit(False)).alias("first"), "entities")
    return rows.join(found.select("_row", "words"), "_row")


def disclosing(found: DataFrame, near: DataFrame, docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(entity, term, removed): pairs whose PMI exceeds the thresholds."""
    total = max(found.count(), 1)
    pairs = arrow_map(near.select("first", "entities", "words"), _together, "entity long, term long, docs long, texts long")
    pairs = pairs.groupBy("entity", "term").agg(F.sum("docs").alias("both"), F.sum("texts").alias("texts")).filter(F.col("texts") >= support)
    entities = near.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("with_entity"))
    counted = arrow_map(docs.select("text"), _frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("with_term"))
    joined = pairs.join(entities, "entity").join(counted, "term")
    ic = -F.log2(F.col("with_entity") / F.lit(total))
    pmi = F.log2(F.least("both", "with_term") * F.lit(float(total)) / (F.col("with_entity") * F.col("with_term")))
    # an entity of every document tells nothing, and nothing tells it
    return joined.filter((ic > 0) & (pmi >= generalise * ic)).select("entity", "term", (pmi >= remove * ic).alias("removed"))


@tidy
def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """One row per document: the base counts and digest, and ``found``: all spans
    (start, kind number, stop, removed), sorted."""
    base = keyed(docs, id_col, text_col)
    found = stage(arrow_map(base.select("doc_id", "_did", "_key", "text"), _scan(information(base)), FOUND), "entities")
    near = stage(near_entities(found, support), "near-entities")
    telling = stage(disclosing(found, near, base, support, generalise, remove), "telling")
    words_ = near.select("_row", F.explode("entities").alias("entity"), "words").select("_row", "entity", F.explode("words").alias("x")).select("_row", "entity", "x.term", "x.start", "x.stop")
    terms = words_.join(telling, ["entity", "term"]).groupBy("_row", "start", "stop").agg(F.max("removed").alias("removed"))
    terms = terms.groupBy("_row").agg(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "stop", "removed")).alias("terms"))
    joined = found.join(terms, "_row", "left")
    own = F.transform("own", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"), F.lit(True).alias("removed")))
    return joined.withColumn("found", F.array_sort(F.when(F.col("terms").isNull(), own).otherwise(F.concat(own, "terms")))).drop("own", "words", "entities", "_copy", "terms", "_row")


def redact(text: str, spans: list) -> str:
    """Base kinds and removed terms become a label; other terms are generalised."""
    out, at = [], 0
    for start, kind, stop, removed in spans:
        if start < at:
            if stop <= at:
                continue
            start = at
        word = text[start:stop]
        label = f"<{KINDS[kind]}>" if kind < 4 else "<removed>" if removed else "<number>" if any(c.isdigit() for c in word) else "<name>" if word[:1].isupper() else "<word>"
        out += [text[at:start], label]
        at = stop
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs``, all columns, with what was found replaced in the texts."""
    spans = find(docs, id_col, text_col, **options).filter("size(found) > 0").groupBy("_did", "_key").agg(F.first("found").alias("found"))
    base = keyed_rows(docs, id_col, text_col)

    def replaced(text: str, found: pa.Array) -> str:
        return redact(text, [(s["start"], s["kind"], s["stop"], s["removed"]) for s in found.to_pylist()])

    return rewrite(base.join(spans, ["_did", "_key"], "left"), docs, text_col, "found", replaced)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    kinds = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform("found", lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"), F.size("found").cast("long").alias("n_spans"), F.size(F.filter("found", lambda x: x["kind"] == 4)).cast("long").alias("n_terms"))
