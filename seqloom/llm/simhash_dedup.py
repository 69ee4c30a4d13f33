"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into ``blocks`` blocks.  Of two fingerprints that differ in
at most ``distance`` bits, at least ``blocks - distance`` blocks are equal, so
they share one of the keys made of that many blocks.  Distinct fingerprints are
joined on these keys and each pair's Hamming distance is verified.

A key with more than ``crowd`` fingerprints is not paired: each of its
fingerprints is linked to the values one bit away from it.  Two values differ in
at most two bits exactly if they, or values one bit from them, coincide, so the
components are the same with 64 rows for a fingerprint instead of all pairs (for
``distance`` 1 or 2, which is all that is offered).

``similar_groups`` finds documents of a Jaccard similarity, which needs more bits
than 64 and a share of them as the limit; blocks, join and check are the same.

Copies share a fingerprint (there: a set of shingles) and are one node.  Components come from
``_components``; nothing is gathered on the driver.

Defined cases: null, empty and blank texts have fingerprint zero and link like
any other; a null doc_id takes part but is never a component's id (null if all
members' ids are null); repeated rows each get a row; an empty table gives an
empty result; columns beyond id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import _LETTER, _LOWER, U64, arrow_map, chunks, mix, stage, table, text_bytes, tidy, word_hashes, words
from ._components import components
from ._repeats import gram_hashes

BLOCKS = 5
CROWD = 64
#: Similarity of whole documents: words of a shingle, least Jaccard similarity,
#: least 64-bit words of a fingerprint, blocks of a group, and the fingerprints of a
#: key up to which all pairs are compared at once.
SIZE, SIMILARITY, WIDTH, GROUP, FEW = 5, 0.8, 16, 6, 8
#: The least chance that a pair at that similarity shares a key.
RECALL = 0.96
#: One in so many groups of keys is met before all others.
AHEAD = 4
#: The 64-bit words of a fingerprint that travel with its keys.
CARRIED = 4
#: Nodes that are compared with as many others at once, and bytes of their texts.
SIDE, SIDE_BYTES = 256, 1 << 23


def _share(similarity: float) -> float:
    """The share of bits in which texts of a Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def key_plan(n: int, similarity: float = SIMILARITY, recall: float = RECALL, group: int = GROUP) -> tuple[int, int, int]:
    """Bits of a block, groups, 64-bit words for n documents.

    Keys of two blocks have at least 16 times as many values as there are
    documents, so chance meetings grow as the documents do, not as their square;
    as many groups as ``recall`` needs.
    """
    bits = math.ceil(math.log2(max(n, 256)) / 2) + 2
    p = (1 - _share(similarity)) ** bits
    fewer = (1 - p) ** group + group * p * (1 - p) ** (group - 1)
    groups = math.ceil(math.log(1 - recall) / math.log(fewer))
    return bits, groups, max(WIDTH, math.ceil(bits * groups * group / 64))


def _shape(raw: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts, lower-cased and each followed by one space."""
    raw = _LOWER[raw]
    starts, ends, bounds = words(raw, offsets)
    lengths = ends - starts
    keep = _LETTER[raw]
    extra = np.zeros(len(raw) + 1, np.int64)
    np.add.at(extra, ends, 1)
    shift = np.cumsum(extra)[:-1]
    at = np.flatnonzero(keep)
    out = np.full(len(at) + len(starts), 32, np.uint8)
    rank = np.arange(len(at))
    out[rank + shift[at]] = raw[at]
    new_ends = np.cumsum(lengths + 1) - 1
    return out.tobytes(), new_ends - lengths, new_ends, bounds


def fingerprints(raw: np.ndarray, offsets: np.ndarray, size: int = 3) -> np.ndarray:
    """SimHash of each text: bit set if it is in over half the shingles' XXH64."""
    data, starts, ends, bounds = _shape(raw, offsets)
    s, e = starts.tolist(), ends.tolist()
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(offsets) - 1, U64)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if a == b:
            continue
        n = max(b - a - size + 1, 1)
        hashes = np.array([digest(data[x:y], 42) for x, y in zip(s[a : a + n], e[min(a + size, b) - 1 : b])], dtype=U64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
        ones = bits.sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > n, bitorder="little").view(U64)[0]
    return out


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            found = fingerprints(*text_bytes(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def _keys(blocks: int, distance: int) -> Column:
    """The pigeonhole keys of ``fp``: (which blocks, their bits)."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return F.array(*(F.struct(F.lit(i).cast("short").alias("which"), F.col("fp").bitwiseAND(F.lit(signed(sum(masks[k] for k in kept)))).alias("bits")) for i, kept in enumerate(combinations(range(blocks), blocks - distance))))


def links(fps: DataFrame, distance: int = 2, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """Distinct ``fp`` -> (u, v) whose components are those of Hamming distance
    at most ``distance``; of crowded keys, v may be a value that no text has."""
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2")
    keyed = fps.select("fp", F.explode(_keys(blocks, distance)).alias("k")).select("fp", "k.which", "k.bits")
    crowded = stage(keyed.groupBy("which", "bits").count().filter(F.col("count") > crowd).select("which", "bits"), "crowded-keys")
    sparse = keyed.join(crowded, ["which", "bits"], "left_anti").groupBy("which", "bits").agg(F.collect_list("fp").alias("fps")).filter("size(fps) > 1")
    pairs = sparse.select(F.explode("fps").alias("u"), "fps").select("u", F.explode("fps").alias("v"))
    pairs = pairs.filter((F.col("u") > F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance))
    members = keyed.join(crowded, ["which", "bits"], "left_semi").select("fp").distinct()
    flips = F.array(*(F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)))
    if distance == 1:
        near = members.select(F.col("fp").alias("u"), F.explode(flips).alias("x")).select("u", F.col("u").bitwiseXOR(F.col("x")).alias("v"))
        near = near.join(fps.select(F.col("fp").alias("v")), "v", "left_semi").select("u", "v")
    else:
        near = members.select(F.col("fp").alias("u"), F.explode(F.concat(F.array(F.lit(0).cast("long")), flips)).alias("x")).select("u", F.col("u").bitwiseXOR(F.col("x")).alias("v"))
        met = near.groupBy("v").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("v")
        near = near.join(met, "v").select("u", "v").filter("u <> v")
    return pairs.unionByName(near)


@tidy
def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = stage(arrow_map(base, _run, "doc_id long, fp long"), "fingerprints")
    firsts = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    return _named(found, firsts, links(firsts.select("fp"), distance, blocks, crowd)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _named(found: DataFrame, firsts: DataFrame, linked: DataFrame) -> DataFrame:
    """(doc_id, fp) with the least id of the component of each fp."""
    roots = components(linked)
    rooted = stage(firsts.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", "fp", "component_id")


# ------------------------------------------------- similarity of whole documents


def wide_fingerprints(raw: np.ndarray, offsets: np.ndarray, size: int = SIZE, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each text's set of shingles, and rows of ``width`` 64-bit words: the
    first from the distinct shingles' XXH64 itself, the others from hashes of it."""
    data, starts, ends, bounds = _shape(raw, offsets)
    s, e = starts.tolist(), ends.tolist()
    digest = xxhash.xxh64_intdigest
    salts = mix(np.arange(1, width, dtype=U64) * U64(0x9E3779B97F4A7C15))
    out = np.zeros((len(offsets) - 1, width), U64)
    sets = np.zeros(len(out), U64)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if a == b:
            continue
        n = max(b - a - size + 1, 1)
        hashes = np.unique(np.array([digest(data[x:y], 42) for x, y in zip(s[a : a + n], e[min(a + size, b) - 1 : b])], dtype=U64))
        n, sets[i] = len(hashes), digest(hashes.tobytes(), 42)
        ones = np.zeros(64 * width, np.int64)
        for low in range(0, n, 255):  # as many rows as bytes can count
            part = hashes[low : low + 255, None]
            rows = np.concatenate([part, mix(part ^ salts)], axis=1)
            ones += np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
        out[i] = np.packbits(2 * ones > n, bitorder="little").view(U64)
    return sets, out


def block_keys(prints: np.ndarray, bits: int, groups: int, group: int = GROUP) -> np.ndarray:
    """The keys of each fingerprint: blocks of ``bits`` bits, ``group`` of them a
    group, and each two blocks of a group a key."""
    flat = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")[:, : groups * group * bits].astype(np.int64)
    values = flat.reshape(len(prints), groups, group, bits) @ (1 << np.arange(bits))
    pairs = np.array(list(combinations(range(group), 2)))
    keys = (values[:, :, pairs[:, 0]] << bits) | values[:, :, pairs[:, 1]]
    return (keys + (np.arange(groups * len(pairs)).reshape(groups, -1) << (2 * bits))).reshape(len(prints), -1)


def _wide(size: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sets, found = (x.view(np.int64) for x in wide_fingerprints(*text_bytes(part.column(1)), size, width))
                wide = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, width, dtype=np.int32)), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sets), wide], names=["doc_id", "sum", "fp", "wide"])

    return run


def _key_rows(bits: int, groups: int, width: int, begin: int, end: int):
    """The keys of the groups from ``begin`` to before ``end``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                prints = batch.column(2).flatten().to_numpy().view(U64).reshape(-1, width)
                keys = block_keys(prints, bits, groups)
                each = keys.shape[1] // groups
                keys = keys[:, begin * each : end * each]
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.ravel()))
                first = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(prints[:, :CARRIED]).view(np.int64).ravel()), CARRIED)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), first.cast(pa.list_(pa.int64())), rows], names=["fp", "root", "some", "keys"])

    return run


def _apart(u: str, v: str) -> Column:
    return F.bit_count(F.col(u).bitwiseXOR(F.col(v)))


@tidy
def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, similarity: float = SIMILARITY, crowd: int = FEW) -> DataFrame:
    """doc_id, component_id of documents alike by shingles of ``size`` words.

    Two documents of Jaccard similarity J differ, on average, in a share of
    acos(2 J / (1 + J)) / pi of their fingerprints' bits.  Pairs three standard
    deviations above that share for ``similarity`` are not linked; all others are
    decided by their sets of shingles, as only equal sets are one node.  Candidates share
    two blocks of a group: at ``similarity`` with the chance RECALL, at 0.9 with one
    of over 0.999 (see ``key_plan``).

    In a key with more than ``crowd`` fingerprints each is first compared with the
    least of them: members alike to it are one component.  What is in different
    components after that is compared pair by pair (see ``_dense``).

    A few groups of keys are met first.  Of the others, a key whose fingerprints
    are one component by then can link nothing new and is left out, as is a pair
    within one component: most of the work on a large group of near copies.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("sum"))
    bits, groups, width = key_plan(docs.count(), similarity)
    found = stage(arrow_map(base, _wide(size, width), "doc_id long, sum long, fp long, wide array<long>"), "fingerprints")
    firsts = stage(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "sum", "wide")).alias("one")).select("fp", "least", "one.*"), "prints")
    ahead = -(-groups // AHEAD)
    crowds = []

    def linked(nodes: DataFrame, begin: int, end: int) -> DataFrame:
        keyed = arrow_map(nodes, _key_rows(bits, groups, width, begin, end), "fp long, root long, some array<long>, keys array<long>")
        keyed = keyed.select("fp", "root", *(F.col("some")[i].alias(f"w{i}") for i in range(CARRIED)), F.explode("keys").alias("key"))
        pairs, members = _candidates(keyed, similarity, crowd)
        crowds.append(members)
        return _alike(_judged(pairs, firsts, width, similarity), firsts, base, size, similarity)

    early = stage(components(linked(firsts.select("fp", F.col("fp").alias("root"), "wide"), 0, ahead)), "early")
    roots = early
    if ahead < groups:
        late = linked(_rooted(firsts, early), ahead, groups)
        roots = stage(components(early.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(late)), "late")
    members = crowds[0] if len(crowds) == 1 else crowds[0].unionByName(crowds[1])
    dense = stage(_dense(members, _rooted(firsts, roots), width, similarity), "dense")
    links = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(_alike(dense, firsts, base, size, similarity))
    return _named(found.select("doc_id", "fp"), firsts.select("fp", "least"), links).select("doc_id", "component_id")


def _rooted(firsts: DataFrame, roots: DataFrame) -> DataFrame:
    return firsts.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "wide")


def _candidates(keyed: DataFrame, similarity: float, crowd: int) -> tuple[DataFrame, DataFrame]:
    """(fp, root, w0.., key) -> distinct pairs (u, v) of different roots that share a
    key, of crowded keys with its least only; and the (fp, key) of crowded keys."""
    meetings = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("fp", "root", "w0")).alias("leader"), F.min("root").alias("low"), F.max("root").alias("high"))
    meetings = stage(meetings.filter("low < high").select("key", "n", "leader"), "meetings")
    # most keys meet no other: the rest are few, and are hashed, not sorted
    met = stage(keyed.join(meetings.hint("shuffle_hash"), "key"), "met")
    most = _share(similarity)
    # a few words' distance, four deviations above its mean, spares most comparisons
    rough = [math.ceil(64 * n * most + 4 * math.sqrt(64 * n * most * (1 - most))) for n in (1, CARRIED)]
    names = [f"w{i}" for i in range(CARRIED)]
    sparse = met.filter(F.col("n") <= crowd).groupBy("key").agg(F.collect_list(F.struct("fp", "root", *names)).alias("all"))
    each = sparse.select(F.explode("all").alias("one"), "all")

    def close(o: Column) -> Column:
        apart = sum((F.bit_count(o[x].bitwiseXOR(F.col("one")[x])) for x in names), F.lit(0))
        return (o["fp"] < F.col("one.fp")) & (o["root"] != F.col("one.root")) & (apart <= rough[1])

    near = each.select(F.col("one.fp").alias("u"), F.explode(F.filter("all", close)).alias("o")).select("u", F.col("o.fp").alias("v"))
    stars = met.filter((F.col("n") > crowd) & (F.col("root") != F.col("leader.root"))).filter(_apart("w0", "leader.w0") <= rough[0]).select(F.col("fp").alias("u"), F.col("leader.fp").alias("v"))
    return stage(near.unionByName(stars).distinct(), "candidates"), met.filter(F.col("n") > crowd).select("fp", "key")


def _dense(members: DataFrame, rooted: DataFrame, width: int, similarity: float) -> DataFrame:
    """All pairs (u, v) of different roots in crowded keys whose fingerprints do not
    rule them out.

    A key's members are dealt into sides of about ``SIDE``, and each side meets each:
    no task holds a whole key, and no pair is left out.
    """
    each = members.groupBy("fp").agg(F.collect_list("key").alias("keys")).join(rooted.select("fp", "root"), "fp")
    met = stage(each.select("fp", "root", F.explode("keys").alias("key")), "crowds")
    keys = met.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    open_ = met.join(keys.select("key", "n"), "key").groupBy("fp").agg(F.collect_list(F.struct("key", "n")).alias("keys"))
    wide = open_.join(rooted, "fp").select("fp", "root", "wide", F.col("keys.key").alias("all_keys"), F.explode("keys").alias("k"))
    sides = F.ceil(F.col("k.n") / SIDE).cast("int")
    dealt = wide.select("fp", "root", "wide", "all_keys", "k.key", sides.alias("sides"), F.pmod(F.xxhash64("fp"), sides).cast("int").alias("own"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.struct("fp", "root", "own", "wide", "all_keys").alias("one"))
    blocks = dealt.groupBy("key", "low", "high").agg(F.collect_list("one").alias("all"))
    limit = _limit(width, similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                all_ = batch.column(2).slice(i, 1).flatten()
                fp, root, own = (all_.field(k).to_numpy() for k in ("fp", "root", "own"))
                prints = all_.field("wide").flatten().to_numpy().view(U64).reshape(len(fp), -1)
                a, b = (np.flatnonzero(own == batch.column(k)[i].as_py()) for k in (0, 1))
                x, y = close_pairs(prints[a], prints[b], root[a], root[b], limit)
                x, y = a[x], b[y]
                if batch.column(0)[i] == batch.column(1)[i]:  # a side meets itself: each pair once
                    x, y = x[x < y], y[x < y]
                # a pair is given out under the least key that both have
                key, keys = batch.column(3)[i].as_py(), {j: set(all_.field("all_keys")[j].as_py()) for j in {*x.tolist(), *y.tolist()}}
                least = np.array([min(keys[j] & keys[k]) == key for j, k in zip(x.tolist(), y.tolist())], bool)
                u, v = fp[x[least]], fp[y[least]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    return arrow_map(blocks.select("low", "high", "all", "key"), run, "u long, v long").distinct()


def close_pairs(a: np.ndarray, b: np.ndarray, root_a: np.ndarray, root_b: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of other roots at most ``limit`` bits apart."""
    apart = np.zeros((len(a), len(b)), np.int32)
    for word in range(a.shape[1]):
        apart += np.bitwise_count(a[:, word, None] ^ b[None, :, word])
    return np.nonzero((apart <= limit) & (root_a[:, None] != root_b[None, :]))


def _limit(width: int, similarity: float) -> int:
    """Bits above which pairs surely are not alike."""
    most = _share(similarity)
    return int(64 * width * most + 3 * math.sqrt(64 * width * most * (1 - most)))


def _judged(pairs: DataFrame, firsts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs whose whole fingerprints do not rule them out."""
    left, right = (firsts.select(F.col("fp").alias(n), F.col("wide").alias(f"wide_{n}")) for n in "uv")
    distance = F.aggregate(F.zip_with("wide_u", "wide_v", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    return stage(pairs.join(left, "u").join(right, "v").filter(distance <= _limit(width, similarity)).select("u", "v"), "scored")


def _alike(pairs: DataFrame, firsts: DataFrame, base: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (staged) whose texts have that Jaccard similarity, exactly.

    Nodes are dealt to sides of about ``SIDE`` of them, and pairs to the pairs of
    their sides.  There each text comes once, however many pairs it is in, and only
    the sets of one pair of sides are in memory.
    """
    ends = pairs.select(F.col("u").alias("fp")).unionByName(pairs.select(F.col("v").alias("fp"))).distinct()
    nodes = ends.join(firsts, "fp").select("fp", F.col("doc_id").alias("_id"), F.col("sum").alias("_sum"))
    one = base.join(nodes, base["doc_id"].eqNullSafe(nodes["_id"]) & base["sum"].eqNullSafe(nodes["_sum"])).select("fp", "text")
    texts = stage(one.dropDuplicates(["fp"]), "texts")
    n, held = texts.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    sides = max(1, -(-n // SIDE), -(-(held or 0) // SIDE_BYTES))
    side = lambda c: F.pmod(F.xxhash64(c), F.lit(sides)).cast("int")
    met = pairs.select(side("u").alias("a"), side("v").alias("b"), "u", "v")
    members = met.select("a", "b", F.col("u").alias("fp")).unionByName(met.select("a", "b", F.col("v").alias("fp"))).distinct().join(texts, "fp")
    members = members.select("a", "b", F.lit(0).alias("pair"), F.col("fp").alias("u"), F.lit(0).cast("long").alias("v"), "text")
    rows = members.unionByName(met.select("a", "b", F.lit(1).alias("pair"), "u", "v", F.lit(None).cast("string").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        current = None
        for batch in batches:
            for part in chunks(batch):
                found = []
                for a, b, pair, u, v, text in zip(*(c.to_pylist() for c in part.columns)):
                    if (a, b) != current:
                        sets, current = {}, (a, b)
                    if not pair:
                        sets[u] = shingle_set(text or "", size)
                    elif jaccard(sets[u], sets[v]) >= similarity:
                        found.append((u, v))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return arrow_map(rows.repartition("a", "b").sortWithinPartitions("a", "b", "pair"), run, "u long, v long")


def shingle_set(text: str, size: int) -> np.ndarray:
    """Distinct hashes of a text's shingles; of all its words, if they are fewer."""
    raw = _LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = words(raw, np.array([0, len(raw)]))
    hashes = word_hashes(raw, starts, ends)
    return np.unique(gram_hashes(hashes, min(size, len(hashes)))) if len(hashes) else hashes


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / whole if (whole := len(a) + len(b) - both) else 1.0


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents whose id is that of their component in ``similar_groups`` (all
    columns kept).

    Rows of one id are one document and stay or go together.  A document without
    an id stays if no member of its component has one.
    """
    chosen = similar_groups(docs, id_col, text_col, **options).filter("doc_id <=> component_id").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(chosen, docs[id_col].cast("long").eqNullSafe(chosen["_kept_id"]), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
