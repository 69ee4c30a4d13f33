"""What the operators share: staged tables, Arrow helpers, vectorised hashing.

Staging.  Lineage is cut by writing a table to the folder that the cluster
names in ``spark.checkpoint.dir`` (shared by driver and executors), never by a
local checkpoint.  Only a local session may do without the setting.  Staged tables are
deleted when the application ends, or earlier (``tidy``).
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..plans.shipping import shared_root, ship

U64 = np.uint64
MIN_LONG = -(2**63)
#: A word of the contracts: anything but space and \x09-\x0D.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD_SPLIT = r"[\x20\x09-\x0D]+"
#: Rows handed to Python at once; long texts then stay within bounded batches.
BATCH_ROWS = 500
#: The folders staged by the functions that tidy up, by thread.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    The shuffle files of the write are of no further use, so Spark may drop
    them as soon as the table is complete.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    for scope in _scopes.get():
        scope.append(path)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """What the function staged and its result does not read is deleted at its end."""

    @wraps(function)
    def run(*args, **options) -> DataFrame:
        scope: list[str] = []
        outer = _scopes.set((*_scopes.get(), scope))
        try:
            out = function(*args, **options)
        finally:
            _scopes.reset(outer)
        read = {name.split("/")[-2] for name in out.inputFiles()}
        for folder in scope:
            if folder.split("/")[-1] not in read:
                _delete(out.sparkSession, folder)
        return out

    return run


def python_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of the Arrow batches that Python receives."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_key(base: DataFrame) -> DataFrame:
    """Adds ``_did`` and ``_key`` to rows with _id and _text.

    ``_did`` is the id, null as the smallest long.  ``_key`` is 0, except for ids
    of several rows, where it is a hash of the text: copies of a row are then one
    place, while other texts under the same id stay apart.
    """
    base = base.withColumn("_did", F.coalesce(F.col("_id"), F.lit(MIN_LONG)))
    again = stage(base.groupBy("_did").count().filter("count > 1").select(F.col("_did").alias("_again")), "repeated-ids")
    key = F.when(F.col("_again").isNotNull(), F.xxhash64(F.coalesce("_text", F.lit("")))).otherwise(F.lit(0)).cast("long")
    return base.join(again, base._did == again._again, "left").withColumn("_key", key).drop("_again")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, _did, _key): coordinates of rows, and texts without nulls."""
    base = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].cast("string").alias("_text"))
    return _with_key(base).select(F.col("_id").alias("doc_id"), F.coalesce("_text", F.lit("")).alias("text"), "_did", "_key")


def keyed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_whole, _id, _text, _did, _key): rows without their text as a struct, so
    that no column of theirs can clash, with the same coordinates."""
    rest = F.struct(*[docs[c] for c in docs.columns if c != text_col])
    return _with_key(docs.select(rest.alias("_whole"), docs[id_col].cast("long").alias("_id"), docs[text_col].cast("string").alias("_text")))


def rewrite(rows: DataFrame, docs: DataFrame, text_col: str, spans: str, change: Callable[[str, pa.Array], str]) -> DataFrame:
    """The columns of ``docs`` from ``keyed_rows``; texts with ``spans`` are given
    to ``change`` with them (and n_chars, if there is one, follows)."""
    names = [c for c in docs.columns if c != text_col]
    flat = rows.select(*[F.col("_whole")[c].alias(f"c{i}") for i, c in enumerate(names)], F.col("_text").alias("text"), F.col(spans).alias("spans"))
    schema = StructType([*flat.schema.fields[:-1], StructField("changed", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                texts, found = part.column(len(names)), part.column(len(names) + 1)
                out = [t if t is None or not s.is_valid else change(t, s.values) for t, s in zip(texts.to_pylist(), found)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(out, texts.type), pc.is_valid(found)], names=[*part.schema.names[:-1], "changed"])

    changed = arrow_map(flat, run, schema)
    named = {c: F.col(f"c{i}") for i, c in enumerate(names)} | {text_col: F.col("text")}
    if "n_chars" in names:
        named["n_chars"] = F.when(F.col("changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(named["n_chars"])
    return changed.select(*[named[c].alias(c) for c in docs.columns])


# ---------------------------------------------------------------- Arrow


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (nulls empty) and n + 1 offsets."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str = "text", most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``most`` bytes of text, or of one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if len(lengths) > start:
        yield batch.slice(start)


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


_lean = False


def _give_back() -> None:
    """Freed memory goes back to the system: workers live on between stages, and
    what they keep adds to their executor's memory."""
    global _lean
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL(None)
        if not _lean:
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: fixed, instead of growing with what is freed
            _lean = True
        libc.malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def arrow_map(df: DataFrame, fn: Callable, schema: str | StructType) -> DataFrame:
    ship(df.sparkSession)
    python_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back()
        yield from fn(batches)
        _give_back()

    return df.mapInArrow(run, schema)


# ------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (shift, multiply, shift)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(1, U64), np.ones(1, U64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, self.base, U64)]), dtype=U64)
            self.down = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, _inverse(self.base), U64)]), dtype=U64)
        return self.up[:n], self.down[:n]


_BYTES = Powers(0x9E3779B97F4A7C15)
_FIRST = Powers(0xD6E8FEB86659FD93)
_SECOND = Powers(0xA0761D6478BD642F)
_TABLE = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def prefix_sums(values: np.ndarray, powers: Powers) -> np.ndarray:
    """Sums of values[i] * base**i: one more entry than there are values."""
    up, _ = powers.of(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of values[start:end] for each pair, equal for equal contents."""
    _, down = powers.of(len(sums))
    return (sums[ends] - sums[starts]) * down[starts]


def byte_sums(raw: np.ndarray, second: bool = False) -> tuple[np.ndarray, Powers]:
    powers = _SECOND if second else _BYTES
    return prefix_sums(_TABLE[raw], powers), powers


_LETTER = np.ones(256, bool)
_LETTER[list(SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and n + 1 word offsets by text."""
    letter = _LETTER[raw]
    cuts = offsets[1:-1]
    before = np.empty(len(raw), bool)
    before[:1] = False
    before[1:] = letter[:-1]
    before[cuts[cuts < len(raw)]] = False
    starts = np.flatnonzero(letter & ~before)
    after = np.empty(len(raw), bool)
    after[-1:] = False
    after[:-1] = letter[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(letter & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums, powers = byte_sums(raw)
    return mix(span_hash(sums, starts, ends, powers) + (ends - starts).astype(U64))


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive keys, by blocks of w (two running minima)."""
    n = len(keys)
    if w == 1 or n < w:
        return keys if w == 1 else keys[:0]
    padded = np.full(-(-n // w) * w, np.iinfo(U64).max, U64)
    padded[:n] = keys
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
