"""FASTA and FASTQ files as DataFrames, a task for each file, streamed by line.

Neither format can be entered in the middle (quality lines may look like headers),
so a file is one task; give many files, and repartition behind the scan.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans.shipping import ship

FORMATS = ("fasta", "zfasta", "fastq", "zfastq")
SCHEMA = "read_ord bigint, read_id string, seq string"


class FormatError(ValueError):
    """What is wrong, in which file and line."""


def _open(path: str, fmt: str) -> io.TextIOBase:
    local = re.sub("^file:(//)?", "", path)
    if local.startswith("/") or "://" not in path:
        raw = open(local, "rb")  # noqa: SIM115
    else:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        raw = store.open_input_stream(name, compression=None)
    zipped = fmt.startswith("z") or (path.endswith(".gz") and len(path) > 3)
    return io.TextIOWrapper(gzip.open(raw) if zipped else raw, encoding="latin-1", newline="\n")


def _lines(path: str, fmt: str) -> Iterator[tuple[int, str]]:
    with _open(path, fmt) as file:
        for number, line in enumerate(file, 1):
            yield number, line.rstrip("\n").rstrip("\r")


def _name(header: str) -> str:
    return re.split("[ \t]", header[1:], maxsplit=1)[0]


def parse_fasta(path: str, fmt: str = "fasta", reference: bool = False) -> Iterator[tuple[str, str]]:
    """(id, sequence).  Blank lines and lines that begin with # do not count.

    As references, records without a sequence are dropped and ids must not be empty.
    """
    name, parts, begun = "", [], False
    for number, line in _lines(path, fmt):
        if not line.strip() or line.startswith("#"):
            continue
        if line.startswith(">"):
            if begun and (parts or not reference):
                yield name, "".join(parts)
            name, parts, begun = _name(line), [], True
            if reference and not name:
                raise FormatError(f"{path}:{number}: a reference without an id")
        elif not begun:
            raise FormatError(f"{path}:{number}: a header line must come first")
        else:
            parts.append(line)
    if begun and (parts or not reference):
        yield name, "".join(parts)


def parse_fastq(path: str, fmt: str = "fastq") -> Iterator[tuple[str, str]]:
    """(id, sequence); qualities are only counted, to know where they end."""
    state, name, parts, bases, quality, number = "header", "", [], 0, 0, 0
    for number, line in _lines(path, fmt):
        if state == "quality" and quality >= bases:
            if quality > bases:
                raise FormatError(f"{path}:{number - 1}: more qualities than bases")
            yield name, "".join(parts)
            state = "header"
        if state == "header":
            if not line.strip():
                continue
            if not line.startswith("@"):
                raise FormatError(f"{path}:{number}: a record must begin with @")
            state, name, parts, bases, quality = "sequence", _name(line), [], 0, 0
        elif state == "sequence":
            if line.startswith("+"):
                state = "quality"
            else:
                parts.append(line)
                bases += len(line)
        else:
            quality += len(line)
    if state == "sequence":
        raise FormatError(f"{path}:{number}: a record without +")
    if state == "quality":
        if quality != bases:
            raise FormatError(f"{path}:{number}: {quality} qualities for {bases} bases")
        yield name, "".join(parts)


def read_fastx(spark: SparkSession, paths: str | Sequence[str], fmt: str = "fasta", reference: bool = False) -> DataFrame:
    """(read_ord, read_id, seq); ordinals count records, and files above 2**40."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no input")
    ship(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                records = parse_fastq(path, fmt) if fmt.endswith("fastq") else parse_fasta(path, fmt, reference)
                rows, size = [], 0
                for i, (name, seq) in enumerate(records):
                    rows.append(((number << 40) + i, name, seq))
                    size += len(seq)
                    if size > 1 << 22 or len(rows) >= 10_000:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    listed = spark.createDataFrame(list(enumerate(paths)), "number bigint, path string").repartition(len(paths), "number")
    return listed.mapInArrow(parse, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))], names=["read_ord", "read_id", "seq"])
