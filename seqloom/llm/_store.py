"""Arrays in the shared folder: written once, memory-mapped by workers.

In a folder that workers see as files, arrays are mapped where they lie.  From any
other store each worker copies an array to its own disk, maps it and unlinks it at
once, so nothing stays behind.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import SparkSession


def _local(folder: str) -> str | None:
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    return folder if folder.startswith("/") else None


def write_array(folder: str, name: str, array: np.ndarray) -> None:
    """Write under another name, then rename: retries and rivals do no harm."""
    temporary = f".{name}-{uuid.uuid4().hex}"
    array = np.ascontiguousarray(array)
    if local := _local(folder):
        os.makedirs(local, exist_ok=True)
        array.tofile(f"{local}/{temporary}")
        os.replace(f"{local}/{temporary}", f"{local}/{name}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    with store.open_output_stream(f"{path}/{temporary}") as out:
        out.write(memoryview(array).cast("B"))
    store.move(f"{path}/{temporary}", f"{path}/{name}")


def names(spark: SparkSession, folder: str) -> set[str]:
    """The files of a folder, by one listing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return {f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)}


def map_array(folder: str, name: str, dtype) -> np.ndarray:
    if local := _local(folder):
        path = f"{local}/{name}"
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    with tempfile.NamedTemporaryFile() as copy, store.open_input_stream(f"{path}/{name}") as source:
        while block := source.read(1 << 22):
            copy.write(block)
        copy.flush()
        return np.memmap(copy.name, dtype, "r") if os.path.getsize(copy.name) else np.empty(0, dtype)
