"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table, through Spark's reader (any file system Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(col) -> Column:
    """Lower-case A-Z and nothing else (``lower`` would also change other letters)."""
    return F.translate(col, UPPER, LOWER)


def text_or_empty(col="text") -> Column:
    return F.coalesce(F.col(col).cast("string") if isinstance(col, str) else col, F.lit(""))


def run_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder name under ``spark.checkpoint.dir`` (shared by all executors)."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{tag}-{uuid.uuid4().hex}")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet under ``spark.checkpoint.dir`` and read back:
    lineage ends there and the rows survive lost executors."""
    return materialize(df, tag)


def local_path(uri: str) -> str | None:
    """The path of a ``file:`` uri or plain path; None for another store."""
    if "://" in uri and not uri.startswith("file:"):
        return None
    return "/" + uri.removeprefix("file:").lstrip("/")


def save_file(folder: str, name: str, data: bytes) -> None:
    """Write a file into a folder of the shared store, whole or not at all: a task that
    runs again replaces it by the same file."""
    path = local_path(folder)
    hidden = f"_{name}.{uuid.uuid4().hex}"
    if path is None:
        from pyarrow import fs
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{hidden}") as f:
            f.write(data)
        store.move(f"{path}/{hidden}", f"{path}/{name}")
        return
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{hidden}", "wb") as f:
        f.write(data)
    os.replace(f"{path}/{hidden}", f"{path}/{name}")


_HELD: dict = {"owner": None}


def held_by(owner: str) -> dict:
    """A dictionary for what an operator keeps in a worker process from task to task. The
    worker keeps one operator's at a time: the tables of the operator that ran before are
    dropped. What no table holds, such as the last task's batches, goes back to the system."""
    if _HELD["owner"] != owner:
        _HELD.clear()
        _HELD.update(owner=owner, tables={})
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
    return _HELD["tables"]


#: Rows that Spark hands to a Python worker at once in jobs on whole texts.
TEXT_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Bound the rows of an Arrow batch: a batch is held several times over (by the JVM as
    it grows, as it is sent, and by the worker), and texts are large. A smaller bound that
    the session has stays."""
    held = int(spark.conf.get(_BATCH_CONF))
    if held <= 0 or held > rows:
        spark.conf.set(_BATCH_CONF, str(rows))


def ascii_lower_bytes(data):
    """Lower-case A-Z in a numpy uint8 array (a copy). Bytes of multi-byte UTF-8
    characters are 0x80 or more and stay as they are."""
    import numpy as np
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
