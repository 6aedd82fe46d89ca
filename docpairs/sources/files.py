"""Many small files in few folders of the shared store, written by the tasks."""

from __future__ import annotations

import os
import uuid
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_package_on_workers, materialize

# Bytes and files that a task reads at most, about.
TASK_BYTES, TASK_FILES = 64 << 20, 20_000


def _store(folder: str):
    """``(file system, path)`` of a folder; a local path needs no service."""
    from pyarrow import fs
    if "://" in folder and not folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")


def write_files(df: DataFrame, folder: str, name_col: str, content_col: str, suffix: str = ".py",
                folders: int = 64) -> int:
    """Write one file per row, dealt over ``folders`` sub-folders by the hash of its name;
    gives the number of files. A file is written under a hidden name and renamed when it
    is whole, so a task that runs again leaves the same files."""
    def run(batches):
        store, root = _store(folder)
        made = set()
        for pdf in batches:
            for name, place, content in zip(pdf["name"], pdf["place"], pdf["content"]):
                path = f"{root}/{place:04d}"
                if path not in made:
                    store.create_dir(path, recursive=True)
                    made.add(path)
                hidden = f"{path}/_{uuid.uuid4().hex}"
                with store.open_output_stream(hidden) as f:
                    f.write(content if isinstance(content, bytes) else content.encode("utf-8"))
                store.move(hidden, f"{path}/{name}{suffix}")
            yield pd.DataFrame({"n": [len(pdf)]})

    rows = df.select(F.col(name_col).cast("string").alias("name"), F.pmod(F.xxhash64(name_col), F.lit(folders)).alias("place"),
                     F.col(content_col).alias("content")).where("content IS NOT NULL")
    return rows.mapInPandas(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def qualified(spark, folder: str) -> str:
    """The folder as Spark's readers name it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def listable(spark, folder: str) -> bool:
    """Whether tasks can list the folder themselves: it is one, in a store that they can open."""
    from pyarrow import fs
    try:
        store, root = _store(qualified(spark, folder))
        return store.get_file_info(root).type == fs.FileType.Directory
    except (OSError, ValueError, NotImplementedError):     # a store or a pattern that only Spark's readers know
        return False


def list_files(spark, folder: str, glob: str) -> DataFrame:
    """``path, size`` of the files below a folder whose names match. Tasks list the folders
    of a depth together, and the names stay in the shared store: the driver holds none.
    Hidden names are left out, as by Spark's readers."""
    ensure_package_on_workers(spark)
    top = qualified(spark, folder)

    def run(batches):
        import fnmatch

        from pyarrow import fs
        store, root = _store(top)
        for pdf in batches:
            for path in pdf["path"]:
                found = []
                for info in store.get_file_info(fs.FileSelector(root + path[len(top):], allow_not_found=True)):
                    name, inner = info.base_name, info.type == fs.FileType.Directory
                    hidden = name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")
                    if not hidden and (inner or fnmatch.fnmatchcase(name, glob)):
                        found.append((f"{path}/{name}", None if inner else info.size))
                yield pd.DataFrame(found, columns=["path", "size"]).astype({"size": "Int64"})
    folders, found = spark.createDataFrame([(top,)], "path string"), []
    while True:
        here = materialize(folders.mapInPandas(run, "path string, size bigint"), "listed")
        found.append(here.where("size > 0"))     # empty files have no row in binaryFile either
        folders = here.where("size IS NULL").select("path")
        n = folders.count()
        if not n:
            break
        folders = folders.repartition(min(n, 4 * spark.sparkContext.defaultParallelism))
    return reduce(DataFrame.unionByName, found)


def read_files(spark, folder: str, glob: str) -> DataFrame:
    """``path, content`` of the files below a folder; a file that cannot be read is left out."""
    top, listed = qualified(spark, folder), list_files(spark, folder, glob)
    n, size = listed.agg(F.count(F.lit(1)), F.sum("size")).first()
    tasks = max(4 * spark.sparkContext.defaultParallelism, (size or 0) // TASK_BYTES, n // TASK_FILES)

    def run(batches):
        store, root = _store(top)
        for batch in batches:
            paths, contents, held = [], [], 0
            for path in batch.column("path").to_pylist():
                try:
                    with store.open_input_file(root + path[len(top):]) as f:
                        contents.append(f.read())
                except OSError:
                    continue
                paths.append(path)
                held += len(contents[-1])
                if held >= TASK_BYTES // 8:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
                    paths, contents, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
    return listed.select("path").repartition(tasks).mapInArrow(run, "path string, content binary")


def fresh_folder(root: str, name: str) -> str:
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")
