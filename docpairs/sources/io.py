"""Sources and sinks for pairs."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cleaning import preprocess
from ..operators.index import dense_index
from ..session import materialize
from .arrays import read_json_array, save_json_array

SPLITS = ("train", "validation", "test")
RAW_FIELDS = ("code", "docstring", "language", "repo", "path", "func_name")

RAW_PAIR_SCHEMA = T.StructType(
    [T.StructField("pair_id", T.LongType()), T.StructField("split", T.StringType())]
    + [T.StructField(f, T.StringType()) for f in RAW_FIELDS])

PROCESSED_SCHEMA = T.StructType([
    T.StructField("pair_id", T.LongType()),
    T.StructField("code", T.StringType()),
    T.StructField("docstring", T.StringType()),
    T.StructField("func_name", T.StringType()),
])


def to_raw_pairs(df: DataFrame, rename: dict | None = None, language: str = "python") -> DataFrame:
    """S1 projection: the six raw fields. ``rename`` maps target field -> source column;
    a field whose source column does not exist becomes ``""`` (a present null stays
    null). ``language`` is a constant, as in the corpus loader."""
    rename = dict(rename or {})
    cols = set(df.columns)
    out = [F.col("pair_id").cast("bigint").alias("pair_id"), F.col("split")]
    for f in RAW_FIELDS:
        if f == "language":
            out.append(F.lit(language).alias(f))
            continue
        src = rename.get(f, f)
        out.append((F.col(src) if src in cols else F.lit("")).cast("string").alias(f))
    return df.select(*out)


def load_splits(df: DataFrame, splits=SPLITS, limits: dict | None = None, rename: dict | None = None) -> DataFrame:
    """The raw pairs of ``splits`` in one scan. ``limits`` maps split -> how many rows, in
    dataset (pair_id) order, are loaded; 0/None means all. Limited splits are ranked by
    the distributed index, so a split with most rows never lands in one task."""
    limits = {k: int(v) for k, v in (limits or {}).items() if v}
    out = to_raw_pairs(df.where(F.col("split").isin(*splits)), rename)
    if not limits:
        return out
    ranked = dense_index(out, ["pair_id"], "load_rank", group_cols=["split"])
    last = F.coalesce(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("split")], F.lit(None).cast("int"))
    return ranked.where(last.isNull() | (F.col("load_rank") < last)).select(out.columns)


def load_split(df: DataFrame, split: str = "train", max_samples: int | None = None,
               rename: dict | None = None) -> DataFrame:
    """One split, first ``max_samples`` rows in dataset (pair_id) order (0/None: all)."""
    return load_splits(df, (split,), {split: max_samples}, rename)


def load_all_splits(df: DataFrame, max_samples_per_split: int | None = None,
                    rename: dict | None = None) -> DataFrame:
    """All three splits of one table. (Per-split sources that may fail are read
    with :func:`load_split_sources`.)"""
    return load_splits(df, SPLITS, {s: max_samples_per_split for s in SPLITS}, rename)


def read_isolated(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet"):
    """``(rows, files)`` of a folder whose files may be broken. A file that cannot be opened
    or breaks off while its rows are read ends there; the other files are read on. ``files``
    has ``file, rows, whole`` for every file listed: a Parquet file is whole if it gave as
    many rows as its footer counts, any other if it gave rows. The schema is given, so no
    file has to be opened to plan the read, and a broken one cannot fail it."""
    reader = spark.read.schema(schema).format(fmt).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).option("recursiveFileLookup", True)
    source = reader.load(path)
    rows = materialize(source.select("*", F.col("_metadata.file_path").alias("_file")), "isolated")
    # The names that the reader has listed anyway; the footers are read by the tasks.
    names = source.inputFiles()
    listed = spark.createDataFrame([(n,) for n in names], "file string").repartition(max(1, min(len(names), spark.sparkContext.defaultParallelism)))
    if fmt == "parquet":
        listed = listed.mapInPandas(_footer_counts, "file string, expected bigint")
    else:
        listed = listed.select("file", F.lit(None).cast("bigint").alias("expected"))
    seen = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("rows"))
    key = lambda c: F.regexp_replace(F.col(c), "^file:/+", "/")  # noqa: E731 - two spellings of one local path
    files = (listed.withColumn("_k", key("file")).join(seen.withColumn("_k", key("_file")), "_k", "left")
             .select("file", F.coalesce("rows", F.lit(0)).alias("rows"), "expected"))
    whole = F.when(F.col("expected").isNotNull(), F.col("rows") == F.col("expected")).otherwise((F.col("rows") > 0) & F.lit(fmt != "parquet"))
    return rows.drop("_file"), files.select("file", "rows", whole.alias("whole"))


def _footer_counts(batches):
    """Rows by the footer of each Parquet file; null where it has no readable footer."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from .files import _store
    for pdf in batches:
        counts = []
        for name in pdf["file"]:
            try:
                store, where = _store(name)
                with store.open_input_file(where) as f:
                    counts.append(pq.ParquetFile(f).metadata.num_rows)
            except (OSError, pa.ArrowInvalid):
                counts.append(None)
        yield pdf[["file"]].assign(expected=pd.array(counts, "Int64"))


def load_split_sources(spark: SparkSession, sources: dict, fmt: str = "parquet",
                       max_samples_per_split: int | None = None, rename: dict | None = None,
                       order_col: str = "pair_id", schema: T.StructType | None = None):
    """S2 over per-split mirrors: ``sources`` maps split -> folder. A split whose source is
    missing becomes empty and the others go on. With a ``schema`` that holds for the files
    too: a file that is broken, even in its middle, is left where it breaks, the split's
    other files are read, and the result is ``(pairs, files)`` with a row for every file
    (``split, file, rows, whole``)."""
    parts, told = [], []
    for split, path in sources.items():
        try:
            if schema is None:
                df = spark.read.format(fmt).load(path)
            else:
                df, files = read_isolated(spark, path, schema, fmt)
                told.append(files.select(F.lit(split).alias("split"), "file", "rows", "whole"))
        except AnalysisException:  # no such folder: the split is empty
            parts.append(spark.createDataFrame([], RAW_PAIR_SCHEMA))
            continue
        df = df.withColumn("split", F.lit(split))
        if order_col not in df.columns:
            df = df.withColumn(order_col, F.monotonically_increasing_id())
        parts.append(load_split(df, split, max_samples_per_split, rename))
    pairs = reduce(DataFrame.unionByName, parts)
    if schema is None:
        return pairs
    report = reduce(DataFrame.unionByName, told) if told else spark.createDataFrame([], "split string, file string, rows bigint, whole boolean")
    return pairs, report


def prepare_dataset(df: DataFrame, limits: dict | None = None, rename: dict | None = None,
                    code_col: str = "code", doc_col: str = "docstring") -> DataFrame:
    """Per split load -> clean -> keep valid -> (code, docstring, func_name).

    ``limits`` maps split -> max rows loaded before cleaning (as in the reference,
    the cap applies to loaded rows, not kept rows). Returns one DataFrame with a
    ``split`` column; write it with :func:`save_pairs`."""
    kept = preprocess(load_splits(df, SPLITS, limits, rename), code_col, doc_col)
    return kept.select("pair_id", "split", "code", "docstring", "func_name")


def prepare_with_counts(df: DataFrame, limits: dict | None = None, rename: dict | None = None):
    """S7 with the kept/total log line of every split gathered in the same pass via
    ``observe``. Returns (kept pairs, Observation); the observation (``train_total``,
    ``train_kept``, ...) is filled when the kept pairs are written or otherwise executed."""
    from pyspark.sql import Observation

    from ..operators.cleaning import clean_pairs, with_reject_reason
    obs = Observation("prepare")
    seen = []
    for s in SPLITS:
        here = F.col("split") == s
        seen += [F.count_if(here).alias(f"{s}_total"), F.count_if(here & F.col("reason").isNull()).alias(f"{s}_kept")]
    judged = with_reject_reason(clean_pairs(load_splits(df, SPLITS, limits, rename))).observe(obs, *seen)
    cols = ["pair_id", "split", "code", "docstring", "func_name"]
    kept = judged.select(F.inline(F.when(F.col("reason").isNull(), F.array(F.struct(*cols)))))
    return kept, obs


def save_json_arrays(df: DataFrame, path: str, files: int | None = None) -> str:
    """Pairs as files that each hold one JSON array (the form in which the pairs are
    exchanged), one per partition; ``files`` deals the rows anew. A file is a stream of
    rows, so its size is not bounded by memory. Read them with ``arrays.read_json_array``."""
    return save_json_array(df.repartition(files) if files else df, path)


def save_pairs(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> str:
    """S3: write pairs partitioned by split (JSON lines or Parquet). Returns ``path``.

    The rows are JSON lines or Parquet; ``save_json_arrays`` writes arrays."""
    df.write.mode(mode).partitionBy("split").format(fmt).save(path)
    return path


def read_pairs(spark: SparkSession, path: str, fmt: str = "json",
               schema: T.StructType | None = None, multiline: bool = False) -> DataFrame:
    """Read pairs back with an explicit schema (no inference pass).

    ``multiline=True`` reads files that each hold one JSON array, whatever their size, by
    as many tasks as they have splits."""
    schema = schema or PROCESSED_SCHEMA
    if fmt == "json" and multiline:
        return read_json_array(spark, path, schema).drop("file", "place", "place_in_file")
    return spark.read.schema(schema).format(fmt).load(path)


def repo_search(repos: DataFrame, language: str = "python", min_stars: int = 100,
                max_repos: int = 10) -> DataFrame:
    """Top repositories by stars (one page: at most 100). Ties broken by name."""
    n = min(int(max_repos), 100)
    return (repos.where((F.col("language") == language) & (F.col("stars") > min_stars))
            .orderBy(F.desc("stars"), F.asc("name")).limit(n)
            .select("name", "url", "stars"))
