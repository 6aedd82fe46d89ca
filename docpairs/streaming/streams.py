"""Structured Streaming jobs (I4-I6): the batch transforms applied to a stream.

Sinks are folders in the shared checkpoint directory, so a query restarted on
another driver or after executor loss resumes from its checkpoint, and the
final result is read back as a batch DataFrame.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import cleaning, scoring, vocab
from ..session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's (shared) checkpoint directory."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


def write_stream_files(df: DataFrame, path: str, rows_per_file: int = 250_000) -> str:
    """Lay a table down as JSON-lines files (stream input): as many as its partitions,
    cut at ``rows_per_file``, so they grow with the table."""
    df.write.option("maxRecordsPerFile", rows_per_file).json(path)
    return path


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    """File stream with an explicit schema (no inference), many files per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def run_to_parquet(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over everything available now into a Parquet folder."""
    q = (stream.writeStream.format("parquet").outputMode(mode).option("path", sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def stream_prepare(spark: SparkSession, src: str, schema: T.StructType,
                   code_col: str = "raw_code", doc_col: str = "raw_doc") -> DataFrame:
    """Clean and validate pairs as they arrive (stateless); equals the batch result."""
    out = scratch(spark, "stream-prepare")
    kept = cleaning.preprocess(read_stream(spark, src, schema), code_col, doc_col)
    run_to_parquet(kept.select("pair_id", "split", "code", "docstring"), out + "/data", out + "/_ckpt")
    return spark.read.parquet(out + "/data")


def _folder(spark: SparkSession, path: str):
    """The Hadoop file system and path of a folder of the shared store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _generations(spark: SparkSession, log: str) -> list[int]:
    fs, where = _folder(spark, log)
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(where)) if fs.exists(where) else []


def stream_token_counts(spark: SparkSession, src: str, schema: T.StructType, prepare, id_col: str = "pair_id",
                        out: str | None = None, files_per_trigger: int = 1000, compact_every: int = 50) -> DataFrame:
    """Running token counts over successive inputs, with first appearances: ``token,
    freq, first`` as ``vocab.token_freq`` gives them, so a vocabulary can be built from the
    stream. ``prepare`` turns the stream into rows of ``id_col`` and ``tokens``.

    The state of a token is its count and its earliest (id, position), kept by the
    streaming aggregate (no event time, so no watermark applies); it grows with the
    vocabulary, not the stream. Update mode: each micro-batch emits only the tokens that
    changed; the ``foreachBatch`` sink appends them with the batch id, and the current
    state of a token is its row from the latest batch. A micro-batch replayed after a
    failure appends the same rows again under the same batch id, so reading "latest batch
    wins" stays correct (idempotent sink). Every ``compact_every`` batches the log so far
    is folded into one row per token in the next generation's folder. The generation before
    it is kept for a replay, older ones are removed, so the log stays as large as the
    vocabulary. With ``out`` a later call goes on where the last one ended."""
    out = out or scratch(spark, "stream-token-counts")
    log = out + "/log"

    def generation(number: int) -> str:
        return f"{log}/{number:06d}"

    def latest(number: int) -> DataFrame:
        rows = spark.read.parquet(generation(number))
        # Column by column (rows of one batch are equal): a struct would be sorted for, not hashed.
        last = [F.max_by(c, "batch_id").alias(name) for c, name in (("freq", "freq"), ("first.id", "_id"), ("first.pos", "_pos"))]
        return rows.groupBy("token").agg(*last, F.max("batch_id").alias("batch_id")).select(
            "token", "freq", F.struct(F.col("_id").alias("id"), F.col("_pos").alias("pos")).alias("first"), "batch_id")

    stream = read_stream(spark, src, schema, files_per_trigger)
    rows = prepare(stream)
    if id_col not in rows.columns:  # counts alone are asked for
        rows = rows.withColumn(id_col, F.lit(None).cast("bigint"))
    counts = vocab.token_freq(rows, "tokens", id_col)

    def sink(batch: DataFrame, batch_id: int) -> None:
        number = batch_id // compact_every
        if number and batch_id % compact_every == 0:  # a new generation starts with the old one folded
            latest(number - 1).write.mode("overwrite").parquet(generation(number))
            for old in _generations(spark, log):
                if old < number - 1:
                    fs, where = _folder(spark, generation(old))
                    fs.delete(where, True)
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("append").parquet(generation(number))

    q = (counts.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", out + "/_ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    made = _generations(spark, log)
    if not made:
        return spark.createDataFrame([], "token string, freq bigint, first struct<id: bigint, pos: bigint>")
    return latest(made[-1]).select("token", "freq", "first")


def stream_token_freq(spark: SparkSession, src: str, schema: T.StructType, prepare, **options) -> DataFrame:
    """The running counts alone: ``token, freq``."""
    return stream_token_counts(spark, src, schema, prepare, **options).select("token", "freq")


def stream_score(spark: SparkSession, src: str, schema: T.StructType, factory=scoring.no_model,
                 id_col: str = "request_id", code_col: str = "code", type_col: str | None = "model_type") -> DataFrame:
    """I4: requests in, documentation + model name out, micro-batch by micro-batch."""
    out = scratch(spark, "stream-score")
    scored = scoring.score(read_stream(spark, src, schema), factory, id_col, code_col, type_col)
    run_to_parquet(scored, out + "/data", out + "/_ckpt")
    return spark.read.parquet(out + "/data")
