"""The corpus pipeline: five of the training-data operators, one after the other.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes every
stage's rows as Parquet under ``spark.checkpoint.dir`` and gives them to the next one.
The first four return the columns of ``documents``; the last returns the packed pieces.

Cases, by stage: null and empty texts are judged by the classifier like others; those it
keeps equal each other, so one of them stays (that of the largest ``doc_id``; a null id is
smallest), is near to nothing, holds no secret and packs as its end token. Rows repeated as
a whole leave one row. Extra columns, whatever their names, go through the first four
stages unchanged. An empty table gives no rows; without any label the first
stage keeps every document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docpairs.llm import exact_dedup, minhash, packing, quality, secrets
from docpairs.llm.common import read, small_batches, written
from docpairs.session import ensure_checkpoint_dir, ensure_package_on_workers


#: Word forms that a packing worker remembers here: the stages before have filled the
#: executors' heaps, so its memory counts more than looking up a form again.
CACHED_FORMS = 300_000


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    _prepare(spark)
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    _prepare(spark)
    return exact_dedup.dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8 or more)."""
    _prepare(spark)
    return minhash.drop_near_copies(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts replaced."""
    _prepare(spark)
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences."""
    _prepare(spark)
    return packing.pack_digests(docs, cached_forms=CACHED_FORMS)


def _prepare(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ensure_package_on_workers(spark)
    small_batches(spark)


STAGES = [("quality", good_quality), ("exact_dedup", without_copies), ("near_dedup", without_near_copies),
          ("secrets", without_secrets), ("packing", packed)]

#: The classifier and the tokenizer have no SQL form; the tests hold the rows against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
