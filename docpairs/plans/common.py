"""Shared building blocks for the registered queries (Spark side and oracle side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cleaning
from ..sources import fixtures
from . import duck as D


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.view(spark, sf_dir, "pairs")


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs with cleaned ``code``/``docstring`` and the rejection ``reason``."""
    df = cleaning.clean_pairs(pairs(spark, sf_dir), "raw_code", "raw_doc")
    return cleaning.with_reject_reason(df)


def valid(spark: SparkSession, sf_dir: str, *splits: str) -> DataFrame:
    """Valid cleaned pairs: pair_id, split, func_name, code, docstring. With ``splits``
    the raw pairs are filtered first (``keep_valid`` emits rows through a generator, and
    a filter on its output would not reach below the cleaning)."""
    src = pairs(spark, sf_dir).select("pair_id", "split", "func_name", "raw_code", "raw_doc")
    if splits:
        src = src.where(F.col("split").isin(*splits))
    return cleaning.preprocess(src, "raw_code", "raw_doc").select("pair_id", "split", "func_name", "code", "docstring")


def valid_tokens(spark: SparkSession, sf_dir: str, *splits: str, code_tokens=T.tokenize_code,
                 doc_tokens=T.tokenize_text) -> DataFrame:
    """Valid pairs with code tokens (``src``) and docstring tokens (``tgt``). The tokenizers
    are functions from a column (name) to a token array column."""
    return valid(spark, sf_dir, *splits).select("pair_id", "split", code_tokens("code").alias("src"),
                                                doc_tokens("docstring").alias("tgt"))


# ----------------------------------------------------------------- oracle side
CLEANED_CTE = (
    "cleaned0 AS (SELECT pair_id, split, language, repo, path, func_name, raw_code, raw_doc, "
    f"{D.clean_code('raw_code')} AS code, {D.clean_docstring('raw_doc')} AS docstring FROM pairs), "
    f"cleaned AS (SELECT *, {D.reject_reason('code', 'docstring')} AS reason FROM cleaned0), "
    "valid AS (SELECT pair_id, split, func_name, code, docstring FROM cleaned WHERE reason IS NULL)")

VALID_TOKENS_CTE = (
    f"vtok AS (SELECT pair_id, split, {D.tokenize_code('code')} AS src, "
    f"{D.tokenize_text('docstring')} AS tgt FROM valid)")


def oracle(sql: str, *ctes: str, views=("pairs",)) -> str:
    """Oracle text: fixture views, then extra CTEs, then the final SELECT."""
    parts = [f"{n} AS ({fixtures.VIEWS[n]})" for n in views] + list(ctes)
    if not parts:
        return sql
    return "WITH " + ",\n".join(parts) + "\n" + sql
