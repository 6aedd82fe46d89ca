"""Table operators for pair cleaning and validity (P1-P6). ``DataFrame -> DataFrame``.

All of them are narrow projections/filters: no shuffle, whole-stage codegen,
and they can be applied to a streaming DataFrame unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def clean_pairs(df: DataFrame, code_col: str = "code", doc_col: str = "docstring",
                out_code: str = "code", out_doc: str = "docstring") -> DataFrame:
    """Clean both sides of each pair."""
    return df.withColumns({out_code: T.clean_code(code_col), out_doc: T.clean_docstring(doc_col)})


def with_reject_reason(df: DataFrame, code_col: str = "code", doc_col: str = "docstring") -> DataFrame:
    """Add ``reason``: the first failing rule on the cleaned sides, null if valid."""
    return df.withColumn("reason", T.reject_reason(code_col, doc_col))


def keep_valid(df: DataFrame, code_col: str = "code", doc_col: str = "docstring") -> DataFrame:
    """Keep pairs that pass every rule.

    The rows are emitted by ``inline`` of a one-element array that is null for a
    rejected pair, instead of a ``Filter`` on ``reason``: Catalyst pushes a filter
    below the cleaning projection (and below any repartition) by inlining the
    cleaning expressions into the predicate, which would run the regex chains
    twice and before the rows are spread over tasks."""
    r = with_reject_reason(df, code_col, doc_col)
    cols = [c for c in r.columns if c != "reason"]
    return r.select(F.inline(F.when(F.col("reason").isNull(), F.array(F.struct(*cols)))))


def preprocess(df: DataFrame, code_col: str = "raw_code", doc_col: str = "raw_doc") -> DataFrame:
    """P5: clean both sides and keep the valid pairs, as columns ``code`` and ``docstring``.
    The raw inputs are dropped (``keep_valid`` carries every remaining column)."""
    cleaned = clean_pairs(df, code_col, doc_col)
    raw = [c for c in (code_col, doc_col) if c not in ("code", "docstring")]
    return keep_valid(cleaned.drop(*raw))


def reject_reason_counts(df: DataFrame, by=("split",), code_col: str = "raw_code",
                         doc_col: str = "raw_doc") -> DataFrame:
    """P4 report: rows per (group, reason); valid pairs are reported as ``kept``.

    Partial aggregation runs map-side, so only (group, reason) partials shuffle."""
    cleaned = with_reject_reason(clean_pairs(df, code_col, doc_col))
    return (cleaned.groupBy(*by, F.coalesce("reason", F.lit("kept")).alias("reason"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n")))


def kept_ratio(df: DataFrame, by=("split",), code_col: str = "raw_code",
               doc_col: str = "raw_doc") -> DataFrame:
    """Kept and total pairs per group."""
    cleaned = with_reject_reason(clean_pairs(df, code_col, doc_col))
    return (cleaned.groupBy(*by)
            .agg(F.count_if(F.col("reason").isNull()).cast("bigint").alias("kept"),
                 F.count(F.lit(1)).cast("bigint").alias("total")))
