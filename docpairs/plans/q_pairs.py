"""Queries over pairs: sources (S1, S2, S6, S7), cleaning and validity (P1-P6), and
the flagship token report."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import text as T
from ..operators import cleaning, vocab
from ..sources import fixtures, io
from ..streaming.streams import scratch
from . import duck as D
from .common import CLEANED_CTE, oracle, pairs, valid
from .registry import register

RAW_RENAME = {"code": "raw_code", "docstring": "raw_doc"}


@register("clean_docstring", oracle(
    "SELECT pair_id, docstring FROM cleaned", CLEANED_CTE))
def q_clean_docstring(spark, sf_dir):
    return pairs(spark, sf_dir).select("pair_id", T.clean_docstring("raw_doc").alias("docstring"))


@register("clean_code", oracle(
    "SELECT pair_id, code FROM cleaned", CLEANED_CTE))
def q_clean_code(spark, sf_dir):
    return pairs(spark, sf_dir).select("pair_id", T.clean_code("raw_code").alias("code"))


@register("valid_pairs", oracle(
    "SELECT pair_id, split, code, docstring FROM valid", CLEANED_CTE))
def q_valid_pairs(spark, sf_dir):
    return valid(spark, sf_dir).select("pair_id", "split", "code", "docstring")


@register("reject_reasons", oracle(
    "SELECT split, coalesce(reason, 'kept') AS reason, CAST(count(*) AS BIGINT) AS n "
    "FROM cleaned GROUP BY 1, 2", CLEANED_CTE))
def q_reject_reasons(spark, sf_dir):
    return cleaning.reject_reason_counts(pairs(spark, sf_dir))


@register("preprocess_pipeline", oracle(
    "SELECT pair_id, code, docstring FROM valid", CLEANED_CTE))
def q_preprocess_pipeline(spark, sf_dir):
    return cleaning.preprocess(pairs(spark, sf_dir), "raw_code", "raw_doc").select("pair_id", "code", "docstring")


@register("kept_ratio", oracle(
    "SELECT split, CAST(count(*) FILTER (WHERE reason IS NULL) AS BIGINT) AS kept, "
    "CAST(count(*) AS BIGINT) AS total FROM cleaned GROUP BY split", CLEANED_CTE))
def q_kept_ratio(spark, sf_dir):
    return cleaning.kept_ratio(pairs(spark, sf_dir))


_RAW_COLS = ("pair_id, raw_code AS code, raw_doc AS docstring, 'python' AS language, "
             "repo, path, func_name")


@register("load_pairs", oracle(f"SELECT {_RAW_COLS} FROM pairs WHERE split = 'train'"))
def q_load_pairs(spark, sf_dir):
    return io.load_split(pairs(spark, sf_dir), "train", None, RAW_RENAME).drop("split")


@register("load_all_splits", oracle(f"SELECT split, {_RAW_COLS} FROM pairs"))
def q_load_all_splits(spark, sf_dir):
    return io.load_all_splits(pairs(spark, sf_dir), None, RAW_RENAME)


@register("repo_search", oracle(
    "SELECT name, url, stars FROM repos WHERE language = 'python' AND stars > 100 "
    "ORDER BY stars DESC, name LIMIT 10", views=("repos",)))
def q_repo_search(spark, sf_dir):
    return io.repo_search(fixtures.view(spark, sf_dir, "repos"), "python", 100, 10)


@register("prepare_dataset", oracle(
    "SELECT pair_id, split, code, docstring, func_name FROM valid", CLEANED_CTE))
def q_prepare_dataset(spark, sf_dir):
    return io.prepare_dataset(pairs(spark, sf_dir), None, RAW_RENAME)


# Flagship: documents -> pairs -> clean -> valid -> code tokens -> counts -> top 20.
TOP_TOKENS_K = 20


@register("top_code_tokens", oracle(
    "SELECT token, freq, CAST(rnk AS BIGINT) AS rnk FROM ("
    " SELECT token, CAST(count(*) AS BIGINT) AS freq,"
    "  row_number() OVER (ORDER BY count(*) DESC, min({'p': pair_id, 'q': pos})) AS rnk"
    " FROM (SELECT pair_id, unnest(tk) AS token, generate_subscripts(tk, 1) - 1 AS pos"
    f"       FROM (SELECT pair_id, {D.tokenize_code('code')} AS tk FROM valid)) t"
    f" GROUP BY token) r WHERE rnk <= {TOP_TOKENS_K}", CLEANED_CTE))
def q_top_code_tokens(spark, sf_dir):
    toks = valid(spark, sf_dir).select("pair_id", T.tokenize_code("code").alias("tokens"))
    freq = vocab.token_freq(toks)
    top = freq.orderBy(F.desc("freq"), F.asc("first")).limit(TOP_TOKENS_K)
    # The ranking window runs over the k rows kept by the top-k only.
    w = Window.orderBy(F.desc("freq"), F.asc("first"))
    return top.select("token", "freq", F.row_number().over(w).cast("bigint").alias("rnk"))


# Prepared pairs written as JSON lines partitioned by split into the shared
# checkpoint folder, then read back with an explicit schema.
@register("save_roundtrip", oracle(
    "SELECT pair_id, split, code, docstring, func_name FROM valid", CLEANED_CTE))
def q_save_roundtrip(spark, sf_dir):
    path = io.save_pairs(io.prepare_dataset(pairs(spark, sf_dir), None, RAW_RENAME), scratch(spark, "prepared"))
    schema = Ty.StructType(io.PROCESSED_SCHEMA.fields + [Ty.StructField("split", Ty.StringType())])
    return io.read_pairs(spark, path, "json", schema).select("pair_id", "split", "code", "docstring", "func_name")


# The same pairs as files of one JSON array each (S4's other form), each read by as many
# tasks as it has splits.
@register("read_json_arrays", oracle(
    "SELECT pair_id, split, code, docstring, func_name FROM valid", CLEANED_CTE))
def q_read_json_arrays(spark, sf_dir):
    prepared = io.prepare_dataset(pairs(spark, sf_dir), None, RAW_RENAME)
    path = io.save_json_arrays(prepared, scratch(spark, "arrays"))
    schema = Ty.StructType(io.PROCESSED_SCHEMA.fields + [Ty.StructField("split", Ty.StringType())])
    return io.read_pairs(spark, path, "json", schema, multiline=True).select("pair_id", "split", "code", "docstring", "func_name")


# S7's log line: kept and total of every split, gathered while the pairs are written.
@register("prepare_counts", oracle(
    "SELECT split, CAST(count(*) FILTER (WHERE reason IS NULL) AS BIGINT) AS kept, "
    "CAST(count(*) AS BIGINT) AS total FROM cleaned GROUP BY split", CLEANED_CTE))
def q_prepare_counts(spark, sf_dir):
    kept, seen = io.prepare_with_counts(pairs(spark, sf_dir), None, RAW_RENAME)
    io.save_pairs(kept, scratch(spark, "prepared"), "parquet")
    got = seen.get
    return spark.createDataFrame([(s, got[f"{s}_kept"], got[f"{s}_total"]) for s in io.SPLITS if got[f"{s}_total"]],
                                 "split string, kept bigint, total bigint")
