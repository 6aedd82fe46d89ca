"""Tokenisation queries (T1-T7, P8). Token lists travel as space-joined strings so
the comparison does not depend on array rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import fixtures
from . import duck as D
from .common import CLEANED_CTE, oracle, valid
from .registry import register


@register("tokenize_code", oracle(
    f"SELECT pair_id, {D.join_tokens(D.tokenize_code('code'))} AS tokens, "
    f"CAST(len({D.tokenize_code('code')}) AS BIGINT) AS n_tokens FROM valid", CLEANED_CTE))
def q_tokenize_code(spark, sf_dir):
    t = T.tokenize_code("code")
    return valid(spark, sf_dir).select("pair_id", T.join_tokens(t).alias("tokens"),
                                       F.size(t).cast("bigint").alias("n_tokens"))


@register("tokenize_code_raw", oracle(
    f"SELECT pair_id, {D.join_tokens(D.tokenize_code('code', False))} AS tokens FROM valid", CLEANED_CTE))
def q_tokenize_code_raw(spark, sf_dir):
    return valid(spark, sf_dir).select(
        "pair_id", T.join_tokens(T.tokenize_code("code", split_identifiers=False)).alias("tokens"))


@register("split_identifier", oracle(
    f"SELECT token, {D.join_tokens(D.split_identifier('token'))} AS parts FROM "
    f"(SELECT DISTINCT unnest({D.raw_code_tokens('code')}) AS token FROM valid) t", CLEANED_CTE))
def q_split_identifier(spark, sf_dir):
    toks = (valid(spark, sf_dir).select(F.explode(T.raw_code_tokens("code")).alias("token"))
            .distinct())
    return toks.select("token", T.join_tokens(T.split_identifier("token")).alias("parts"))


@register("tokenize_text", oracle(
    f"SELECT pair_id, {D.join_tokens(D.tokenize_text('docstring'))} AS tokens FROM valid", CLEANED_CTE))
def q_tokenize_text(spark, sf_dir):
    return valid(spark, sf_dir).select("pair_id", T.join_tokens(T.tokenize_text("docstring")).alias("tokens"))


@register("whitespace_tokens", oracle(
    f"SELECT pair_id, model, {D.join_tokens(D.whitespace_tokens('prediction'))} AS tokens, "
    f"CAST(len({D.whitespace_tokens('prediction')}) AS BIGINT) AS n_tokens FROM eval_pairs",
    views=("eval_pairs",)))
def q_whitespace_tokens(spark, sf_dir):
    t = T.whitespace_tokens("prediction")
    return fixtures.view(spark, sf_dir, "eval_pairs").select(
        "pair_id", "model", T.join_tokens(t).alias("tokens"), F.size(t).cast("bigint").alias("n_tokens"))


@register("rouge_tokens", oracle(
    f"SELECT pair_id, model, {D.join_tokens(D.rouge_tokens('reference'))} AS ref_tokens, "
    f"{D.join_tokens(D.rouge_tokens('prediction'))} AS pred_tokens FROM eval_pairs",
    views=("eval_pairs",)))
def q_rouge_tokens(spark, sf_dir):
    return fixtures.view(spark, sf_dir, "eval_pairs").select(
        "pair_id", "model", T.join_tokens(T.rouge_tokens("reference")).alias("ref_tokens"),
        T.join_tokens(T.rouge_tokens("prediction")).alias("pred_tokens"))


# P8 + T7: a decoded sequence framed by special tokens, cleaned for display.
_FRAMED_D = (f"list_concat(['<SOS>'], {D.tokenize_text('docstring')}, ['<EOS>', '<PAD>', '<UNK>'], "
             f"{D.tokenize_text('docstring')})")


@register("strip_specials", oracle(
    f"SELECT pair_id, {D.join_tokens(D.strip_specials(_FRAMED_D))} AS text FROM valid", CLEANED_CTE))
def q_strip_specials(spark, sf_dir):
    t = T.tokenize_text("docstring")
    framed = F.concat(F.array(F.lit(T.SOS)), t, F.array(F.lit(T.EOS), F.lit(T.PAD), F.lit(T.UNK)), t)
    return valid(spark, sf_dir).select("pair_id", T.join_tokens(T.strip_specials(framed)).alias("text"))
