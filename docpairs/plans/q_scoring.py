"""Scoring queries (I1-I3): batch scoring with a user predictor and greedy decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as S
from ..sources import fixtures
from . import duck as D
from .common import oracle, valid
from .q_vocab import VOCABS_CTES, _doc_vocab
from .registry import register

_TYPE = "CASE split WHEN 'train' THEN 'codebert' WHEN 'validation' THEN 'seq2seq' ELSE 'gpt' END"


def requests(spark, sf_dir):
    """Requests built from the valid pairs: code plus a model type per split."""
    return valid(spark, sf_dir).select(F.col("pair_id").alias("request_id"), "code",
                                       F.expr(_TYPE).alias("model_type"))


@register("score_errors", oracle(
    f"SELECT pair_id AS request_id, {_TYPE} AS model_used, "
    f"CASE WHEN {_TYPE} IN ('codebert', 'seq2seq') THEN '{S.NO_MODEL_MSG}' ELSE '{S.UNKNOWN_TYPE_MSG}' END AS error "
    "FROM valid", *VOCABS_CTES[:1]))
def q_score_errors(spark, sf_dir):
    return S.score(requests(spark, sf_dir), S.no_model).select("request_id", "model_used", "error")


def lead_words_factory(model_type: str):
    """Demo predictor for tests: the first eight whitespace words of the code."""
    return lambda codes: codes.str.split().str[:8].str.join(" ")


_LEAD = f"array_to_string(({D.whitespace_tokens('code')})[1:8], ' ')"


@register("score_batch", oracle(
    f"SELECT pair_id AS request_id, 'seq2seq' AS model_used, {_LEAD} AS documentation, "
    "CAST(NULL AS VARCHAR) AS error FROM valid", *VOCABS_CTES[:1]))
def q_score_batch(spark, sf_dir):
    return S.score(requests(spark, sf_dir).withColumn("model_type", F.lit("seq2seq")), lead_words_factory)


_GD = ("steps AS (SELECT seq_id, pos, CAST(list_position(logits, list_max(logits)) - 1 AS BIGINT) AS tok FROM logits)",
       "seqs AS (SELECT seq_id, list(tok ORDER BY pos) AS ids FROM steps GROUP BY seq_id)",
       "cut AS (SELECT seq_id, ids[1:coalesce(nullif(list_position(ids, 2), 0), len(ids))][1:128] AS ids FROM seqs)",
       "dec AS (SELECT c.seq_id, list(coalesce(d.token, '<UNK>') ORDER BY c.pos) AS toks FROM "
       "(SELECT seq_id, unnest(ids) AS idx, generate_subscripts(ids, 1) AS pos FROM cut) c "
       "LEFT JOIN dvall d ON c.idx = d.idx GROUP BY c.seq_id)")


@register("greedy_decode", oracle(
    "SELECT cut.seq_id, array_to_string(cut.ids, ' ') AS ids, "
    "array_to_string(list_filter(toks, lambda w: NOT list_contains(['<PAD>', '<SOS>', '<EOS>', '<UNK>'], w)), ' ') AS text "
    "FROM cut JOIN dec ON cut.seq_id = dec.seq_id", *VOCABS_CTES, *_GD, views=("pairs", "logits")))
def q_greedy_decode(spark, sf_dir):
    voc = _doc_vocab(spark, sf_dir)
    g = S.greedy_decode(fixtures.view(spark, sf_dir, "logits"), voc, known_bound=20000)
    return g.select("seq_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"), "text")
