"""Streaming queries (I4-I6). The input stream is the ``pairs`` table laid down by
Spark as JSON-lines files, as many as it has partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cleaning, vocab
from ..operators import scoring as S
from ..operators.scoring import UNKNOWN_TYPE_MSG
from ..streaming import streams as ST
from .common import CLEANED_CTE, VALID_TOKENS_CTE, oracle, pairs
from .q_scoring import _LEAD, _TYPE, lead_words_factory
from .q_vocab import SPECIALS_SQL, d_freq, d_vocab
from .registry import register


def _stream_src(spark, sf_dir):
    df = pairs(spark, sf_dir)
    path = ST.write_stream_files(df, ST.scratch(spark, "pairs-stream") + "/in")
    return path, df.schema


@register("stream_prepare", oracle(
    "SELECT pair_id, split, code, docstring FROM valid", CLEANED_CTE))
def q_stream_prepare(spark, sf_dir):
    path, schema = _stream_src(spark, sf_dir)
    return ST.stream_prepare(spark, path, schema)


def _code_tokens(df):
    """Tokens of the valid pairs: clean and validate inside the stream, then tokenise."""
    # Only these fields are parsed: ``preprocess`` carries every column it is given.
    needed = df.select("pair_id", "raw_code", "raw_doc")
    return cleaning.preprocess(needed, "raw_code", "raw_doc").select("pair_id", T.tokenize_code("code").alias("tokens"))


@register("stream_token_freq", oracle(
    "SELECT token, CAST(count(*) AS BIGINT) AS freq FROM (SELECT unnest(src) AS token FROM vtok) t GROUP BY token",
    CLEANED_CTE, VALID_TOKENS_CTE))
def q_stream_token_freq(spark, sf_dir):
    path, schema = _stream_src(spark, sf_dir)
    return ST.stream_token_freq(spark, path, schema, _code_tokens)


# V2 on a stream: the running counts keep each token's first appearance, so the vocabulary
# they give is the one that the table gives.
@register("stream_vocab", oracle(
    f"SELECT * FROM code_vocab UNION ALL {SPECIALS_SQL}", CLEANED_CTE, VALID_TOKENS_CTE,
    d_freq("code_freq", "vtok", "src"), d_vocab("code_vocab", "code_freq", 50000)))
def q_stream_vocab(spark, sf_dir):
    path, schema = _stream_src(spark, sf_dir)
    return vocab.build_vocab(ST.stream_token_counts(spark, path, schema, _code_tokens, files_per_trigger=2))


@register("stream_score", oracle(
    f"SELECT pair_id AS request_id, {_TYPE} AS model_used, "
    f"CASE WHEN {_TYPE} IN ('codebert', 'seq2seq') THEN {_LEAD} END AS documentation, "
    f"CASE WHEN {_TYPE} IN ('codebert', 'seq2seq') THEN NULL ELSE '{UNKNOWN_TYPE_MSG}' END AS error FROM valid",
    CLEANED_CTE))
def q_stream_score(spark, sf_dir):
    path, schema = _stream_src(spark, sf_dir)
    src = ST.read_stream(spark, path, schema)
    req = (cleaning.preprocess(src, "raw_code", "raw_doc")
           .select(F.col("pair_id").alias("request_id"), "code", F.expr(_TYPE).alias("model_type")))
    out = ST.scratch(spark, "stream-score")
    ST.run_to_parquet(S.score(req, lead_words_factory), out + "/data", out + "/_ckpt")
    return spark.read.parquet(out + "/data")
