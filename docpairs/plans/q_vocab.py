"""Vocabulary queries (V1-V7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import vocab as V
from ..session import materialize
from . import duck as D
from .common import CLEANED_CTE, VALID_TOKENS_CTE, oracle, valid_tokens
from .registry import register

SPECIALS_SQL = ("SELECT '<PAD>' AS token, CAST(0 AS BIGINT) AS idx, CAST(0 AS BIGINT) AS freq "
                "UNION ALL SELECT '<SOS>', 1, 0 UNION ALL SELECT '<EOS>', 2, 0 UNION ALL SELECT '<UNK>', 3, 0")
SPECIAL_LIST = "('<PAD>', '<SOS>', '<EOS>', '<UNK>')"


def d_freq(name: str, source: str, col: str, batch: int | None = None) -> str:
    """DuckDB count table CTE: token, freq, first = {b?, p, q}."""
    b = f"'b': {batch}, " if batch is not None else ""
    return (f"{name} AS (SELECT token, CAST(count(*) AS BIGINT) AS freq, min({{{b}'p': pair_id, 'q': pos}}) AS first "
            f"FROM (SELECT pair_id, unnest({col}) AS token, generate_subscripts({col}, 1) - 1 AS pos FROM {source}) x "
            f"GROUP BY token)")


def d_vocab(name: str, freq: str, max_size: int | None, min_freq: int = 2, start: int = 4,
            limit: int | None = None, exclude: str | None = None) -> str:
    """DuckDB vocabulary CTE (without the specials): token, idx, freq."""
    lim = limit if limit is not None else (max_size - 4 if max_size else None)
    cut = f"SELECT * FROM {freq} WHERE freq >= {min_freq}"
    if lim is not None:
        cut += f" ORDER BY freq DESC, first LIMIT {lim}"
    ex = f" AND token NOT IN (SELECT token FROM {exclude})" if exclude else ""
    return (f"{name} AS (SELECT token, CAST(row_number() OVER (ORDER BY freq DESC, first) + {start - 1} AS BIGINT) AS idx, "
            f"freq FROM ({cut}) c WHERE token NOT IN {SPECIAL_LIST}{ex})")


def d_encode(name: str, source: str, col_expr: str, vocab: str, keys: str = "pair_id") -> str:
    """DuckDB encode CTEs: explode with positions, left join, ordered regroup."""
    return (f"{name}_x AS (SELECT {keys}, unnest(CASE WHEN len(c) = 0 THEN [NULL] ELSE c END) AS token, "
            f"unnest(CASE WHEN len(c) = 0 THEN [NULL] ELSE generate_series(0, len(c) - 1) END) AS pos "
            f"FROM (SELECT {keys}, {col_expr} AS c FROM {source}) s), "
            f"{name} AS (SELECT {keys}, coalesce(list(coalesce(d.idx, 3) ORDER BY x.pos) "
            f"FILTER (WHERE x.pos IS NOT NULL), []) AS ids FROM {name}_x x LEFT JOIN {vocab} d "
            f"ON x.token = d.token GROUP BY {keys})")


TRAIN_SRC = "train_tok AS (SELECT * FROM vtok WHERE split = 'train')"
VAL_SRC = "val_tok AS (SELECT * FROM vtok WHERE split = 'validation')"


def _train_code_freq(spark, sf_dir, batch=None):
    return V.token_freq(valid_tokens(spark, sf_dir, "train"), "src", batch=batch)


@register("token_freq", oracle(
    "SELECT token, freq, CAST(first.p AS BIGINT) AS first_id, CAST(first.q AS BIGINT) AS first_pos FROM code_freq",
    CLEANED_CTE, VALID_TOKENS_CTE, TRAIN_SRC, d_freq("code_freq", "train_tok", "src")))
def q_token_freq(spark, sf_dir):
    f = _train_code_freq(spark, sf_dir)
    return f.select("token", "freq", F.col("first.id").alias("first_id"), F.col("first.pos").alias("first_pos"))


@register("build_vocab", oracle(
    f"SELECT * FROM code_vocab UNION ALL {SPECIALS_SQL}",
    CLEANED_CTE, VALID_TOKENS_CTE, TRAIN_SRC, d_freq("code_freq", "train_tok", "src"),
    d_vocab("code_vocab", "code_freq", 50000)))
def q_build_vocab(spark, sf_dir):
    return V.build_vocab(_train_code_freq(spark, sf_dir), 2, 50000)


# The same with other tokenizers: words of the docstring as they stand.
@register("build_vocab_tokenizer", oracle(
    f"SELECT * FROM word_vocab UNION ALL {SPECIALS_SQL}",
    CLEANED_CTE, f"wtok AS (SELECT pair_id, {D.whitespace_tokens('docstring')} AS tgt FROM valid WHERE split = 'train')",
    d_freq("word_freq", "wtok", "tgt"), d_vocab("word_vocab", "word_freq", 20000)))
def q_build_vocab_tokenizer(spark, sf_dir):
    vt = valid_tokens(spark, sf_dir, "train", doc_tokens=T.whitespace_tokens)
    return V.build_vocab(V.token_freq(vt, "tgt"), 2, 20000)


# A cap that bites at every scale: the cut keeps the 300 most frequent tokens.
@register("build_vocab_capped", oracle(
    f"SELECT * FROM code_vocab UNION ALL {SPECIALS_SQL}",
    CLEANED_CTE, VALID_TOKENS_CTE, TRAIN_SRC, d_freq("code_freq", "train_tok", "src"),
    d_vocab("code_vocab", "code_freq", 300)))
def q_build_vocab_capped(spark, sf_dir):
    return V.build_vocab(_train_code_freq(spark, sf_dir), 2, 300)


@register("build_vocab_uncapped", oracle(
    f"SELECT * FROM code_vocab UNION ALL {SPECIALS_SQL}",
    CLEANED_CTE, VALID_TOKENS_CTE, TRAIN_SRC, d_freq("code_freq", "train_tok", "src"),
    d_vocab("code_vocab", "code_freq", None)))
def q_build_vocab_uncapped(spark, sf_dir):
    return V.build_vocab(_train_code_freq(spark, sf_dir), 2, None)


@register("vocab_size", oracle(
    f"SELECT CAST(count(*) AS BIGINT) AS vocab_size FROM (SELECT * FROM code_vocab UNION ALL {SPECIALS_SQL}) v",
    CLEANED_CTE, VALID_TOKENS_CTE, TRAIN_SRC, d_freq("code_freq", "train_tok", "src"),
    d_vocab("code_vocab", "code_freq", 50000)))
def q_vocab_size(spark, sf_dir):
    return V.vocab_size(V.build_vocab(_train_code_freq(spark, sf_dir), 2, 50000))


# V3: vocabulary built on train, then extended with the validation split.
_EXT_CTES = (CLEANED_CTE, VALID_TOKENS_CTE, TRAIN_SRC, VAL_SRC,
             d_freq("f1", "train_tok", "src", 0), d_freq("f2", "val_tok", "src", 1),
             d_vocab("v1", "f1", 50000),
             "v1all AS (SELECT * FROM v1 UNION ALL " + SPECIALS_SQL + ")",
             "ftot AS (SELECT coalesce(a.token, b.token) AS token, CAST(coalesce(a.freq, 0) + coalesce(b.freq, 0) AS BIGINT) AS freq, "
             "coalesce(a.first, b.first) AS first FROM f1 a FULL OUTER JOIN f2 b ON a.token = b.token)",
             "v1n AS (SELECT count(*) AS n FROM v1all)")


@register("extend_vocab", oracle(
    "SELECT token, idx, freq FROM v1all UNION ALL "
    "SELECT token, CAST(row_number() OVER (ORDER BY freq DESC, first) + (SELECT n FROM v1n) - 1 AS BIGINT) AS idx, freq "
    "FROM (SELECT * FROM ftot WHERE freq >= 2 ORDER BY freq DESC, first LIMIT 50000 - (SELECT n FROM v1n)) c "
    "WHERE token NOT IN (SELECT token FROM v1all)", *_EXT_CTES))
def q_extend_vocab(spark, sf_dir):
    # One pass counts both batches (train = 0, validation = 1); the count table is
    # written once and read by the first build and by the accumulation.
    vt = valid_tokens(spark, sf_dir, "train", "validation")
    vt = vt.withColumn("batch", F.when(F.col("split") == "train", 0).otherwise(1))
    counts = materialize(V.token_freq(vt, "src", batch="batch", by=["batch"]), "token-counts")
    f1 = counts.where(F.col("batch") == 0).drop("batch")
    f2 = counts.where(F.col("batch") == 1).drop("batch")
    v1 = V.build_vocab(f1, 2, 50000)
    v2, _ = V.extend_vocab(v1, f1, f2, 2, 50000)
    return v2


@register("build_vocabularies", oracle(
    f"SELECT 'code' AS side, * FROM cv UNION ALL SELECT 'doc', * FROM dv "
    f"UNION ALL SELECT 'code', * FROM ({SPECIALS_SQL}) s UNION ALL SELECT 'doc', * FROM ({SPECIALS_SQL}) s2",
    CLEANED_CTE, VALID_TOKENS_CTE, TRAIN_SRC, d_freq("cf", "train_tok", "src"), d_freq("df", "train_tok", "tgt"),
    d_vocab("cv", "cf", 35000), d_vocab("dv", "df", 20000)))
def q_build_vocabularies(spark, sf_dir):
    freq = V.token_freq_sides(valid_tokens(spark, sf_dir, "train"), {"code": "src", "doc": "tgt"})
    return V.build_vocab_by(freq, "side", {"code": 35000, "doc": 20000})


# V4/V5: encode validation docstrings with the train docstring vocabulary.
_ENC_CTES = (CLEANED_CTE, VALID_TOKENS_CTE, TRAIN_SRC, VAL_SRC, d_freq("df", "train_tok", "tgt"),
             d_vocab("dv", "df", 20000),
             "dvall AS (SELECT * FROM dv UNION ALL " + SPECIALS_SQL + ")",
             "enc AS (SELECT v.pair_id, list(coalesce(d.idx, 3) ORDER BY v.pos) FILTER (WHERE v.pos IS NOT NULL) AS ids "
             "FROM (SELECT pair_id, unnest(CASE WHEN len(tgt) = 0 THEN [NULL] ELSE tgt END) AS token, "
             "unnest(CASE WHEN len(tgt) = 0 THEN [NULL] ELSE generate_series(0, len(tgt) - 1) END) AS pos FROM val_tok) v "
             "LEFT JOIN dvall d ON v.token = d.token GROUP BY v.pair_id)")


def _doc_vocab(spark, sf_dir):
    vt = valid_tokens(spark, sf_dir, "train")
    return V.build_vocab(V.token_freq(vt, "tgt"), 2, 20000)


@register("encode_tokens", oracle(
    "SELECT pair_id, array_to_string(coalesce(ids, []), ' ') AS ids FROM enc", *_ENC_CTES))
def q_encode_tokens(spark, sf_dir):
    enc = V.encode(valid_tokens(spark, sf_dir, "validation"), "tgt", _doc_vocab(spark, sf_dir), known_bound=20000)
    return enc.select("pair_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


# V4 by a vocabulary of any size: every code token of the train split has an id.
@register("encode_uncapped", oracle(
    "SELECT pair_id, array_to_string(ids, ' ') AS ids FROM eu",
    CLEANED_CTE, VALID_TOKENS_CTE, TRAIN_SRC, VAL_SRC, d_freq("code_freq", "train_tok", "src"),
    d_vocab("code_vocab", "code_freq", None, min_freq=1), "cuall AS (SELECT * FROM code_vocab UNION ALL " + SPECIALS_SQL + ")",
    d_encode("eu", "val_tok", "src", "cuall")))
def q_encode_uncapped(spark, sf_dir):
    tokens = materialize(valid_tokens(spark, sf_dir, "train", "validation").select("pair_id", "split", "src"), "code-tokens")
    voc = materialize(V.build_vocab(V.token_freq(tokens.where("split = 'train'"), "src"), 1, None), "vocabulary")
    enc = V.encode_by_join(tokens.where("split = 'validation'").select("pair_id", "src"), "src", voc)
    return enc.select("pair_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


# Decode the encoded ids plus one id outside the vocabulary (-> <UNK>).
@register("decode_ids", oracle(
    "SELECT e.pair_id, array_to_string(list(coalesce(d.token, '<UNK>') ORDER BY e.pos), ' ') AS tokens "
    "FROM (SELECT pair_id, unnest(list_append(coalesce(ids, []), 1000000007)) AS idx, "
    "generate_subscripts(list_append(coalesce(ids, []), 1000000007), 1) AS pos FROM enc) e "
    "LEFT JOIN dvall d ON e.idx = d.idx GROUP BY e.pair_id", *_ENC_CTES))
def q_decode_ids(spark, sf_dir):
    voc = _doc_vocab(spark, sf_dir)
    enc = V.encode(valid_tokens(spark, sf_dir, "validation"), "tgt", voc, known_bound=20000)
    enc = enc.withColumn("ids", F.concat("ids", F.array(F.lit(1000000007).cast("bigint"))))
    dec = V.decode(enc, "ids", voc, known_bound=20000)
    return dec.select("pair_id", T.join_tokens("tokens").alias("tokens"))


def train_vocabs(spark, sf_dir, tokens=None):
    """Code (35000) and doc (20000) vocabularies from the train split, as (side, token, idx, freq).
    ``tokens``: an already computed (pair_id, split, src, tgt) table to count from."""
    vt = tokens.where(F.col("split") == "train") if tokens is not None else valid_tokens(spark, sf_dir, "train")
    freq = V.token_freq_sides(vt, {"code": "src", "doc": "tgt"})
    return V.build_vocab_by(freq, "side", {"code": 35000, "doc": 20000})


VOCABS_CTES = (CLEANED_CTE, VALID_TOKENS_CTE, TRAIN_SRC, d_freq("cf", "train_tok", "src"),
               d_freq("df", "train_tok", "tgt"), d_vocab("cv", "cf", 35000), d_vocab("dv", "df", 20000),
               "cvall AS (SELECT * FROM cv UNION ALL " + SPECIALS_SQL + ")",
               "dvall AS (SELECT * FROM dv UNION ALL " + SPECIALS_SQL + ")")
