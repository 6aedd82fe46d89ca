"""Batching queries (B1-B5). Id sequences are compared as space-joined strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batching as B
from ..session import materialize
from .common import oracle, valid_tokens
from .q_vocab import VOCABS_CTES, d_encode, train_vocabs
from .registry import register

SEQ2SEQ_BATCH = 64


def _j(c):
    return F.array_join(F.col(c).cast("array<string>"), " ")


def examples(spark, sf_dir):
    """B1 over every split, with the train vocabularies.

    The corpus is cleaned and tokenised once: the token table is written to the
    shared checkpoint folder and both the vocabulary count and the encoding read it
    (instead of tokenising the train split twice, or every epoch)."""
    tokens = materialize(valid_tokens(spark, sf_dir), "valid-tokens")
    # The train vocabularies are capped at 35000 + 20000 entries by construction.
    return B.seq2seq_examples(tokens, train_vocabs(spark, sf_dir, tokens),
                              known_bound=B.CODE_VOCAB_SIZE + B.DOC_VOCAB_SIZE)


_EX_CTES = VOCABS_CTES + (
    d_encode("es", "vtok", "src[1:256]", "cvall"),
    d_encode("et", "vtok", "tgt[1:128]", "dvall"),
    "ex AS (SELECT v.pair_id, v.split, es.ids AS src_ids, list_concat([1], et.ids, [2]) AS tgt_ids "
    "FROM vtok v JOIN es ON v.pair_id = es.pair_id JOIN et ON v.pair_id = et.pair_id)",
    f"bt AS (SELECT *, CAST((row_number() OVER (PARTITION BY split ORDER BY pair_id) - 1) // {SEQ2SEQ_BATCH} AS BIGINT) AS batch_id, "
    f"CAST((row_number() OVER (PARTITION BY split ORDER BY pair_id) - 1) % {SEQ2SEQ_BATCH} AS BIGINT) AS pos_in_batch FROM ex)",
    "pb AS (SELECT pair_id, split, batch_id, "
    "list_resize(src_ids, max(len(src_ids)) OVER (PARTITION BY split, batch_id), 0) AS src_ids, "
    "list_resize(tgt_ids, max(len(tgt_ids)) OVER (PARTITION BY split, batch_id), 0) AS tgt_ids FROM bt)",
)


@register("seq2seq_examples", oracle(
    "SELECT pair_id, split, array_to_string(src_ids, ' ') AS src_ids, array_to_string(tgt_ids, ' ') AS tgt_ids FROM ex",
    *_EX_CTES))
def q_seq2seq_examples(spark, sf_dir):
    return examples(spark, sf_dir).select("pair_id", "split", _j("src_ids").alias("src_ids"),
                                          _j("tgt_ids").alias("tgt_ids"))


@register("fixed_length_examples", oracle(
    "SELECT pair_id, split, "
    "array_to_string(list_resize(list_concat([1], src_ids[1:254], [2]), 256, 0), ' ') AS input_ids, "
    "array_to_string(list_transform(list_resize(list_concat([1], src_ids[1:254], [2]), 256, 0), lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END), ' ') AS attention_mask, "
    "array_to_string(list_resize(list_concat([1], tgt_ids[2:len(tgt_ids) - 1][1:126], [2]), 128, 0), ' ') AS labels FROM ex",
    *_EX_CTES))
def q_fixed_length_examples(spark, sf_dir):
    fx = B.fixed_length_examples(examples(spark, sf_dir))
    return fx.select("pair_id", "split", _j("input_ids").alias("input_ids"),
                     _j("attention_mask").alias("attention_mask"), _j("labels").alias("labels"))


@register("ordered_batches", oracle(
    "SELECT pair_id, split, batch_id, pos_in_batch FROM bt", *_EX_CTES))
def q_ordered_batches(spark, sf_dir):
    vt = valid_tokens(spark, sf_dir).select("pair_id", "split")
    return B.ordered_batches(vt, SEQ2SEQ_BATCH)


@register("padded_batches", oracle(
    "SELECT pair_id, split, batch_id, array_to_string(src_ids, ' ') AS src_ids, "
    "array_to_string(tgt_ids, ' ') AS tgt_ids, CAST(len(src_ids) AS BIGINT) AS src_len FROM pb", *_EX_CTES))
def q_padded_batches(spark, sf_dir):
    b = B.pad_batches(B.ordered_batches(examples(spark, sf_dir), SEQ2SEQ_BATCH))
    return b.select("pair_id", "split", "batch_id", _j("src_ids").alias("src_ids"), _j("tgt_ids").alias("tgt_ids"),
                    F.size("src_ids").cast("bigint").alias("src_len"))


@register("padding_mask", oracle(
    "SELECT pair_id, array_to_string(list_transform(src_ids, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END), ' ') AS mask "
    "FROM pb", *_EX_CTES))
def q_padding_mask(spark, sf_dir):
    b = B.pad_batches(B.ordered_batches(examples(spark, sf_dir), SEQ2SEQ_BATCH))
    return b.select("pair_id", F.array_join(B.padding_mask("src_ids").cast("array<string>"), " ").alias("mask"))


def d_shuffle(col: str, source: str, seed: int, epoch: int) -> str:
    """``source`` with the two halves of its shuffle key, ``fl`` and ``fr``: one nested
    SELECT per round."""
    q = f"SELECT *, ({col} >> 32) & {B.HALF} AS fl, {col} & {B.HALF} AS fr FROM {source}"
    for mul, add in zip(B.ROUND_MULTIPLIERS, B.round_keys(seed, epoch)):
        q = f"SELECT * EXCLUDE (fl, fr), fr AS fl, xor(fl, ((fr * {mul} + {add}) >> 15) & {B.HALF}) AS fr FROM ({q})"
    return q


# Repeatable shuffle (seed 7, epoch 0) of each split, then batches of 64.
@register("shuffled_batches", oracle(
    f"SELECT pair_id, split, CAST((rn - 1) // {SEQ2SEQ_BATCH} AS BIGINT) AS batch_id, "
    f"CAST((rn - 1) % {SEQ2SEQ_BATCH} AS BIGINT) AS pos_in_batch FROM ("
    " SELECT pair_id, split, row_number() OVER (PARTITION BY split ORDER BY fl, fr) AS rn"
    f" FROM ({d_shuffle('pair_id', '(SELECT pair_id, split FROM vtok)', 7, 0)}) f) s", *_EX_CTES))
def q_shuffled_batches(spark, sf_dir):
    vt = valid_tokens(spark, sf_dir).select("pair_id", "split")
    return B.shuffled_batches(vt, SEQ2SEQ_BATCH, seed=7, epoch=0)
