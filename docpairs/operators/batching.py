"""Training examples and batches.

Id sequences are ``ARRAY<BIGINT>``. The vocabularies are bounded by their caps, so
they are broadcast; the token stream never shuffles on the token key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import EOS_IDX, MAX_SRC_LEN, MAX_TGT_LEN, PAD_IDX, SOS_IDX, UNK_IDX
from .index import dense_index, maybe_broadcast
from .vocab import BROADCAST_VOCAB_ROWS, lookup_in_row

CODE_VOCAB_SIZE, DOC_VOCAB_SIZE = 35000, 20000


def encode_sides(df: DataFrame, vocabs: DataFrame, sides: dict, keys=("pair_id",),
                 known_bound: int | None = None) -> DataFrame:
    """Encode several token columns of each row in one pass.

    ``sides`` maps vocabulary side -> (token column, max tokens or None). Output ``keys`` +
    one ``<side>_ids`` column per side, order kept, unknown -> 3, empty -> ``[]``. With
    ``known_bound`` (the vocabularies' total size cap) the ids are looked up inside the
    row; otherwise one explode over all sides, one join on (side, token) (broadcast when
    counted small) and one regroup by ``keys``."""
    keys = list(keys)
    if known_bound is not None and known_bound <= BROADCAST_VOCAB_ROWS:
        rows = vocabs.select("side", "token", "idx").limit(known_bound + 1).collect()
        if len(rows) > known_bound:
            raise ValueError(f"the vocabularies have more than the {known_bound} rows that were promised")
        out = []
        for side, (col, cap) in sides.items():
            look = lookup_in_row(df.sparkSession, {r["token"]: r["idx"] for r in rows if r["side"] == side}, UNK_IDX, "bigint")
            out.append(look(F.slice(col, 1, cap) if cap else F.col(col)).alias(f"{side}_ids"))
        return df.select(*keys, *out)
    arms = []
    for side, (col, cap) in sides.items():
        toks = F.slice(col, 1, cap) if cap else F.col(col)
        arms.append(F.struct(F.lit(side).alias("side"), toks.alias("toks")))
    ex = (df.select(*keys, F.explode(F.array(*arms)).alias("_a"))
          .select(*keys, F.col("_a.side").alias("side"), F.posexplode_outer("_a.toks").alias("pos", "token")))
    lookup = maybe_broadcast(vocabs.select("side", "token", "idx"))
    j = ex.join(lookup, ["side", "token"], "left")
    aggs = []
    for side in sides:
        item = F.when((F.col("side") == side) & F.col("pos").isNotNull(),
                      F.struct("pos", F.coalesce("idx", F.lit(UNK_IDX)).alias("idx")))
        aggs.append(F.array_sort(F.collect_list(item)).alias(f"_{side}"))
    g = j.groupBy(*keys).agg(*aggs)
    return g.select(*keys, *[F.transform(f"_{s}", lambda x: x["idx"]).alias(f"{s}_ids") for s in sides])


def seq2seq_examples(df: DataFrame, vocabs: DataFrame, src_col: str = "src", tgt_col: str = "tgt",
                     keys=("pair_id", "split"), max_src: int = MAX_SRC_LEN, max_tgt: int = MAX_TGT_LEN,
                     known_bound: int | None = None) -> DataFrame:
    """B1: source ids of at most ``max_src`` code tokens; target = SOS + ids of at most
    ``max_tgt`` doc tokens + EOS. ``vocabs`` has sides ``code`` and ``doc``."""
    enc = encode_sides(df, vocabs, {"code": (src_col, max_src), "doc": (tgt_col, max_tgt)}, keys, known_bound)
    return enc.select(*keys, F.col("code_ids").alias("src_ids"),
                      F.concat(F.array(F.lit(SOS_IDX).cast("bigint")), "doc_ids",
                               F.array(F.lit(EOS_IDX).cast("bigint"))).alias("tgt_ids"))


def pad_to(ids, n: int):
    """Truncate/pad an id array to exactly ``n`` with the pad id."""
    s = F.slice(ids, 1, n)
    return F.concat(s, F.array_repeat(F.lit(PAD_IDX).cast("bigint"), F.greatest(F.lit(n) - F.size(s), F.lit(0))))


def fixed_length_examples(ex: DataFrame, max_src: int = MAX_SRC_LEN, max_tgt: int = MAX_TGT_LEN,
                          keys=("pair_id", "split")) -> DataFrame:
    """B2: fixed-length example (input_ids, attention_mask, labels).

    Source = SOS + code ids + EOS, target = SOS + doc ids + EOS, each truncated to
    leave room for the frame and padded to the fixed length; labels keep pad ids."""
    keys = list(keys)
    src = F.concat(F.array(F.lit(SOS_IDX).cast("bigint")), F.slice("src_ids", 1, max_src - 2),
                   F.array(F.lit(EOS_IDX).cast("bigint")))
    tgt = F.concat(F.array(F.lit(SOS_IDX).cast("bigint")),
                   F.slice(F.slice("tgt_ids", 2, F.greatest(F.size("tgt_ids") - 2, F.lit(0))), 1, max_tgt - 2),
                   F.array(F.lit(EOS_IDX).cast("bigint")))
    out = ex.select(*keys, pad_to(src, max_src).alias("input_ids"), pad_to(tgt, max_tgt).alias("labels"))
    return out.withColumn("attention_mask", padding_mask("input_ids"))


def padding_mask(ids):
    """1 where the id is not the pad id."""
    return F.transform(ids, lambda x: (x != PAD_IDX).cast("int"))


def ordered_batches(df: DataFrame, batch_size: int, order=("pair_id",), group_cols=("split",)) -> DataFrame:
    """B4 (validation/test order): dense index per split in ``order``, batch = index div size.

    Uses the distributed dense index, so a split holding most rows is not sent to
    one task."""
    idx = dense_index(df, list(order), "_i", group_cols=list(group_cols))
    return (idx.withColumn("batch_id", F.floor(F.col("_i") / batch_size).cast("bigint"))
            .withColumn("pos_in_batch", (F.col("_i") % batch_size).cast("bigint")).drop("_i"))


# Shuffle-key rounds: a Feistel network over the two 32-bit halves of a 64-bit key. Every
# round is undone by itself, whatever its function, so the whole is a bijection: no two
# keys ever share a place. Products stay below 2^62, so no engine overflows.
HALF = (1 << 32) - 1
ROUND_MULTIPLIERS = (668265263, 374761393, 974634299, 526133989, 890112061, 737294741)


def round_keys(seed: int, epoch: int) -> list[int]:
    """A 32-bit number per round (splitmix64 of seed, epoch and round)."""
    out, word = [], (1 << 64) - 1
    for i in range(len(ROUND_MULTIPLIERS)):
        x = ((seed * 0x9E3779B97F4A7C15) ^ (epoch * 0xD1B54A32D192ED03) ^ ((i + 1) * 0x8CB92BA72F3D8DD7)) & word
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & word
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & word
        out.append((x ^ (x >> 31)) & HALF)
    return out


def shuffle_key(key, seed: int, epoch: int):
    """Repeatable pseudo-random order key of an integer ``key`` for (seed, epoch): a
    permutation of the 64-bit integers, so distinct keys stay distinct."""
    k = (F.col(key) if isinstance(key, str) else key).cast("bigint")
    left, right = F.shiftright(k, 32).bitwiseAND(F.lit(HALF)), k.bitwiseAND(F.lit(HALF))
    for mul, add in zip(ROUND_MULTIPLIERS, round_keys(seed, epoch)):
        mixed = F.shiftright(right * F.lit(mul).cast("bigint") + F.lit(add).cast("bigint"), 15)
        left, right = right, left.bitwiseXOR(mixed.bitwiseAND(F.lit(HALF)))
    return (left - F.lit(1 << 31)) * F.lit(1 << 32) + right


def shuffled_batches(df: DataFrame, batch_size: int, seed: int, epoch: int, key: str = "pair_id",
                     group_cols=("split",)) -> DataFrame:
    """B4 (train order): a repeatable shuffle per (seed, epoch), then batches.

    The shuffle order is ``shuffle_key(key, seed, epoch)``, which no two keys share; rows
    without a key stand first."""
    d = df.withColumn("_h", shuffle_key(key, seed, epoch))
    return ordered_batches(d, batch_size, order=("_h", key), group_cols=group_cols).drop("_h")


def pad_batches(df: DataFrame, cols=("src_ids", "tgt_ids"), batch_cols=("split", "batch_id")) -> DataFrame:
    """Pad every sequence to the longest in its batch with 0, per column.

    The window is per batch, so a group holds at most ``batch_size`` rows."""
    w = Window.partitionBy(*batch_cols)
    out = df
    for c in cols:
        m = F.max(F.size(c)).over(w)
        out = out.withColumn(c, F.concat(c, F.array_repeat(F.lit(PAD_IDX).cast("bigint"), m - F.size(c))))
    return out
