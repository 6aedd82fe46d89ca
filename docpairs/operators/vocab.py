"""Vocabulary: token counts, building, extending, encoding and decoding (V1-V7).

Vocabulary tables have the columns ``token STRING, idx BIGINT, freq BIGINT``; the
four special tokens hold ids 0..3 (freq 0). Count tables have
``token, freq, first`` where ``first`` orders tokens by first appearance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import explode_rows, place_base, place_of, place_parts
from ..functions.text import SPECIAL_TOKENS, UNK, UNK_IDX
from ..session import materialize
from .index import dense_index, maybe_broadcast

DEFAULT_MIN_FREQ = 2
DEFAULT_MAX_SIZE = 50000
# Broadcast bound for a vocabulary whose size is not capped by construction.
BROADCAST_VOCAB_ROWS = 2_000_000


def token_freq(df: DataFrame, tokens_col: str = "tokens", id_col: str = "pair_id",
               batch: int | str | None = None, by: list | None = None) -> DataFrame:
    """V1: frequency of each token and its first appearance.

    ``first`` = min struct(batch?, id, pos); ``batch`` is a constant or the name of a
    column (then also group by it to count several batches in one pass). Hot tokens
    are absorbed by the map-side partial aggregate, so the shuffle carries one
    partial per task and token. It is a hash aggregate unless a batch varies in a group."""
    by = list(by or [])
    carry = [batch] if isinstance(batch, str) and batch not in by else []
    bcol = F.col(batch) if isinstance(batch, str) else F.lit(batch)
    if not carry:
        ex = explode_rows(df.withColumn("_base", place_base(id_col)), [*by, "_base"], F.col(tokens_col), "token", "pos")
        least = (ex.groupBy(*by, "token").agg(F.count(F.lit(1)).cast("bigint").alias("freq"),
                                              F.min(place_of("_base", "pos")).alias("_place")))
        row_id, pos = place_parts("_place")
        first = ([bcol.cast("bigint").alias("batch")] if batch is not None else []) + [row_id.alias("id"), pos.alias("pos")]
        return least.select(*by, "token", "freq", F.struct(*first).alias("first"))
    ex = explode_rows(df, [*by, *carry, id_col], F.col(tokens_col), "token", "pos")
    parts = [bcol.cast("bigint").alias("batch"), F.col(id_col).cast("bigint").alias("id"), F.col("pos").cast("bigint").alias("pos")]
    return (ex.groupBy(*by, "token")
            .agg(F.count(F.lit(1)).cast("bigint").alias("freq"), F.min(F.struct(*parts)).alias("first")))


def token_freq_sides(df: DataFrame, sides: dict, id_col: str = "pair_id", batch: int | None = None) -> DataFrame:
    """V1 for several token columns in one pass: ``sides`` maps side name -> token
    column. One scan, one explode, one aggregate keyed by (side, token)."""
    arms = [F.struct(F.lit(k).alias("side"), F.col(c).alias("tokens")) for k, c in sides.items()]
    ex = df.select(id_col, F.inline(F.array(*arms)))
    return token_freq(ex, "tokens", id_col, batch=batch, by=["side"])


def _specials(spark) -> DataFrame:
    return spark.createDataFrame([(t, i, 0) for i, t in enumerate(SPECIAL_TOKENS)],
                                 "token string, idx bigint, freq bigint")


def _ranked_cut(freq: DataFrame, min_freq: int, limit: int | None) -> DataFrame:
    """Tokens with ``freq >= min_freq``, ranked from 0 by (freq desc, first appearance),
    the first ``limit`` of them when it is set.

    The counts are summed up by frequency first: there are few frequencies, and they tell
    the one at which the cut falls. Only tokens at or above it are ranked, by the
    distributed index, so no task ever holds the top of every other task."""
    counts = materialize(freq.where(F.col("freq") >= min_freq), "token-counts")
    if limit is not None:
        running = Window.orderBy(F.desc("freq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        by_freq = counts.groupBy("freq").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(running))
        last = by_freq.where(F.col("upto") >= max(int(limit), 0)).agg(F.max("freq")).first()[0]
        counts = counts.where(F.col("freq") >= F.lit(last if last is not None else min_freq))
    ranked = dense_index(counts, [F.desc("freq"), F.asc("first")], "rank")
    return ranked if limit is None else ranked.where(F.col("rank") < max(int(limit), 0))


def build_vocab(freq: DataFrame, min_freq: int = DEFAULT_MIN_FREQ,
                max_size: int | None = DEFAULT_MAX_SIZE) -> DataFrame:
    """V2: vocabulary from a count table.

    Ids from 4 in (freq desc, first appearance) order. A corpus token equal to a special
    token uses a slot of the cut but gets no new id: the ids after it close the gap."""
    n_special = len(SPECIAL_TOKENS)
    cut = _ranked_cut(freq, min_freq, (max_size - n_special) if max_size else None)
    taken = [r["rank"] for r in cut.where(F.col("token").isin(*SPECIAL_TOKENS)).select("rank").collect()]  # four at most
    gap = sum(((F.col("rank") > r).cast("bigint") for r in taken), F.lit(0).cast("bigint"))
    ids = (cut.where(~F.col("token").isin(*SPECIAL_TOKENS))
           .select("token", (F.col("rank") - gap + n_special).cast("bigint").alias("idx"), "freq"))
    return ids.unionByName(_specials(freq.sparkSession))


def build_vocab_by(freq: DataFrame, by: str, caps: dict, min_freq: int = DEFAULT_MIN_FREQ) -> DataFrame:
    """V7 shape: one vocabulary per value of ``by`` (e.g. side = code/doc).

    ``caps`` maps group value -> max_size; the groups are a small known set."""
    # One pass over the corpus: the count table (one row per group and token, far smaller
    # than the corpus) is written once and every group's cut reads it.
    freq = materialize(freq.where(F.col("freq") >= min_freq), "token-counts")
    parts = [build_vocab(freq.where(F.col(by) == k).drop(by), min_freq, cap)
             .withColumn(by, F.lit(k)) for k, cap in caps.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(by, "token", "idx", "freq")


def merge_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Accumulate two count tables: freq adds up, first appearance comes from the
    earlier batch (``first`` structs start with the batch number)."""
    o = old.select("token", F.col("freq").alias("_of"), F.col("first").alias("_o1"))
    n = new.select("token", F.col("freq").alias("_nf"), F.col("first").alias("_n1"))
    j = o.join(n, "token", "full_outer")
    return j.select("token",
                    (F.coalesce("_of", F.lit(0)) + F.coalesce("_nf", F.lit(0))).cast("bigint").alias("freq"),
                    F.coalesce("_o1", "_n1").alias("first"))


def extend_vocab(vocab: DataFrame, counts: DataFrame, new_counts: DataFrame,
                 min_freq: int = DEFAULT_MIN_FREQ, max_size: int | None = DEFAULT_MAX_SIZE):
    """V3: build again on more data. Returns (vocabulary, accumulated counts).

    Known tokens keep their ids; the cut is ``max_size - len(vocab)`` over the
    accumulated counts; cut tokens not yet known get the next ids in cut order."""
    total = merge_counts(counts, new_counts)
    vocab = materialize(vocab, "vocabulary")  # read three times below
    size = vocab.count()
    limit = None
    if max_size:
        limit = max_size - size
        if limit <= 0:
            return vocab, total
    cut = _ranked_cut(total, min_freq, limit)
    fresh = dense_index(cut.join(vocab.select("token"), "token", "left_anti"), ["rank"], "idx", start=size)
    return vocab.select("token", "idx", "freq").unionByName(fresh.select("token", "idx", "freq")), total


def lookup_in_row(spark, table: dict, default, kind: str):
    """An Arrow-batched function on arrays that replaces each element by its entry in
    ``table`` (null arrays become empty). For tables with a proven size bound only: the
    table goes to every worker once, and no element leaves its row."""
    entries = pa.array(list(table.values()), {"bigint": pa.int64(), "string": pa.string()}[kind])
    shared = spark.sparkContext.broadcast((pa.array(list(table)), entries))

    @F.arrow_udf(f"array<{kind}>")
    def look(lists: pa.Array) -> pa.Array:
        known, values = shared.value
        flat, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        found = values.take(pc.index_in(flat, value_set=known.cast(flat.type)))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), found.fill_null(default))
    return look


def _lookup_side(vocab: DataFrame, key: str, val: str) -> DataFrame:
    return maybe_broadcast(vocab.select(key, val), BROADCAST_VOCAB_ROWS)


#: Tokens of a chunk, the unit in which ids travel, and the share of all occurrences from
#: which on a token's id is broadcast (at most 1 / HOT_SHARE tokens reach it).
CHUNK, HOT_SHARE = 4096, 1e-3


def bounded_table(vocab: DataFrame, key: str, value: str, bound: int) -> dict:
    """A vocabulary of at most ``bound`` rows as a dictionary; a larger one is an error, so
    nothing unbounded reaches the driver on a caller's word."""
    rows = vocab.select(key, value).limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"the vocabulary has more than the {bound} rows that were promised")
    return {r[0]: r[1] for r in rows}


def encode_by_join(df: DataFrame, tokens_col: str, vocab: DataFrame, out_col: str = "ids", chunk: int = CHUNK,
                   share: float = HOT_SHARE) -> DataFrame:
    """``df`` with ``out_col``, the ids of ``tokens_col`` by a vocabulary of any size
    (unknown -> 3, order kept, ``[]`` for empty and null).

    Rows are cut into chunks, and each distinct token of a chunk is looked up once. Tokens
    with a large share of all occurrences (``vocab.freq``) are few; they go to the tasks as
    a table and never meet in one. The others are joined by token. What is found comes back
    by chunk, not by row, so a long row is many small groups; only rows of more than one
    chunk are put together again, by row."""
    spark = df.sparkSession
    chunks = F.when(F.size(tokens_col) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(tokens_col) - 1) / chunk).cast("int")),
                                                         lambda k: F.slice(F.col(tokens_col), k * chunk + 1, chunk)))
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "rows-to-encode")
    cut = materialize(rows.select("_row", F.size(tokens_col).alias("_n"), F.posexplode(chunks).alias("_chunk", "_tokens")), "token-chunks")
    total = vocab.agg(F.sum("freq")).first()[0] or 0
    top = vocab.where(F.col("freq") >= max(1, share * total))
    hot = bounded_table(top, "token", "idx", int(1 / share) + len(SPECIAL_TOKENS))
    shipped = spark.sparkContext.broadcast(hot)
    rare = F.array_distinct("_tokens")
    if hot:
        rare = F.array_except(rare, F.array(*[F.lit(t) for t in hot]))
    wanted = explode_rows(cut, ["_row", "_chunk"], rare)
    met = wanted.join(vocab.select("token", "idx"), "token")
    known = met.groupBy("_row", "_chunk").agg(F.collect_list("token").alias("_known"), F.collect_list("idx").alias("_ids"))

    @F.pandas_udf("array<bigint>")
    def put_back(tokens: pd.Series, known: pd.Series, ids: pd.Series) -> pd.Series:
        out = []
        for words, names, numbers in zip(tokens, known, ids):
            table = dict(zip(names, numbers)) if names is not None else {}
            get = shipped.value.get
            out.append([get(w) if w in shipped.value else table.get(w, UNK_IDX) for w in words])
        return pd.Series(out, dtype=object)

    encoded = cut.join(known, ["_row", "_chunk"], "left").select("_row", "_n", "_chunk", put_back("_tokens", "_known", "_ids").alias(out_col))
    one = encoded.where(F.col("_n") <= chunk).select("_row", out_col)
    parts = F.array_sort(F.collect_list(F.struct("_chunk", out_col)))
    many = encoded.where(F.col("_n") > chunk).groupBy("_row").agg(F.flatten(F.transform(parts, lambda x: x[out_col])).alias(out_col))
    return (rows.join(one.unionByName(many), "_row", "left").drop("_row")
            .withColumn(out_col, F.coalesce(out_col, F.array().cast("array<bigint>"))))


def encode(df: DataFrame, tokens_col: str, vocab: DataFrame, id_col: str = "pair_id",
           out_col: str = "ids", known_bound: int | None = None) -> DataFrame:
    """V4: token array -> id array, unknown -> 3, order kept, ``[]`` for empty input.

    ``known_bound`` is the vocabulary's size cap when it has one (e.g. ``max_size``): the
    ids are then looked up inside the row, without any shuffle. Otherwise they come by
    :func:`encode_by_join`. Returns (id_col, out_col)."""
    if known_bound is not None and known_bound <= BROADCAST_VOCAB_ROWS:
        look = lookup_in_row(df.sparkSession, bounded_table(vocab, "token", "idx", known_bound), UNK_IDX, "bigint")
        return df.select(id_col, look(F.col(tokens_col)).alias(out_col))
    return encode_by_join(df.select(id_col, tokens_col), tokens_col, vocab, out_col).select(id_col, out_col)


def decode(df: DataFrame, ids_col: str, vocab: DataFrame, id_col: str = "pair_id",
           out_col: str = "tokens", known_bound: int | None = None, keep_ids: bool = False) -> DataFrame:
    """V5: id array -> token array, unknown id -> ``<UNK>``. With ``keep_ids`` the
    input ids come back too. Capped vocabularies are looked up inside the row."""
    if known_bound is not None and known_bound <= BROADCAST_VOCAB_ROWS:
        look = lookup_in_row(df.sparkSession, bounded_table(vocab, "idx", "token", known_bound), UNK, "string")
        return df.select(id_col, *([ids_col] if keep_ids else []), look(F.col(ids_col)).alias(out_col))
    ex = df.select(id_col, F.posexplode_outer(ids_col).alias("pos", "idx"))
    j = ex.join(_lookup_side(vocab, "idx", "token"), "idx", "left")
    item = F.when(F.col("pos").isNotNull(),
                  F.struct("pos", "idx", F.coalesce("token", F.lit(UNK)).alias("token")))
    g = j.groupBy(id_col).agg(F.array_sort(F.collect_list(item)).alias("_s"))
    cols = [id_col] + ([F.transform("_s", lambda x: x["idx"]).alias(ids_col)] if keep_ids else [])
    return g.select(*cols, F.transform("_s", lambda x: x["token"]).alias(out_col))


def vocab_size(vocab: DataFrame) -> DataFrame:
    """V6: number of entries."""
    return vocab.agg(F.count(F.lit(1)).cast("bigint").alias("vocab_size"))
