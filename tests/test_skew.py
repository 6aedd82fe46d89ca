"""Skewed inputs: a token holding a third of all tokens, one oversized row, and a
split holding most rows. Results must stay exact; the plans rely on partial
aggregation, broadcast lookups and the range-partitioned dense index."""

import random
from collections import Counter

from pyspark.sql import functions as F

from docpairs.operators import vocab as V
from docpairs.operators.index import dense_index


def _corpus(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for pid in range(600):
        n = 4000 if pid == 7 else rnd.randint(0, 40)          # one oversized pair
        rows.append((pid, [("hot" if rnd.random() < 0.34 else rnd.choice(words)) for _ in range(n)]))
    return rows, spark.createDataFrame(rows, "pair_id long, tokens array<string>").repartition(17)


def test_hot_token_counts_and_encode_roundtrip(spark):
    rows, df = _corpus(spark)
    want = Counter(t for _, toks in rows for t in toks)
    assert want["hot"] > sum(want.values()) / 4
    freq = {r["token"]: r["freq"] for r in V.token_freq(df).collect()}
    assert freq == dict(want)
    plan = V.token_freq(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan  # map-side combine absorbs the hot token
    voc = V.build_vocab(V.token_freq(df), 2, 50000)
    dec = V.decode(V.encode(df, "tokens", voc, known_bound=50000), "ids", voc, known_bound=50000)
    got = {r["pair_id"]: r["tokens"] for r in dec.collect()}
    known = {r["token"] for r in voc.collect()}
    assert all(got[p] == [t if t in known else "<UNK>" for t in toks] for p, toks in rows)


def test_dense_index_with_dominant_group(spark):
    df = spark.range(0, 3000).select(F.col("id").alias("k"),
                                     F.when(F.col("id") % 10 == 0, "small").otherwise("big").alias("g"))
    out = dense_index(df, ["k"], "i", group_cols=["g"], num_partitions=17).collect()
    for g in ("big", "small"):
        ks = sorted((r["k"], r["i"]) for r in out if r["g"] == g)
        assert [i for _, i in ks] == list(range(len(ks)))


def test_encode_by_a_vocabulary_of_any_size(spark):
    """A token that is a third of the corpus is never joined, a long row comes back in chunks,
    rows may share ids and columns, and no vocabulary reaches the driver."""
    rows, df = _corpus(spark)
    voc = V.build_vocab(V.token_freq(df), 2, None)
    ids = {r["token"]: r["idx"] for r in voc.collect()}
    rows += [(3, ["hot", "new"]), (3, None), (3, [])]
    more = spark.createDataFrame(rows, "pair_id long, tokens array<string>").withColumn("idx", F.lit("x")).repartition(9)
    got = V.encode_by_join(more, "tokens", voc, chunk=64)
    want = sorted((p, tuple(t or ()), tuple(ids.get(x, 3) for x in t or ())) for p, t in rows)
    assert sorted((r["pair_id"], tuple(r["tokens"] or ()), tuple(r["ids"])) for r in got.collect()) == want
    assert got.columns == ["pair_id", "tokens", "idx", "ids"]
    assert [r["ids"] for r in V.encode(df.where("pair_id = 7"), "tokens", voc).collect()] == [[ids.get(x, 3) for x in rows[7][1]]]


def test_a_promised_bound_is_checked(spark):
    import pytest
    _, df = _corpus(spark)
    voc = V.build_vocab(V.token_freq(df), 2, None)
    with pytest.raises(ValueError, match="promised"):
        V.encode(df, "tokens", voc, known_bound=100)
