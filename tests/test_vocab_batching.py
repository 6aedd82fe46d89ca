"""Vocabulary order, extension, encode/decode invariants, dense index, batching."""

import pytest
from pyspark.sql import functions as F

from docpairs.operators import batching as B
from docpairs.operators import vocab as V
from docpairs.operators.index import dense_index


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(0, ["b", "a", "c", "a"]), (1, ["c", "b", "<UNK>", "<UNK>", "d"]), (2, ["e", "b", "d"]), (3, [])]
    return spark.createDataFrame(rows, "pair_id long, tokens array<string>")


def test_build_vocab_ties_by_first_appearance(corpus):
    voc = {r["token"]: r["idx"] for r in V.build_vocab(V.token_freq(corpus), 2, 50000).collect()}
    # freq: b3, a2, c2, <UNK>2, d2; ties (2) in first-seen order a, c, <UNK>, d; <UNK> keeps id 3.
    assert voc == {"<PAD>": 0, "<SOS>": 1, "<EOS>": 2, "<UNK>": 3, "b": 4, "a": 5, "c": 6, "d": 7}


def test_special_token_takes_a_slot_in_the_cut(corpus):
    voc = {r["token"]: r["idx"] for r in V.build_vocab(V.token_freq(corpus), 2, 8).collect()}
    # cut = 8 - 4 = 4 slots: b, a, c, <UNK>; d falls out.
    assert voc == {"<PAD>": 0, "<SOS>": 1, "<EOS>": 2, "<UNK>": 3, "b": 4, "a": 5, "c": 6}


def test_uncapped_equals_capped_when_cap_is_large(corpus):
    a = sorted(V.build_vocab(V.token_freq(corpus), 2, None).collect())
    b = sorted(V.build_vocab(V.token_freq(corpus), 2, 50000).collect())
    assert a == b


def test_extend_vocab_keeps_ids(spark, corpus):
    f1 = V.token_freq(corpus, batch=0)
    v1 = V.build_vocab(f1, 2, 50000)
    more = spark.createDataFrame([(10, ["e", "z", "z", "a"])], "pair_id long, tokens array<string>")
    v2, total = V.extend_vocab(v1, f1, V.token_freq(more, batch=1), 2, 50000)
    old = {r["token"]: r["idx"] for r in v1.collect()}
    new = {r["token"]: r["idx"] for r in v2.collect()}
    assert all(new[t] == i for t, i in old.items())
    # new tokens with freq >= 2 after accumulation: e (2, seen in batch 0) before z (2, batch 1)
    assert new["e"] == 8 and new["z"] == 9


def test_encode_decode_roundtrip_and_empty(corpus):
    voc = V.build_vocab(V.token_freq(corpus), 2, 50000)
    enc = {r["pair_id"]: r["ids"] for r in V.encode(corpus, "tokens", voc).collect()}
    assert enc[3] == [] and enc[2] == [3, 4, 7]
    dec = {r["pair_id"]: r["tokens"] for r in V.decode(V.encode(corpus, "tokens", voc), "ids", voc).collect()}
    assert dec[0] == ["b", "a", "c", "a"] and dec[2] == ["<UNK>", "b", "d"] and dec[3] == []


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_dense_index_partition_independent(spark, parts):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    out = dense_index(df, ["k"], "i", group_cols=["g"], num_partitions=parts)
    rows = out.collect()
    for g in range(3):
        ks = sorted((r["k"], r["i"]) for r in rows if r["g"] == g)
        assert [i for _, i in ks] == list(range(len(ks)))


def test_padding_to_batch_max(spark):
    rows = [(i, "train", list(range(1, 2 + i % 5)), [1, 2]) for i in range(10)]
    df = spark.createDataFrame(rows, "pair_id long, split string, src_ids array<long>, tgt_ids array<long>")
    b = B.pad_batches(B.ordered_batches(df, 4)).collect()
    for bid in {r["batch_id"] for r in b}:
        lens = {len(r["src_ids"]) for r in b if r["batch_id"] == bid}
        assert len(lens) == 1
    assert sorted({r["batch_id"] for r in b}) == [0, 1, 2]


def test_fixed_length_shapes(spark):
    df = spark.createDataFrame([(1, "train", [5] * 300, [1, 6, 7, 2])],
                               "pair_id long, split string, src_ids array<long>, tgt_ids array<long>")
    r = B.fixed_length_examples(df).first()
    assert len(r["input_ids"]) == 256 and r["input_ids"][0] == 1 and r["input_ids"][255] == 2
    assert r["labels"][:5] == [1, 6, 7, 2, 0] and len(r["labels"]) == 128
    assert sum(r["attention_mask"]) == 256


def test_failing_split_becomes_empty(spark, tmp_path):
    from docpairs.sources import io
    good = str(tmp_path / "train")
    spark.createDataFrame([(1, "def f(): pass", "Doc one two.")], "pair_id long, code string, docstring string") \
        .write.parquet(good)
    out = io.load_split_sources(spark, {"train": good, "validation": str(tmp_path / "missing")})
    rows = out.collect()
    assert [(r["split"], r["pair_id"], r["language"]) for r in rows] == [("train", 1, "python")]
    assert rows[0]["repo"] == ""


def test_prepare_with_counts_observes_one_pass(spark):
    from docpairs.plans.common import pairs
    from docpairs.plans.q_pairs import RAW_RENAME
    from docpairs.sources import io
    kept, obs = io.prepare_with_counts(pairs(spark, "/root/testdata/sf0.001"), None, RAW_RENAME)
    n = kept.count()
    got = obs.get
    assert sum(got[f"{s}_kept"] for s in io.SPLITS) == n
    assert sum(got[f"{s}_total"] for s in io.SPLITS) == pairs(spark, "/root/testdata/sf0.001").count()


def test_load_caps_are_first_rows_in_order(spark):
    from docpairs.plans.common import pairs
    from docpairs.plans.q_pairs import RAW_RENAME
    from docpairs.sources import io
    p = pairs(spark, "/root/testdata/sf0.001")
    train_ids = sorted(r["pair_id"] for r in p.where("split = 'train'").select("pair_id").collect())
    got = [r["pair_id"] for r in io.load_split(p, "train", 5, RAW_RENAME).collect()]
    assert sorted(got) == train_ids[:5]
    assert io.load_split(p, "train", 0, RAW_RENAME).count() == len(train_ids)  # 0 = no limit
    per = io.load_all_splits(p, 3, RAW_RENAME).groupBy("split").count().collect()
    assert sorted((r["split"], r["count"]) for r in per) == [("test", 3), ("train", 3), ("validation", 3)]


def test_repo_search_page_cap(spark):
    from docpairs.sources import io
    repos = spark.createDataFrame([(f"r{i}", f"u{i}", 200 + i, "python") for i in range(150)],
                                  "name string, url string, stars long, language string")
    out = io.repo_search(repos, max_repos=500).collect()
    assert len(out) == 100 and out[0]["stars"] == 349


def test_vectors_of_a_planted_corpus(spark):
    """Tokens with the same contexts are nearest neighbours; every token seen twice has a
    vector, whatever its rank."""
    from docpairs.operators import vectors as G
    rows = [(0, i, [w, "sits", "on", "the", m]) for i, (w, m) in enumerate(
        [("cat", "mat"), ("dog", "mat"), ("cat", "rug"), ("dog", "rug")] * 3)]
    rows += [(1, 100 + i, [w, "flies", "over", "every", m]) for i, (w, m) in enumerate([("bird", "sea"), ("plane", "sea")] * 4)]
    rows += [(1, 200, ["once"]), (1, 201, ["alone"]), (1, 202, ["alone"])]
    corpus = spark.createDataFrame(rows, "side int, id long, tokens array<string>")
    vecs = {r.token: r.vector for r in G.train_vectors(corpus, dim=64).collect()}
    assert "once" not in vecs and not any(vecs["alone"]) and len(vecs["cat"]) == 64

    def cosine(a, b):
        dot = sum(x * y for x, y in zip(a, b))
        return dot / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    for a, b in (("cat", "dog"), ("bird", "plane"), ("mat", "rug")):
        others = [t for t in vecs if t not in (a, "alone")]
        assert max(others, key=lambda t: cosine(vecs[a], vecs[t])) == b


def feistel(k, seed, epoch):
    left, right = (k >> 32) & B.HALF, k & B.HALF
    for mul, add in zip(B.ROUND_MULTIPLIERS, B.round_keys(seed, epoch)):
        left, right = right, left ^ (((right * mul + add) >> 15) & B.HALF)
    return (left - (1 << 31)) * (1 << 32) + right


def unshuffled(x, seed, epoch):
    left, right = (x >> 32) + (1 << 31), x & B.HALF
    for mul, add in reversed(list(zip(B.ROUND_MULTIPLIERS, B.round_keys(seed, epoch)))):
        left, right = right ^ (((left * mul + add) >> 15) & B.HALF), left
    k = (left << 32) + right
    return k - (1 << 64) if k >= 1 << 63 else k


def rank_correlation(keys):
    n = len(keys)
    rank = {i: r for r, i in enumerate(sorted(range(n), key=keys.__getitem__))}
    return 1 - 6 * sum((i - rank[i]) ** 2 for i in range(n)) / (n * (n * n - 1))


def test_shuffle_key_is_a_permutation(spark):
    ends = [0, 1, -1, 2**63 - 1, -2**63, 2**32, -2**32, 2**31 - 1, 2**40 + 7]
    df = spark.createDataFrame([(i,) for i in ends + list(range(500))] + [(None,)], "id bigint")
    for seed, epoch in ((7, 0), (7, 1), (123456789, 3)):
        got = df.select("id", B.shuffle_key("id", seed, epoch).alias("k")).collect()
        assert all(r["k"] == (None if r["id"] is None else feistel(r["id"], seed, epoch)) for r in got)
        assert all(unshuffled(r["k"], seed, epoch) == r["id"] for r in got if r["id"] is not None)
    orders = {tuple(sorted(range(500), key=lambda i: feistel(i, s, e))) for s, e in ((7, 0), (7, 1), (8, 0))}
    assert len(orders) == 3


@pytest.mark.parametrize("seed", [1, 7, 99])
def test_shuffle_keys_of_the_pairs_are_distinct_and_unordered(spark, seed):
    """Ids of the pairs differ by multiples of 2^31 - 1, so no remainder of them may be all that counts."""
    from docpairs.sources import fixtures
    ids = fixtures.view(spark, "/root/testdata/sf0.01", "pairs").select("pair_id")
    rows = ids.select("pair_id", B.shuffle_key("pair_id", seed, 0).alias("k")).orderBy("pair_id").collect()
    assert len({r["k"] for r in rows}) == len(rows) > 9000
    assert abs(rank_correlation([r["k"] for r in rows])) < 0.05
    first_lines = [r["k"] for r in rows if r["pair_id"] % fixtures.DOC_STEP == 0]
    assert len(first_lines) > 500 and abs(rank_correlation(first_lines)) < 0.1
