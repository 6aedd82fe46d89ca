import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from docpairs.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.encode_special_tokens = True


def ids_of(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["the", "Word", " ", "\n", "  ", ".", "!?", "é", "漢字", "'s", "7", "\t", "\x1c", "\x85", "<|endoftext|>"]), max_size=30))
def test_forms_give_the_ids_of_the_whole_text(parts):
    text = "".join(parts)
    assert np.frombuffer(P._encoder(PATH).encode(text), "<u4").tolist() == ids_of(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60), st.just(30))
def test_bins_hold_every_length_once(lengths, capacity):
    for bins in (P.best_fit_decreasing(lengths, capacity), P.bin_completion(lengths, capacity, 200)):
        assert sorted(x for b in bins for x in b) == sorted(lengths) and all(sum(b) <= capacity for b in bins)
    assert len(P.bin_completion(lengths, capacity, 200)) <= len(P.best_fit_decreasing(lengths, capacity))


def fewest(lengths, capacity):
    """Smallest number of bins, by trying every assignment."""
    best = [len(lengths)]

    def place(i, spaces):
        if len(spaces) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(spaces)
            return
        for s in set(spaces):
            if s >= lengths[i]:
                rest = list(spaces)
                rest.remove(s)
                place(i + 1, rest + [s - lengths[i]])
        place(i + 1, list(spaces) + [capacity - lengths[i]])
    place(0, [])
    return best[0]


@pytest.mark.parametrize("lengths", [[6, 5, 5, 4, 4, 3, 3], [7, 6, 4, 3, 2, 2, 2], [9, 1, 8, 2, 7, 3], [4, 4, 4, 3, 3, 3, 3, 3, 3]])
def test_search_finds_the_fewest_bins(lengths):
    assert len(P.bin_completion(lengths, 10)) == fewest(sorted(lengths, reverse=True), 10)


def test_search_beats_best_fit():
    lengths = np.random.default_rng(0).integers(500, 1100, 1500).tolist()
    assert len(P.bin_completion(lengths, 2048)) < len(P.best_fit_decreasing(lengths, 2048))


def test_pieces_and_sequences(docs):
    texts = ["a b c", None, "", "word " * 5000, "x" * 3000, "two\nlines", "two\nlines"]
    got = P.packed_documents(docs(texts, [1, 2, None, 4, 5, 6, 6]), PATH, 512).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        assert len(r.ids) == 4 * r.length and r.length <= 512
    for doc, text in zip([1, 2, None, 4, 5], texts):
        pieces = sorted(by_doc[doc], key=lambda r: r.piece)
        ids = [i for p in pieces for i in np.frombuffer(p.ids, "<u4").tolist()]
        assert ids == ids_of(text or "") + [0]
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        assert all(p.length == 512 for p in pieces[1:])
    assert len(by_doc[6]) == 2
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 512


def test_digest_and_empty_table(docs):
    r = P.pack_digests(docs(["hello world"]), PATH).collect()[0]
    assert r.ids_crc32 == P.ids_crc32(ids_of("hello world") + [0]) and (r.start, r.offset, r.piece) == (0, 0, 0)
    assert P.pack_digests(docs(["a"]).limit(0), PATH).count() == 0


def test_groups_are_bounded(spark):
    rows = spark.range(5000).selectExpr("id AS doc_id", "0 AS piece", "cast(1 + id % 7 AS bigint) AS length")
    got = P.pack(rows, ["doc_id", "piece"], 10, group=500)
    assert got.count() == 5000 and got.groupBy("sequence_id").sum("length").where("`sum(length)` > 10").count() == 0
    assert got.select("sequence_id").distinct().count() <= 2000 + 10


def test_search_takes_any_number_of_pieces():
    rng = np.random.default_rng(0)
    for low, high in ((300, 401), (200, 501)):  # five and more pieces a bin
        lengths = rng.integers(low, high, 600).tolist()
        bins = P.bin_completion(lengths, 2048)
        assert sorted(x for b in bins for x in b) == sorted(lengths) and all(sum(b) <= 2048 for b in bins)
        assert len(bins) < len(P.best_fit_decreasing(lengths, 2048))
    lengths = rng.integers(50, 501, 1500).tolist()
    assert len(P.bin_completion(lengths, 2048)) == -(-sum(lengths) // 2048)


def test_fillings_of_many_pieces_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = rng.integers(12, 33, 11).tolist()
        assert len(P.bin_completion(lengths, 100)) == fewest(sorted(lengths, reverse=True), 100), lengths
    lengths = [23] * 4 + [27] * 4 + [17, 16, 17, 16, 17, 17]
    assert len(P.bin_completion(lengths, 100)) == fewest(sorted(lengths, reverse=True), 100)


def test_null_and_repeated_ids_fill_groups_evenly(spark):
    rows = spark.range(0, 4000).selectExpr("if(id < 3000, null, 7) AS doc_id", "0 AS piece", "cast(100 + id % 900 AS bigint) AS length")
    got = P.pack(rows, ["doc_id", "piece"], group=500)
    sizes = [r["count"] for r in got.groupBy((F.col("sequence_id") / 2**32).cast("int")).count().collect()]
    assert len(sizes) == 8 and sum(sizes) == 4000 and max(sizes) < 620
    assert got.columns == ["doc_id", "piece", "length", "sequence_id", "offset"]
    full = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.where("n <> end OR n > 2048").count() == 0
