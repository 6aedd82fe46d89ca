import hashlib
import os
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from docpairs.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.transducer.ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_library(text):
    c = bpe.codec(PATH, public_tokenizers.PATTERN)
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.transducer.ranks, special_tokens={})
    assert c.encode(text) == e.encode_ordinary(text)


def test_mixed_texts_and_round_trip(codec, library):
    rnd = random.Random(1)
    letters = "abcéñ漢字 \n\t  \x1c\x85'sdt1234ⅷ!?.<|endoftext|>🙂́  "
    for _ in range(1000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(60)))
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text)
        assert "".join(codec.decode(ids, 2)) == text


def test_long_pre_tokens_and_small_state_tables(codec, library):
    text = "a" * 5000 + "!" * 3000 + " " * 3000 + "é" * 2000
    assert codec.encode(text) == library.encode_ordinary(text)
    small = bpe.Transducer(codec.transducer.ranks, max_states=50)
    for word in ("entirely", "antidisestablishmentarianism", "zzzzqqqq") * 20:
        assert small.encode(word.encode()) == library._encode_single_piece(word)


def test_any_bytes(codec, library):
    rnd = random.Random(2)
    for _ in range(300):
        data = os.urandom(rnd.randrange(1, 40))
        assert codec.transducer.encode(data) == library._encode_single_piece(data)


def test_tokens_that_stand_together_are_what_merging_leaves(codec):
    t, rnd = codec.transducer, random.Random(3)
    for _ in range(2000):
        a, b = rnd.randrange(50256), rnd.randrange(50256)
        x, y = t.token[a], t.token[b]
        assert t.follows(a, b) == (bpe.merge_by_rank(x + y, t.ranks) == [x, y])


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.lists(st.integers(1, 5), min_size=1, max_size=40))
def test_utf8_stream_equals_whole_decoding(data, sizes):
    s, out, at = bpe.Utf8Stream(), "", 0
    for n in sizes:
        out += s.feed(data[at:at + n])
        at += n
    assert out + s.feed(data[at:]) + s.end() == data.decode("utf-8", errors="replace")


def test_tables(docs, library):
    texts = ["Hello, world", None, "", "x " * 40000, "same", "same"]
    src = docs(texts, [1, 2, 3, None, 5, 5])
    got = bpe.codec_digests(src, PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == 6
    for r, t in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), ["Hello, world", "", "", "same", "same", "x " * 40000]):
        ids = library.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    encoded = bpe.encode_documents(src, PATH, public_tokenizers.PATTERN)
    back = bpe.decode_documents(encoded, PATH, public_tokenizers.PATTERN)
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for t in texts)
    assert bpe.codec_digests(src.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
