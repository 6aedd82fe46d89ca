import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docpairs.llm import lm as L


def tokens_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [None]


class Brute:
    """Interpolated modified Kneser-Ney of order 2, from its published definition."""

    def __init__(self, texts):
        self.words, self.pairs = Counter(), Counter()
        for t in texts:
            toks = tokens_of(t)
            self.words.update(toks)
            self.pairs.update(zip(["<s>", *toks], toks))
        self.tokens = sum(self.words.values())
        self.total, self.kinds, self.follows = Counter(), {}, Counter()
        for (a, b), n in self.pairs.items():
            self.total[a] += n
            self.kinds.setdefault(a, [0, 0, 0])[min(n, 3) - 1] += 1
            self.follows[b] += 1
        of = lambda c: [sum(n == k for n in c.values()) for k in (1, 2, 3, 4)]
        self.d2, self.d1 = L.discounts(of(self.pairs)), L.discounts(of(self.follows))

    def unigram(self, w):
        n, v = self.follows[w], len(self.words)
        left = sum(self.d1[min(k, 3) - 1] for k in self.follows.values()) / len(self.pairs)
        return max(n - (self.d1[min(n, 3) - 1] if n else 0), 0) / len(self.pairs) + left / (v + 1)

    def score(self, text):
        out, before = 0.0, "<s>"
        for w in tokens_of(text):
            p = self.unigram(w)
            if self.total[before]:
                n = self.pairs[(before, w)]
                left = sum(d * k for d, k in zip(self.d2, self.kinds[before])) / self.total[before]
                p = max(n - (self.d2[min(n, 3) - 1] if n else 0), 0) / self.total[before] + left * p
            out += math.log10(p)
            before = w
        return out

    def base(self, text):
        return sum(math.log10((self.words[w] + 1) / (self.tokens + len(self.words) + 1)) for w in tokens_of(text))


TEXTS = ["the cat sat on the mat", "The cat ate the rat", "a rat sat", None, "", "the the the the", "unseen only here",
         "the cat sat on the mat", "word " * 3000, "é É cat", "on the mat the cat sat on a rat and the rat ate the cat"] * 3


@pytest.mark.parametrize("small", [False, True])
def test_scores_against_brute_force(spark, docs, tmp_path, monkeypatch, small):
    if small:  # many shards and partial counts
        monkeypatch.setattr(L, "SHARD_TOKENS", 400)
    src = docs(TEXTS)
    train = [t for i, t in enumerate(TEXTS, 1) if i % 4]
    model = L.train(src.where("doc_id % 4 <> 0").repartition(3), f"file://{tmp_path}/lm")
    brute = Brute(train)
    assert model.tokens == brute.tokens and model.n_words == len(brute.words)
    assert np.allclose(model.d2, brute.d2) and np.allclose(model.d1, brute.d1)
    for r in L.score(src, model).collect():
        text = TEXTS[r.doc_id - 1]
        assert r.n_tokens == len(tokens_of(text)) and r.n_known == sum(w in brute.words for w in tokens_of(text))
        assert math.isclose(r.base_score, brute.base(text), rel_tol=1e-9)
        assert math.isclose(r.score, brute.score(text), rel_tol=1e-9)


def test_probabilities_sum_to_one():
    b = Brute(TEXTS)
    words = [*b.words, "never seen"]
    for before in ("<s>", "the", "nothing"):
        total = 0.0
        for w in words:
            p = b.unigram(w)
            if b.total[before]:
                n = b.pairs[(before, w)]
                left = sum(d * k for d, k in zip(b.d2, b.kinds[before])) / b.total[before]
                p = max(n - (b.d2[min(n, 3) - 1] if n else 0), 0) / b.total[before] + left * p
            total += p
        assert math.isclose(total, 1.0, rel_tol=1e-9)


def test_tally_hands_on_what_it_cannot_hold():
    t, got = L.Tally(held=50), Counter()
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 500, 4000).astype(np.uint64)
    for part in np.array_split(keys, 40):
        for k, n in t.add(part):
            got.update(dict(zip(k.tolist(), n.tolist())))
    for k, n in t.rest():
        for a, b in zip(k.tolist(), n.tolist()):
            got[a] += b
    # ``update`` with a dict adds counts
    assert got == Counter(keys.tolist())


def test_no_training_rows_and_empty_table(docs, tmp_path):
    src = docs(["a b", None, "c"], [1, None, 1])
    empty = L.train(src.limit(0), f"file://{tmp_path}/none")
    assert [(r.n_tokens, r.n_known, r.base_score, r.score) for r in L.score(src, empty).orderBy("n_tokens").collect()] == [
        (1, 0, 0.0, 0.0), (2, 0, 0.0, 0.0), (3, 0, 0.0, 0.0)]
    assert L.score(src.limit(0), empty).count() == 0


def test_query_against_brute_force(spark, sf):
    from docpairs.llm import queries
    got = queries.queries()["op3_kneser_ney"](spark, sf).collect()
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    out = {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 == 2}
    b, text = Brute([r.text for r in rows if r.doc_id not in out]), {r.doc_id: r.text for r in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id in out) and r.train_tokens == b.tokens
        assert math.isclose(r.base_score, b.base(text[r.doc_id]), rel_tol=1e-9)
        assert math.isclose(r.score, b.score(text[r.doc_id]), rel_tol=1e-9)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_counting_lets_go_of_the_last_model(tmp_path):
    from docpairs.llm import common, lm
    lm._words(str(tmp_path), (0,))
    assert common._HELD["tables"]
    list(lm._count_words(2)(iter([])))
    assert not common._HELD["tables"]
