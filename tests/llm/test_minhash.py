import random
import re

import numpy as np
import pyarrow as pa
import pytest

from docpairs.llm import minhash as M
from docpairs.llm import wordhash as W


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(texts, n):
    """Component of each text: every pair compared, links followed."""
    sets = {i: shingles(t, n) for i, t in texts.items()}
    name = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                x, y = sets[a], sets[b]
                if x and y and name[a] > name[b] and 100 * len(x & y) >= 80 * len(x | y):
                    name[a], changed = name[b], True
    return {i: min(name[i], i) for i in texts}, {i: len(s) for i, s in sets.items()}


def edited(rnd, words, share):
    return [rnd.choice("alpha beta gamma delta eps zeta".split()) + str(rnd.randrange(999)) if rnd.random() < share else w for w in words]


@pytest.fixture(scope="module")
def planted():
    rnd = random.Random(4)
    texts = [None, "", " \n", "one", "ONE", "one two", "É x", "é x", "long " * 30000]
    for _ in range(12):
        base = [f"w{rnd.randrange(4000)}" for _ in range(rnd.randrange(30, 300))]
        texts += [" ".join(edited(rnd, base, s)) for s in (0, 0, .01, .02, .04, .05, .06, .1)]
    big = [f"b{rnd.randrange(4000)}" for _ in range(120)]  # a group with links, chains and outliers
    texts += [" ".join(edited(rnd, big, rnd.choice([.01, .02, .05, .08, .12]))) for _ in range(120)]
    return dict(enumerate(texts, 1))


@pytest.mark.parametrize("n", [2, 5])
def test_components_against_brute_force(docs, planted, n):
    name, size = brute(planted, n)
    got = {r.doc_id: r for r in M.components(docs(list(planted.values())), n).collect()}
    assert {i: r.component_id for i, r in got.items()} == name
    assert all(r.n_shingles == size[i] and r.kept == (name[i] == i) for i, r in got.items())


def test_word_hashes():
    words = [b"abc", b"ABC", "Éa".encode(), b"a" * 70, b"b"]
    data = np.frombuffer(b" \n".join(words) + b"\t", np.uint8)
    number, hashes = W.words(data, np.array([0, len(data)]))
    assert number.tolist() == [0] * 5 and [int(h) for h in hashes] == [
        W.hash_word(b"abc"), W.hash_word(b"abc"), W.hash_word("Éa".encode()), W.hash_word(b"a" * 70), W.hash_word(b"b")]


def test_words_end_with_their_text_and_long_words_span_stretches(monkeypatch):
    monkeypatch.setattr(W, "STRETCH", 16)
    col = pa.array(["ab", "cd" * 40, "", "x y"])
    data, offsets = W.text_bytes(col)
    number, hashes = W.words(data, offsets)
    assert number.tolist() == [0, 1, 3, 3] and int(hashes[1]) == W.hash_word(b"cd" * 40) and int(hashes[3]) == W.hash_word(b"y")


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    common, own = rng.integers(0, 1 << 62, 800), rng.integers(0, 1 << 62, 200)
    a = np.unique(np.concatenate([common, own[:100]])).astype(np.uint64)
    b = np.unique(np.concatenate([common, own[100:]])).astype(np.uint64)
    s = M.min_max_signature(np.concatenate([a, b]), np.array([len(a), len(b)]), 400)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.05


def test_a_large_group_that_is_not_alike_enough(docs):
    """Variants of one text: few link, and the others yield no rows that grow in pairs."""
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    texts = dict(enumerate([" ".join(edited(rnd, base, rnd.choice([0, .02, .06, .09, .15, .3]))) for _ in range(150)], 1))
    name, _ = brute(texts, 2)
    got = {r.doc_id: r.component_id for r in M.components(docs(list(texts.values())), 2).collect()}
    assert got == name and 2 < len(set(name.values())) < 150


def test_rounds_do_not_grow_with_a_group(docs, monkeypatch):
    """Variants of one text, few of them linked: two rounds tell every pair. (A bucket's
    first members were compared round by round, up to 512 in each.) Buckets with more
    outsiders than a task takes have three rounds more at most."""
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    texts = dict(enumerate([" ".join(edited(rnd, base, rnd.choice([0, .02, .06, .09, .15, .3]))) for _ in range(150)], 1))
    name, _ = brute(texts, 2)
    written, tags = M.written, []
    monkeypatch.setattr(M, "written", lambda df, tag: (tags.append(tag), written(df, tag))[1])
    for piece, rounds in ((M.PIECE, 1), (16, 4)):
        monkeypatch.setattr(M, "PIECE", piece)
        tags.clear()
        assert {r.doc_id: r.component_id for r in M.components(docs(list(texts.values())), 2).collect()} == name
        assert 1 <= tags.count("apart") <= rounds


def test_members_unlike_the_first_are_told_by_their_differences(spark, monkeypatch):
    """Members far from their bucket's first member: their pairs are told in the task, and
    one that is not near makes no row (each was a row to be confirmed before)."""
    rnd = random.Random(5)
    sets = {0: frozenset(range(40))}    # the first member; the others share a fifth of it
    for i in range(1, 41):
        sets[i] = frozenset(range(8)) | frozenset(rnd.sample(range(100, 160), 50)) if i % 2 else frozenset(range(8)) | {1000 * i + k for k in range(50)}
    table = spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "doc_id long, shingles array<long>")
    pairs = spark.createDataFrame([(0, i) for i in sets if i], "a long, b long")
    near = M.compared(pairs, table).selectExpr("'x' AS bucket", "b AS id", "b AS component", "na", "nb", "common", "apart").cache()
    want = {(a, b) for a in range(1, 41) for b in range(a + 1, 41) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    firsts = M._first_members(near, 8, ["na", "nb", "common", "apart"])
    for long in (M.LONG, 20):    # as sets, and as sorted arrays
        monkeypatch.setattr(M, "LONG", long)
        links = [(r.a, r.b) for r in M.bucket_links(near, firsts, 80, piece=16).collect()]
        assert links and set(links) <= want and len(links) < 40
        assert {b for _, b in links} == {b for a, b in want if a <= 8}
    assert M.in_both(frozenset([1, 5]), np.array([1, 4, 5])) == M.in_both(np.array([1, 4, 5]), np.array([1, 5])) == 2


def test_compared_pairs(docs, spark):
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(50)]
    texts = [" ".join(edited(rnd, base, s)) for s in (0, .02, .1, .3, .9)]
    pairs = spark.createDataFrame([(i, j) for i in range(1, 6) for j in range(i + 1, 6)], "a long, b long")
    got = {(r.a, r.b): r for r in M.compared(pairs, M.full_sets(docs(texts), 2)).collect()}
    for i in range(1, 6):
        for j in range(i + 1, 6):
            x, y = shingles(texts[i - 1], 2), shingles(texts[j - 1], 2)
            assert ((i, j) in got) == (100 * len(x & y) >= M.NEAR * len(x | y))
            if (i, j) in got:
                r = got[i, j]
                assert (r.na, r.nb, r.common, len(r.apart)) == (len(x), len(y), len(x & y), len(x ^ y))
                assert r.linked == (100 * len(x & y) >= 80 * len(x | y))


def test_drop_near_copies(docs):
    text = " ".join(f"w{i}" for i in range(100))
    src = docs([text, text + " end", "alone", None, None, "q r s t u v", "q r s t u v"], [5, 3, 7, 8, None, None, 9])
    out = M.drop_near_copies(src)
    assert out.columns == src.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted(
        [(3, text + " end"), (7, "alone"), (8, ""), (0, ""), (0, "q r s t u v"), (9, "q r s t u v")])
    assert M.drop_near_copies(src.limit(0)).count() == 0 and M.components(src.limit(0), 2).count() == 0


def test_repeated_rows(docs):
    got = M.components(docs(["a b c d", "a b c d", "z"], [2, 2, 1]), 2).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (2, 2, True), (2, 2, True)]


def test_long_chains_of_components(spark):
    n = 400
    labels = spark.range(n).selectExpr("id", "id AS component")
    links = spark.range(n - 1).selectExpr("(id * 7) % 400 AS a", "(id * 7 + 7) % 400 AS b")
    got = M.merge_components(labels, links).collect()
    assert len(got) == n and {r.component for r in got} == {0}
