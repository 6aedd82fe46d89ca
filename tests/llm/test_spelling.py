import random
import re
from collections import Counter
from zlib import crc32

import pytest

from docpairs.llm import spelling

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counted(rows, min_length=6, min_count=5):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            code = crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and code % 199 == 0:
                run = run[:code % len(run)] + run[code % len(run) + 1:]
            seen[run] += 1
    return {w: n for w, n in seen.items() if n >= min_count and len(w) >= min_length}


def brute_force(words, factor=5):
    forms, out = {}, []
    beside = {w: [v for v in words if near(w, v)] for w in words}
    for w, n in words.items():
        best = min(beside[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= factor * n:
            forms[w] = best
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, forms.get(w), root, n, len(beside[w]), words[forms[w]] if w in forms else None))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def crowded(seed=5, number=900):
    """Words of three letters, so that most have near words, many of them."""
    rnd = random.Random(seed)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randint(6, 9))): rnd.choice([5, 6, 30, 200]) for _ in range(number)}
    # A third of all words share a long prefix.
    words.update({"consolidat" + "".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 4))): 5 for _ in range(number // 2)})
    return words


@pytest.mark.parametrize("block, seekers", [(8192, 65536), (40, 25), (1, 7)])
def test_near_words_whatever_the_blocks(spark, block, seekers):
    words = crowded()
    found = spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), block, seekers)
    want = {}
    for w in words:
        beside = [v for v in words if near(w, v)]
        if beside:
            best = min(beside, key=lambda v: (-words[v], v))
            want[w] = (w, len(beside), words[best], best)
    assert {r[0]: tuple(r) for r in found.collect()} == want


def test_scan_skips_ranges_that_are_too_far(monkeypatch):
    letters = "abcdefghijklmnopqrst"
    listed = sorted({"abc" + a + b + c + "x" for a in "de" for b in letters for c in letters} | {"abczzzzy"})
    rows, real = [], spelling.np.repeat
    monkeypatch.setattr(spelling.np, "repeat", lambda *a: rows.append(real(*a)) or rows[-1])
    at, who = spelling.scan(listed, ["abczzzzz"])
    assert [listed[a] for a in at] == ["abczzzzy"] and list(who) == [0]
    made = sum(map(len, rows)) // 2            # two arrays a depth
    assert len(listed) == 801 and made < 60    # 2 + 2 * 20 ranges are looked at, none of the 800 words in them


def test_blocks_hold_every_near_word():
    rnd = random.Random(2)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(6, 9))) for _ in range(400)})
    blocks = [words[i:i + 7] for i in range(0, len(words), 7)]
    lows, highs = [b[0] for b in blocks], [b[-1] for b in blocks]
    for w in words:
        looks = set(spelling.blocks_of(w, lows, highs))
        k = spelling.kept_prefix(len(w))
        assert {i for i, b in enumerate(blocks) if any(near(w, v) and v[:k] == w[:k] for v in b)} <= looks


def test_awkward_rows(spark, docs):
    texts = [None, "", "  ", "Straße straße STRASSE", "größere grössere", "colour " * 30, "color colors coloür", "colours " * 6, "colour-colours " * 5,
             "x" * 300 + " " + "y" * 299, "ÀÉÎõü×÷ÿ " * 7, "wordwordword " * 6, "wordwordwoord " * 40, "long " + "lengthy " * 50_000]
    texts += texts[5:9]
    ids = [None, 3, None, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 6, 7, 8, 9]
    df = docs(texts, ids)
    assert got(spelling.variants(df)) == brute_force(counted(zip(ids, texts)))
    assert got(spelling.variants(df.limit(0))) == []


def test_chains_of_forms(spark):
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625, "bbbbbb": 78125}
    rows = [(w, v, words[w]) for w, v in zip(words, list(words)[1:])]
    found = spelling.roots(spark.createDataFrame([r[:2] for r in rows], "word string, form string"))
    assert got(found) == sorted((w, "bbbbbb") for w in list(words)[:-1])


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(spelling.op11_spelling_variants(spark, sf)) == brute_force(counted(rows))
