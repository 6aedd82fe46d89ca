"""Evaluation demo (three pairs) and LCS paths."""

import math
import random

import pytest
from pyspark.sql import functions as F

from docpairs.functions import ngrams as N
from docpairs.operators import metrics as M

# Two own pairs and one equal pair; the expected values below are worked out by hand.
REFS = ["read the next line from the open file", "close all open files and leave", "count words"]
PREDS = ["read the next byte from the open file", "close files and then leave now", "count words"]


@pytest.fixture(scope="module")
def demo(spark):
    rows = [(i, "demo", r, p) for i, (r, p) in enumerate(zip(REFS, PREDS))]
    return spark.createDataFrame(rows, "pair_id long, model string, reference string, prediction string")


def test_bleu_counts(demo):
    rows = {r["n"]: r for r in M.bleu_counts(demo).collect()}
    # 7 + 4 + 2 words; read the | the next | from the | the open | open file, files and, count words; ...
    assert [rows[n]["matches"] for n in (1, 2, 3, 4)] == [13, 7, 3, 1]
    assert [rows[n]["total"] for n in (1, 2, 3, 4)] == [16, 13, 11, 9]
    assert rows[1]["hyp_len"] == 16 and rows[1]["ref_len"] == 16


def test_evaluate_all_demo(demo):
    got = {r["metric"]: r["value"] for r in M.evaluate_all(demo).collect()}
    p = [13 / 16, 7 / 13, 3 / 11, 1 / 9]
    bleu = [100 * math.prod(p[:k]) ** (1 / k) for k in (1, 2, 3, 4)]
    # ROUGE stems files to file, so the second pair still shares 4 of 6 words, 1 of 5 pairs,
    # and close file and leave in order; the third pair has one word pair.
    rouge1 = (7 / 8 + 4 / 6 + 1) / 3
    rouge2 = (5 / 7 + 1 / 5 + 1) / 3
    want = {f"BLEU-{k}": bleu[k - 1] for k in (1, 2, 3, 4)}
    want |= {"ROUGE-1": 100 * rouge1, "ROUGE-2": 100 * rouge2, "ROUGE-L": 100 * rouge1, "Exact Match": 100 / 3}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) <= 0.006 for k in want), (got, want)


def test_bleu_of_identical_text_is_100(spark):
    df = spark.createDataFrame([(1, "m", "a b c d e", "a b c d e")], "pair_id long, model string, reference string, prediction string")
    got = {r["metric"]: r["value"] for r in M.evaluate_all(df).collect()}
    assert got["BLEU-4"] == 100.0 and got["ROUGE-L"] == 100.0 and got["Exact Match"] == 100.0


def test_compare_models_tie_goes_to_second(spark):
    long = spark.createDataFrame([("a", "BLEU-1", 1.0), ("b", "BLEU-1", 1.0)], "model string, metric string, value double")
    assert M.compare_models(long, "a", "b").first()["winner"] == "b"


def _dp(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j in range(1, len(b) + 1):
            cur.append(prev[j - 1] + 1 if b[j - 1] == x else max(prev[j], cur[j - 1]))
        prev = cur
    return prev[-1]


def test_lcs_all_paths_match_plain_dp(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(160):
        la = rnd.choice([0, 3, 30, 70, 90, 130])
        lb = rnd.choice([0, 5, 40, 62, 63, 100, 124, 125, 200])
        rows.append((i, [rnd.choice("abcdefg") for _ in range(la)], [rnd.choice("abcdefgh") for _ in range(lb)]))
    df = spark.createDataFrame(rows, "i int, a array<string>, b array<string>")
    out = df.select("i", N.lcs_length("a", "b").alias("l"), N.lcs_length_dp("a", "b").alias("d")).collect()
    got = {r["i"]: (r["l"], r["d"]) for r in out}
    assert all(got[i] == (_dp(a, b), _dp(a, b)) for i, a, b in rows)


def test_porter_stemmer_examples():
    from docpairs.functions.stem import porter_stem
    cases = {"caresses": "caress", "ponies": "poni", "relational": "relat", "conditional": "condit",
             "hopping": "hop", "filing": "file", "happy": "happi", "adjustment": "adjust",
             "generalization": "gener", "agreed": "agre", "rate": "rate", "cease": "ceas",
             "controll": "control", "sized": "size", "motoring": "motor"}
    assert {w: porter_stem(w) for w in cases} == cases


def test_sorted_overlap_matches_multiset_counts(spark):
    from collections import Counter
    rnd = random.Random(11)
    rows = []
    for i in range(200):
        la, lb = rnd.choice([0, 1, 6, 50, 400]), rnd.choice([0, 3, 9, 50, 400])
        rows.append((i, [rnd.choice("abcdefgh") for _ in range(la)], [rnd.choice("abcdefghij") for _ in range(lb)]))
    df = spark.createDataFrame(rows, "i int, a array<string>, b array<string>")
    df = df.select("i", F.array_sort("a").alias("sa"), F.array_sort("b").alias("sb"))
    got = {r["i"]: r["m"] for r in df.select("i", N.sorted_overlap("sa", "sb").alias("m")).collect()}
    assert all(got[i] == sum((Counter(a) & Counter(b)).values()) for i, a, b in rows)


def test_long_text_counts_row_local_equals_exploded(spark):
    from docpairs.plans.q_whole import _whole_eval
    ev = _whole_eval(spark, "/root/testdata/sf0.001")
    a = sorted(tuple(r) for r in M.long_text_counts(ev, "r", "p").collect())
    b = sorted(tuple(r) for r in M.long_text_counts_exploded(ev, "r", "p").collect())
    assert a == b and len(a) == 4 * ev.count()


@pytest.mark.parametrize("word, stem", [
    ("caresses", "caress"), ("flies", "fli"), ("dies", "die"), ("mules", "mule"), ("denied", "deni"), ("died", "die"),
    ("agreed", "agre"), ("owned", "own"), ("humbled", "humbl"), ("sized", "size"), ("meeting", "meet"),
    ("stating", "state"), ("siezing", "siez"), ("itemization", "item"), ("sensational", "sensat"),
    ("traditional", "tradit"), ("reference", "refer"), ("colonizer", "colon"), ("plotted", "plot"), ("enjoy", "enjoy"),
    ("dying", "die"), ("ties", "tie"), ("possibly", "possibl"), ("happily", "happili"), ("sky", "sky"),
    ("skies", "sky"), ("news", "news"), ("falling", "fall"), ("hopping", "hop"), ("rate", "rate"), ("cease", "ceas")])
def test_stems_known_from_the_published_rules(word, stem):
    from docpairs.functions.stem import porter_stem
    assert porter_stem(word) == stem


def test_overlap_functions_match_the_column_forms(spark):
    from docpairs.functions import overlap as O
    rnd = random.Random(7)
    rows = [(i, [rnd.choice("abcdefg") for _ in range(rnd.randrange(90))], [rnd.choice("abcdefg") for _ in range(rnd.randrange(90))])
            for i in range(60)]
    df = spark.createDataFrame(rows, "i int, a array<string>, b array<string>")
    sides = df.select("i", "a", "b", *[F.array_sort(N.ngrams(c, n)).alias(f"{c}{n}") for c in "ab" for n in (1, 2, 3)])
    got = sides.select(O.clipped_overlaps("a", "b", (1, 2, 3)).alias("m"), O.lcs_lengths("a", "b").alias("l"),
                       *[N.sorted_overlap(f"a{n}", f"b{n}").alias(f"m{n}") for n in (1, 2, 3)],
                       N.lcs_length("a", "b").alias("d")).collect()
    assert all(list(r.m) == [r.m1, r.m2, r.m3] and r.l == r.d for r in got)
    for _, a, b in rows:
        assert O.lcs(a, b) == _dp(a, b)


def test_long_texts_evaluate(spark):
    words = [f"w{i % 5000}" for i in range(20000)]
    df = spark.createDataFrame([(1, "m", " ".join(words), " ".join(words[::-1]))],
                               "pair_id long, model string, reference string, prediction string")
    got = {r["metric"]: r["value"] for r in M.evaluate_all(df).collect()}
    assert got["ROUGE-1"] == 100.0 and 0 < got["ROUGE-L"] < 1


def test_clipped_counts_of_all_orders(monkeypatch):
    """Numbers in place of tuples of strings: the same counts for short, long, empty and equal rows."""
    import random

    from docpairs.functions import overlap as O
    rnd = random.Random(3)
    for size, kinds in ((0, 1), (1, 1), (3, 2), (40, 5), (300, 20), (3000, 900), (3000, 40)):
        a, b = ([f"w{rnd.randrange(kinds)}" for _ in range(size + k)] for k in (0, rnd.randrange(9)))
        for x, y in ((a, b), (b, a), (a, a), (a, []), ([], b), (a, b[:3]), (a, a[:-1] + ["x"])):
            want = [O.clipped(x, y, n) for n in (1, 2, 3, 4)]
            for short in (128, 0):
                monkeypatch.setattr(O, "SHORT", short)
                assert O.clipped_by_order(x, y, (1, 2, 3, 4)) == want and O.clipped_by_order(x, y, (2,)) == want[1:2]
    # More kinds of grams than 62 bits hold.
    a = [f"t{i}" for i in range(70000)]
    assert O.clipped_by_order(a, a[:60000] + a[:5], (1, 2, 3, 4)) == [60000, 59999, 59998, 59997] and O.clipped_by_order(a, a[1:], ()) == []
