"""The evaluation reports against plain Python, on every whole line of a table."""

import math
import random
import re
from collections import Counter

import pytest
from docpairs.functions import overlap as O
from docpairs.functions.stem import rouge_stem
from docpairs.operators import metrics as M
from docpairs.plans import q_metrics
from docpairs.sources import fixtures
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def grams(tokens, n):
    return Counter(tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1))


def longest_common(a, b):
    """By the rule that a row of the table follows from the one before it."""
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def f_measure(p, r):
    return 2 * p * r / (p + r) if p + r > 0 else 0.0


def report(rows):
    """All metrics of (reference, prediction) rows."""
    hits, totals, hyp, ref, rouge, exact = [0] * 5, [0] * 5, 0, 0, {1: 0.0, 2: 0.0, "L": 0.0}, 0
    for reference, prediction in rows:
        r, p = reference.split(), prediction.split()
        hyp, ref = hyp + len(p), ref + len(r)
        for n in (1, 2, 3, 4):
            hits[n] += sum((grams(p, n) & grams(r, n)).values())
            totals[n] += max(len(p) - n + 1, 1)
        rs, ps = ([rouge_stem(t) for t in re.sub("[^a-z0-9]+", " ", x.lower()).split()] for x in (reference, prediction))
        for n in (1, 2):
            m = sum((grams(ps, n) & grams(rs, n)).values())
            rouge[n] += f_measure(m / max(len(ps) - n + 1, 1), m / max(len(rs) - n + 1, 1))
        if ps and rs:
            m = longest_common(ps, rs)
            rouge["L"] += f_measure(m / len(ps), m / len(rs))
        exact += prediction.strip().lower() == reference.strip().lower()
    out = {f"ROUGE-{k}": v / len(rows) * 100 for k, v in rouge.items()} | {"Exact Match": exact / len(rows) * 100}
    penalty = 1.0 if hyp > ref else 0.0 if hyp == 0 else math.exp(1 - ref / hyp)
    for k in (1, 2, 3, 4):
        logs = sum(math.log((hits[n] or 0.1) / totals[n]) for n in range(1, k + 1))
        out[f"BLEU-{k}"] = penalty * math.exp(logs / k) * 100 if hits[1] else 0.0
    return out


@pytest.fixture(scope="module")
def lines(spark):
    """Every line of up to 400 words (the rest go to the row tests) and its predictions."""
    df = fixtures.view(spark, SF, "eval_pairs").where(F.size(F.split("reference", " ")) <= 400)
    rows = {}
    for r in df.collect():
        rows.setdefault(r.model, []).append((r.reference, r.prediction))
    assert sum(map(len, rows.values())) > 2000
    return df, {m: report(x) for m, x in rows.items()}


def close(got, want):
    assert got.keys() == want.keys()
    assert not [(k, got[k], want[k]) for k in want if abs(got[k] - want[k]) > 0.0051]


def test_evaluate_all(lines):
    df, want = lines
    got = {}
    for r in M.evaluate_all(df).collect():
        got.setdefault(r.model, {})[r.metric] = r.value
    assert got.keys() == want.keys()
    for m in want:
        close(got[m], want[m])


@pytest.mark.parametrize("names", [["ROUGE-L"], ["Exact Match"], ["ROUGE-2", "BLEU-3"]])
def test_some_metrics_only(lines, names):
    df, want = lines
    rows = M.evaluate_all(df, metrics=names).collect()
    close({(r.model, r.metric): r.value for r in rows}, {(m, k): want[m][k] for m in want for k in names})


def test_compare_models(lines):
    df, want = lines
    rows = M.compare_models(M.evaluate_all(df), "alpha", "beta").collect()
    assert len(rows) == 8
    for r in rows:
        a, b = want["alpha"][r.metric], want["beta"][r.metric]
        assert abs(r.alpha - a) <= 0.0051 and abs(r.beta - b) <= 0.0051
        assert r.winner == ("alpha" if round(a, 2) > round(b, 2) else "beta")


def test_rows_of_every_line(spark):
    want = {}
    for r in fixtures.view(spark, SF, "eval_pairs").collect():
        a, b = ([rouge_stem(t) for t in re.sub("[^a-z0-9]+", " ", x.lower()).split()] for x in (r.prediction, r.reference))
        m = longest_common(a, b) if len(a) * len(b) < 200_000 else O.lcs_bits(a, b)
        want[r.model, r.pair_id] = (m, f_measure(m / len(a), m / len(b)) if a and b else 0.0)
    got = {(r.model, r.pair_id): (r.lcs, r.rougeL_f) for r in q_metrics.q_rouge_l_rows(spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)


def test_only_what_a_metric_needs_is_worked_out(lines):
    df, _ = lines
    plan = M.evaluate_all(df, metrics=["Exact Match"])._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan
    plan = M.evaluate_all(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("words, length", [(3, 60), (50, 60), (1000, 200), (5, 0)])
def test_both_ways_to_an_lcs(words, length):
    rnd = random.Random(words)
    for _ in range(40):
        a, b = ([f"w{rnd.randrange(words)}" for _ in range(rnd.randint(0, length))] for _ in range(2))
        if rnd.random() < 0.3:
            b = a[:len(a) // 2] + b[:3] + a[len(a) // 2:]
        assert O.lcs(a, b) == O.lcs_bits(a, b) == O.lcs_matches(a, b) == longest_common(a, b)


def test_lcs_goes_by_matches_where_they_are_few(monkeypatch):
    import time
    used = []
    for name in ("lcs_matches", "lcs_bits"):
        monkeypatch.setattr(O, name, lambda a, b, f=getattr(O, name), name=name: used.append(name) or f(a, b))
    rnd = random.Random(1)
    few = [[f"w{rnd.randrange(150_000)}" for _ in range(200_000)] for _ in range(2)]
    began = time.time()
    O.lcs(*few)
    assert time.time() - began < 4 and used == ["lcs_matches"]   # 2 s on an idle machine
    used.clear()
    O.lcs(*[[f"w{rnd.randrange(3)}" for _ in range(3000)] for _ in range(2)])
    assert used == ["lcs_bits"]
    same = [f"w{i}" for i in range(200_000)]
    used.clear()
    assert O.lcs(same[:-1] + ["x"], same) == 199_999 and used in ([], ["lcs_matches"])
