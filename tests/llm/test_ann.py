import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docpairs.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, class long, vector string, part int, ids string"


def table(spark, pairs):
    return spark.createDataFrame([(i, v, 1, 5, "x", 3, "y") for i, v in pairs], SCHEMA)


def brute_force(pairs, is_query, top=5):
    """Every query's nearest rows, by plain Python sums."""
    rows = sorted({(i, tuple(float(np.float32(x)) for x in v)) for i, v in pairs
                   if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)))
    out = {}
    for i, v in rows:
        if is_query(i):
            others = sorted((-round(cos(v, w), 12), j) for j, w in rows if (j, w) != (i, v))
            out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(others[:top])]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 12)))
    return out


def clustered(rnd, n, dim=16):
    centres = rnd.standard_normal((20, dim)) * 3
    return centres[rnd.integers(0, 20, n)] + rnd.standard_normal((n, dim))


def recall(got, want):
    hits = sum(len({x[1] for x in got.get(q, [])} & {x[1] for x in rows}) for q, rows in want.items())
    return hits / sum(len(rows) for rows in want.values())


@pytest.mark.parametrize("make", [clustered, lambda rnd, n: rnd.standard_normal((n, 32))])
def test_recall_against_brute_force(spark, make):
    x = make(np.random.default_rng(3), 1500).astype(np.float32)
    pairs = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    got = found(ann.search(table(spark, pairs), lambda i: i % 50 == 0, piece=100, queries=7))
    want = brute_force(pairs, lambda i: i % 50 == 0)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == [1, 2, 3, 4, 5]
        assert rows == sorted(rows, key=lambda t: (-t[2], t[1]))[:5]


def test_parts_are_balanced_and_cut_few_edges():
    x = ann.unit(clustered(np.random.default_rng(1), 2000))
    graph = ann.nearest(x, np.arange(2000), 10)
    part = ann.balanced_parts(graph, 8)
    size = np.bincount(part, minlength=8)
    assert size.min() >= 2000 / 8 * 0.94 and size.max() <= 2000 / 8 * 1.06
    inside = (part[:, None] == part[graph]).mean()
    assert inside > 0.75     # 0.125 by chance


def test_one_query_looks_in_few_parts():
    x = ann.unit(clustered(np.random.default_rng(2), 3000))
    router = ann.fitted(x, ann.nearest(x, np.arange(3000), 10), 8)
    looks = router.looks(x, np.bincount(router.part(x), minlength=8), 6)
    assert looks.any(axis=1).all() and looks.sum(axis=1).mean() < 4


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    pairs = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (3, [2.0, 0.0]), (9, [0.0, -1.0]), (100, [0.0, 0.0]), (150, None),
             (200, [None, 1.0]), (250, [nan, 1.0]), (300, [1.0, inf]), (None, [1.0, 1.0]), (350, [1.0]), (8, []), (400, [-1.0, 1e-30])]
    two = [(i, v) for i, v in pairs if v is not None and len(v) == 2 or v is None]
    got = found(ann.search(table(spark, pairs), lambda i: i % 50 == 0))
    assert got == brute_force(two, lambda i: i % 50 == 0)
    assert set(got) == {0, 50, 400} and [x[1] for x in got[0]] == [3, 7, 50, 9, 400]


def test_too_few_and_no_rows(spark):
    df = table(spark, [(50, [1.0, 2.0]), (1, [1.0, 0.0])])
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.search(df, lambda i: i % 50 == 0).collect()] == [(50, 1, 1)]
    assert ann.search(df.where("vec_id = 50"), lambda i: i % 50 == 0).count() == 0
    assert ann.search(df.limit(0), lambda i: i % 50 == 0).count() == 0


def test_hot_vector_is_searched_once(spark):
    """A third of all rows hold one vector; ties go to the smaller ids, the query itself is left out."""
    rnd = np.random.default_rng(4)
    hot = [1.0] * 8
    pairs = [(i, hot if i % 3 == 0 else [float(np.float32(y)) for y in rnd.standard_normal(8)]) for i in range(900)]
    got = found(ann.search(table(spark, pairs), lambda i: i % 50 == 0))
    want = brute_force(pairs, lambda i: i % 50 == 0)
    for q in range(0, 900, 150):
        assert got[q] == want[q] and [x[1] for x in got[q]] == [i for i in (0, 3, 6, 9, 12, 15) if i != q][:5]
    classes = ann.classes_of(ann.usable(table(spark, pairs)), 5)
    assert classes.count() == 601 and classes.agg(F.max(F.size("ids"))).first()[0] == 6


def test_rows_that_share_an_id(spark):
    pairs = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0])]
    rows = {(r["rank"], r.vec_id, round(r.score, 6)) for r in ann.search(table(spark, pairs), lambda i: i % 50 == 0).collect()}
    assert rows == {(1, 1, 0.707107), (2, 0, 0.0)}


def test_query_has_five_for_each(spark, sf):
    rows = ann.op12_learned_partitions(spark, sf).collect()
    pairs = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute_force(pairs, lambda i: i % 50 == 0)
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: len(x) for q, x in got.items()} == dict.fromkeys(want, 5) and recall(got, want) >= 0.9
