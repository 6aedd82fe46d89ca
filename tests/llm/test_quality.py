import math
import zlib

import numpy as np

from docpairs.llm import quality as Q


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def gaussian(x, mean, cov):
    d = x - mean
    return -0.5 * (d @ np.linalg.solve(cov, d) + np.linalg.slogdet(cov)[1])


def test_scores_against_plain_densities():
    rng = np.random.default_rng(0)
    xs = {0: rng.normal(0, 1, (80, 4)), 1: rng.normal(1, 2, (120, 4))}
    moments = {}
    for c, x in xs.items():
        one = np.hstack([np.ones((len(x), 1)), x])
        moments[c] = one.T @ one
    got = Q.Model(moments).score(xs[0][:10])
    pooled = sum((x - x.mean(0)).T @ (x - x.mean(0)) for x in xs.values()) / 198
    covs = {}
    for c, x in xs.items():
        a = max(Q.TO_POOLED, 4 / (len(x) + 4))
        cov = (1 - a) * np.cov(x.T) + a * pooled
        covs[c] = (1 - Q.TO_DIAGONAL) * cov + Q.TO_DIAGONAL * np.diag(np.diag(pooled))
    for x, s in zip(xs[0][:10], got):
        z = math.log(121 / 81) + gaussian(x, xs[1].mean(0), covs[1]) - gaussian(x, xs[0].mean(0), covs[0])
        assert math.isclose(s, 1 / (1 + math.exp(-z)), rel_tol=1e-6)


def test_statistics_are_finite_and_of_the_whole_text():
    for t in ["", " ", "a", "A!!" * 1000, "é" * 50, "x\n" * 5, "word " * 100000]:
        x = Q.statistics(t)
        assert len(x) == len(Q.FEATURES) and all(map(math.isfinite, x))
    text = "plain words here\n" * 200
    assert Q.statistics(text) != Q.statistics(text + "BAD!! " * 30)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r.doc_id: r for r in Q.score_documents(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    held = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert good and bad
    assert np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good]) > 0.97
    assert np.mean([(s >= 0.3) == q for s, q in held]) > 0.93


def test_held_out_labels_are_not_used(spark, docs):
    out = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 5 == 0]
    texts = [("fine words in a row " * (i % 7 + 1)) if i % 2 else ("BAD!! %%% $$$ " * (i % 5 + 1)) for i in range(1, 60)]
    src = docs(texts)
    rows = [(i, i % 2, 0) for i in range(1, 60)]
    flipped = [(i, 1 - q if i in out else q, t) for i, q, t in rows]
    a = Q.score_documents(src, table(spark, rows)).orderBy("doc_id").collect()
    assert a == Q.score_documents(src, table(spark, flipped)).orderBy("doc_id").collect()


def test_awkward_inputs(spark, docs):
    src = docs([None, "", "some words here", "some words here"], [1, None, 3, 3])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in Q.score_documents(src, none).collect()] == [0.5] * 4
    one = Q.score_documents(src, table(spark, [(1, 1, 0), (3, 1, 0), (99, None, 0), (77, 0, 0)])).collect()
    assert len(one) == 4 and len({r.score for r in one}) == 1 and one[0].score > 0.5
    assert Q.score_documents(src.limit(0), none).count() == 0
    kept = Q.keep_good(src, none)
    assert kept.columns == src.columns and kept.count() == 4 and Q.keep_good(src.limit(0), none).count() == 0
