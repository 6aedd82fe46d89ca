"""The pair and evaluation views on long lines: one row per whole line."""

from pyspark.sql import functions as F

from docpairs.operators import metrics as M
from docpairs.plans import q_metrics
from docpairs.sources import fixtures


def written(spark, tmp_path, texts):
    """A folder with a ``documents`` table of the texts, ids from 1."""
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts, 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_prediction_equal_to_its_reference_is_an_exact_match(spark, tmp_path):
    words = [f"{i:03d}" + "abcdfgo" * 2 + "xu" for i in range(100)]  # no letter that the predictions change
    line = " ".join(words)
    assert len(line) == 1999
    sf = written(spark, tmp_path, [line + str(i % 10) for i in range(300)])
    al = q_metrics._aligned(spark, sf).where("status <> 'missing_reference'")
    al = al.where("pair_id % 13 <> 0 AND pair_id % 17 <> 0")  # those have words before the line
    assert {r.status for r in al.select("status").collect()} == {"matched"}
    got = {r.metric: r.value for r in M.evaluate_all(al.withColumn("model", F.lit("file"))).collect()}
    assert got["Exact Match"] == got["ROUGE-L"] == got["BLEU-4"] == 100.0
    assert al.where("length(reference) = 2000 AND trim(prediction) = reference").count() == al.count() > 0


def longest_common(a, b):
    """Length of the longest common subsequence, by the plain dynamic programme."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def test_long_lines_stay_whole_and_ids_apart(spark, tmp_path):
    long = "abcdefghi " * 26000  # 260,000 characters
    texts = [long + "\nsecond line\n", "third line", "m1 the m2 " * 300]
    lines = sorted(line for t in texts for line in t.split("\n"))
    sf = written(spark, tmp_path, texts)
    rows = fixtures.view(spark, sf, "eval_pairs").where("model = 'beta'").collect()
    assert sorted(r.reference for r in rows) == lines
    pairs = fixtures.view(spark, sf, "pairs").collect()
    assert sorted(r.pair_id for r in pairs) == sorted(r.pair_id for r in rows) == sorted({r.pair_id for r in rows})


def test_counts_and_lcs_of_long_lines_against_brute_force(spark, tmp_path):
    texts = [" ".join(f"{w}{(i * k) % 23}" for i in range(400) for w in ("th", "x")) for k in (3, 7, 11)]
    sf = written(spark, tmp_path, texts)
    pairs = {(r.model, r.pair_id): (r.prediction.lower().split(), r.reference.lower().split())
             for r in fixtures.view(spark, sf, "eval_pairs").collect()}
    got = {(r.model, r.pair_id): r.lcs for r in q_metrics.q_rouge_l_rows(spark, sf).collect()}
    assert got == {k: longest_common(p, r) for k, (p, r) in pairs.items()} and len(got) == 6
    totals = {(r.model, r.n): r.total for r in q_metrics.q_bleu_counts(spark, sf).collect()}
    assert all(totals[m, n] == 3 * (800 - n + 1) for m in ("alpha", "beta") for n in (1, 2, 3, 4))
    best = q_metrics.q_compare_models(spark, sf).where("metric = 'ROUGE-L'").collect()[0]
    assert best.beta == 100.0 and best.winner == "beta"
