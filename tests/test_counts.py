"""Token counts, lookups inside rows, words counted up to a bound, many small files."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from docpairs.functions import text as T
from docpairs.operators import extract as X
from docpairs.operators import vocab as V

ROWS = [(5, "a", ["x", "y", "x"]), (5, "a", ["y", "x", "z"]), (None, "b", ["z", None]), (-3, None, ["x", "w"]),
        (9, "a", []), (2, "b", None), (2**62, "c", ["x", "q"]), (None, "b", ["q", "z"])]
SCHEMA = "pair_id bigint, side string, tokens array<string>"


def expected(rows, key=lambda side: ()):
    n, first = Counter(), {}
    for i, side, tokens in rows:
        for pos, t in enumerate(tokens or []):
            at = (*key(side), t)
            n[at] += 1
            first[at] = min(first.get(at, (2, 0, 0)), (i is not None, i or 0, pos))
    return {at: (n[at], first[at][1] if first[at][0] else None, first[at][2]) for at in n}


def test_counts_of_null_repeated_and_large_ids(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).coalesce(2)
    got = {(r.token,): (r.freq, r.first.id, r.first.pos) for r in V.token_freq(df).collect()}
    assert got == expected(ROWS)
    got = {(r.side, r.token): (r.freq, r.first.id, r.first.pos) for r in V.token_freq(df, by=["side"]).collect()}
    assert got == expected(ROWS, lambda side: (side,))


def test_lookup_of_null_and_unknown_elements(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    look = V.lookup_in_row(spark, {"x": 7, "y": 8}, 3, "bigint")
    got = [r[0] for r in df.select(look("tokens")).collect()]
    assert got == [[{"x": 7, "y": 8}.get(t, 3) for t in tokens or []] for _, _, tokens in ROWS]
    names = V.lookup_in_row(spark, {7: "x"}, "<UNK>", "string")
    assert [r[0] for r in spark.createDataFrame([([7, 1],), (None,)], "ids array<bigint>").select(names("ids")).collect()] == [["x", "<UNK>"], []]
    assert spark.createDataFrame([(["a"],)], "t array<string>").select(V.lookup_in_row(spark, {}, 3, "bigint")("t")).first()[0] == [3]


@pytest.mark.parametrize("n", [3, 129])
def test_words_up_to_a_bound(spark, n):
    texts = [sep.join(["wé-"] * k) for k in (0, 1, n - 1, n, n + 1) for sep in (" ", "\n\t ", "　")]
    texts += [" " + texts[9] + "\x1c", "", " \n", "a" * 5000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.has_words("t", n)).collect()]
    assert got == [len(t.split()) >= n for t in texts]


def test_few_tasks_read_many_small_files(spark, tmp_path):
    for i in range(400):
        (tmp_path / f"{i}.py").write_text(f"x = {i}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # as where each task gets a few of very many files
    try:
        files = X.read_source_files(spark, str(tmp_path))
        assert files.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        assert sorted(bytes(r.source_code).decode() for r in files.collect()) == sorted(f"x = {i}" for i in range(400))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_counts_are_hashed_and_first_places_are_exact(spark, tmp_path):
    """The least (id, position) of a token is found without sorting all occurrences, in a
    table and in a stream; ids of any sign, repeated and null ones keep their order."""
    from docpairs.streaming import streams as ST
    big = (1 << 63) - 1
    rows = [(9, ["a", "b"]), (-5, ["c", "a", "a"]), (-5, ["d", "c"]), (None, ["e", "b", "e"]), (big, ["f", "g"]), (-big - 1, ["g", "f"])]
    df = spark.createDataFrame(rows, "pair_id long, tokens array<string>")
    want = {}
    for i, tokens in rows:
        for pos, t in enumerate(tokens):
            n, first = want.get(t, (0, None))
            place = (i is not None, i or 0, pos)
            want[t] = (n + 1, place if first is None else min(first, place))
    want = {t: (n, i if known else None, pos) for t, (n, (known, i, pos)) in want.items()}
    counts = [V.token_freq(df), V.token_freq(df, batch=3), V.token_freq(df.withColumn("part", F.lit(1)), batch="part", by=["part"])]
    df.repartition(3).write.json(f"{tmp_path}/in")
    for c in counts:
        assert "SortAggregate" not in c._jdf.queryExecution().executedPlan().toString()
    counts.append(ST.stream_token_counts(spark, f"{tmp_path}/in", df.schema, lambda s: s, files_per_trigger=1))
    for c in counts:
        assert {r.token: (r.freq, r.first.id, r.first.pos) for r in c.collect()} == want
