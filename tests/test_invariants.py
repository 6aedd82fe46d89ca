"""SURVEY §5 invariants: partition independence, stream = batch, padded length."""

import pytest

import __spark_entry__ as E
from docpairs.sources import fixtures

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", ["build_vocab_uncapped", "ordered_batches", "encode_tokens", "sampled_progress",
                                  "extend_vocab", "padded_batches"])
def test_partition_independence(spark, name):
    q = E.queries()[name]
    results = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 17):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            results.append(_rows(q(spark, SF)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] == results[2]


def test_stream_equals_batch(spark):
    qs = E.queries()
    assert _rows(qs["stream_prepare"](spark, SF)) == _rows(qs["valid_pairs"](spark, SF))
    s = {r["token"]: r["freq"] for r in qs["stream_token_freq"](spark, SF).collect()}
    from docpairs.operators import vocab as V
    from docpairs.plans.common import valid_tokens
    b = {r["token"]: r["freq"] for r in V.token_freq(valid_tokens(spark, SF), "src").collect()}
    assert s == b


def test_padded_length_is_batch_max(spark):
    rows = E.queries()["padded_batches"](spark, SF).collect()
    by_batch = {}
    for r in rows:
        by_batch.setdefault((r["split"], r["batch_id"]), set()).add(len(r["src_ids"].split(" ")))
    assert all(len(v) == 1 for v in by_batch.values())


def test_every_character_of_the_documents_reaches_the_views(spark):
    sf = "/root/testdata/sf0.001"
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]

    def blocks(size):
        return sorted(line[k:k + size] for t in texts for line in t.split("\n") for k in range(0, max(len(line), 1), size))
    refs = fixtures.view(spark, sf, "eval_pairs").where("model = 'alpha'").select("pair_id", "reference").collect()
    assert sorted(r.reference for r in refs) == blocks(fixtures.EVAL_BLOCK) and len({r.pair_id for r in refs}) == len(refs)
    lines = blocks(fixtures.PAIR_BLOCK)
    kept = fixtures.view(spark, sf, "pairs").select("raw_code", "raw_doc").collect()
    assert len(kept) == len(lines)
    for side, none in (("raw_code", 47), ("raw_doc", 41)):
        have = sum(r[side] is not None for r in kept)
        assert have > len(lines) * (1 - 2 / none)
    docs = fixtures.view(spark, sf, "pairs").where("raw_doc IS NOT NULL AND pair_id % 13 <> 0 AND pair_id % 17 <> 0 AND pair_id % 5 = 4").select("raw_doc").collect()
    assert {r.raw_doc[3:-3] for r in docs} <= set(lines)
    code = fixtures.view(spark, sf, "py_sources").select("source_code").collect()
    bodies = sorted(t.replace("\n", " ").replace('"', "").replace("\\", "") for t in texts)
    found = sorted(r.source_code.split('"""', 1)[1] for r in code)
    assert len(found) == len(bodies) and sum(map(len, found)) >= sum(map(len, bodies))
    assert all(any(f.startswith(b) for f in found) for b in bodies)


def test_plans_filter_first_and_scan_once(spark):
    from docpairs.plans import catalog
    sf, q = "/root/testdata/sf0.001", catalog.queries()

    def plan(name):
        return q[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    for name in ("load_all_splits", "prepare_dataset"):
        assert plan(name).count("Relation [") == 1
    text = plan("cooccurrence")
    assert text.rindex("train") > text.index("Generate inline")  # deeper in the tree: below the cleaning
    assert not any("Filter" in line and "split" in line for line in text[:text.index("Generate inline")].splitlines())
    for name in ("build_vocab", "build_vocabularies"):
        assert "GlobalLimit" not in plan(name)


def test_split_limits_are_ranked(spark):
    from docpairs.sources import io
    df = spark.range(100).selectExpr("id AS pair_id", "if(id % 2 = 0, 'train', 'test') AS split", "'c' AS code")
    got = io.load_splits(df, io.SPLITS, {"train": 7}).collect()
    assert sorted(r.pair_id for r in got if r.split == "train") == [0, 2, 4, 6, 8, 10, 12]
    assert sum(r.split == "test" for r in got) == 50


def test_stream_log_is_folded(spark, tmp_path):
    from docpairs.streaming import streams
    rows = spark.range(60).selectExpr("id", "concat('t', id % 7) AS token").repartition(12)
    rows.write.json(f"{tmp_path}/in")
    got = streams.stream_token_freq(spark, f"{tmp_path}/in", rows.schema, lambda df: df.selectExpr("array(token) AS tokens"),
                                    files_per_trigger=1, compact_every=3)
    assert {r.token: r.freq for r in got.collect()} == {f"t{k}": 9 if k < 4 else 8 for k in range(7)}


def test_stream_vocabulary_goes_on_after_a_restart(spark, tmp_path):
    """Counts and first appearances of a stream that stops and goes on are the table's, so the
    vocabulary is; old generations of the log are gone."""
    import os

    from docpairs.operators import vocab as V
    from docpairs.streaming import streams
    rows = spark.range(300).selectExpr("id AS pair_id", "array(concat('w', id % 17), concat('v', id % 5), 'all', concat('w', id % 3)) AS tokens")
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for k in range(12):
        rows.where(f"pair_id % 12 = {11 - k}").coalesce(1).write.mode("append").json(src)
        if k in (4, 11):
            got = streams.stream_token_counts(spark, src, rows.schema, lambda df: df, out=out, files_per_trigger=1, compact_every=3)
    want = V.token_freq(rows)
    plain = lambda df: sorted((r["token"], r["freq"], r["first"]["id"], r["first"]["pos"]) for r in df.collect())
    assert plain(got) == plain(want)
    ids = lambda df: sorted((r["token"], r["idx"], r["freq"]) for r in V.build_vocab(df, 2, 20).collect())
    assert ids(got) == ids(want)
    assert sorted(os.listdir(f"{out}/log")) == ["000002", "000003"]
