import numpy as np
import public_tokenizers
import pytest
from test_exact_dedup import lower
from test_minhash import brute
from tokenizers import Tokenizer

import corpus_pipeline as C
from docpairs.llm import packing, quality, secrets


def test_stages():
    assert [f.__name__ for _, f in C.STAGES] == ["good_quality", "without_copies", "without_near_copies", "without_secrets", "packed"]


@pytest.fixture(scope="module")
def ran(spark, sf):
    """The documents and every stage's rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables = [docs]
    for _, stage in C.STAGES:
        from docpairs.llm.common import written
        tables.append(written(stage(spark, tables[-1], sf), "test-stage"))
    return tables


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_quality_stage(spark, sf, ran):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in quality.score_documents(ran[0], labels).collect() if r.predicted}
    assert set(texts(ran[1])) == good and ran[1].columns == ran[0].columns
    bad = {r.doc_id for r in labels.collect() if r.quality == 0}
    assert len(bad & good) < len(bad) / 2


def test_copies_stage(ran):
    before, after = texts(ran[1]), texts(ran[2])
    last = {}
    for i, t in before.items():
        last[lower(t)] = max(i, last.get(lower(t), i))
    assert set(after) == set(last.values()) and ran[2].columns == ran[0].columns


def test_near_copies_stage(ran):
    before, after = texts(ran[2]), texts(ran[3])
    name, _ = brute(before, 5)
    assert set(after) == {i for i in before if name[i] == i} and ran[3].columns == ran[0].columns


def test_secrets_stage(ran):
    before, after = texts(ran[3]), texts(ran[4])
    assert ran[4].columns == ran[0].columns and set(after) == set(before)
    for i, t in before.items():
        assert after[i] == secrets.redact_text(t)
        assert after[i] == t or secrets.scan(t)[1]


def test_packing_stage(ran):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids + [0] for i, t in texts(ran[4]).items()}
    got = ran[5].collect()
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    for r in got:
        assert r.ids_crc32 == packing.ids_crc32(np.array(ids[r.doc_id][r.start:r.start + r.length]))
    used = {}
    for r in got:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 2048 and len(used) <= -(-sum(used.values()) // 2048) + 3


def test_run(spark, sf, ran):
    key = lambda df: sorted((r.doc_id, r.piece, r.ids_crc32, r.length) for r in df.collect())
    assert key(C.run(spark, sf)) == key(ran[5])


def test_empty_documents(spark, sf, docs):
    out = docs(["a"]).limit(0)
    for _, stage in C.STAGES:
        out = stage(spark, out, sf)
    assert out.count() == 0


def test_awkward_rows_go_through_all_stages(spark, sf, tmp_path):
    """Nulls in any column, empty and very long texts, ties, rows repeated as a whole and extra
    columns with the operators' own names, beside the table's rows."""
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = docs.orderBy("doc_id").first()
    odd = [(None, None, None, None, None), (900001, None, None, "s", None), (900002, "", "en", None, 0), (None, "", "en", "s", 0),
           (900003, good.text + "\n" + "ordinary words of a long text " * 40_000, "en", "s", None), (900004, good.text.upper(), "en", "s", 1),
           (900004, good.text.upper(), "en", "s", 1), (900005, good.text, None, None, None)]
    extra = {"kept": F.lit("x"), "digest": F.lit(1), "component_id": F.lit(None).cast("string"), "quality_score": F.lit("y"), "pack_row": F.lit(2),
             "drop_id": F.lit(3), "length": F.lit("z"), "a b.c": F.lit(4)}
    table = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns(extra)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    from docpairs.llm.common import written
    steps = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for _, stage in C.STAGES:
        steps.append(written(stage(spark, steps[-1], str(tmp_path)), "test-stage"))
    assert all(s.columns == table.columns for s in steps[:5])
    rows = [[(r.doc_id, lower(r.text or "")) for r in s.select("doc_id", "text").collect()] for s in steps[:5]]
    for text in {t for _, t in rows[1]}:
        ids = [i for i, t in rows[1] if t == text]
        assert [i for i, t in rows[2] if t == text] == [max(ids, key=lambda i: -1 if i is None else i)]
    assert set(rows[3]) <= set(rows[2]) and len(rows[4]) == len(rows[3])
    packed = steps[5].collect()
    assert {r.doc_id for r in packed} == {i for i, _ in rows[4]} and len({(r.doc_id, r.piece) for r in packed}) == len(packed)


def test_workers_hold_little_text(spark, sf, docs):
    """Batches of texts and the packing workers' word forms are bounded; a smaller bound of the
    session stays."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    try:
        for held, kept in (("10000", "1000"), ("0", "1000"), ("50", "50")):
            spark.conf.set(conf, held)
            C.packed(spark, docs(["a"]), sf)
            assert spark.conf.get(conf) == kept
    finally:
        spark.conf.set(conf, before)
    encoder = packing.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), 3)
    one, two = "some words of a text", "other forms that it meets"
    assert [encoder.encode(t) for t in (one, two, two)] == [packing.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json")).encode(t) for t in (one, two, two)]
    assert len(encoder.forms) == 5 and C.CACHED_FORMS < packing.CACHED_FORMS
