import hashlib

import pytest

from docpairs.llm import exact_dedup as X


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


TEXTS = ["Same text", "same TEXT", None, "", "É", "é", "other", "same text", "long " * 20000]


@pytest.mark.parametrize("broadcast_bytes", [X.BROADCAST_BYTES, 0])
def test_report_against_brute_force(docs, broadcast_bytes):
    got = {r.doc_id: r for r in X.dedup_report(docs(TEXTS), broadcast_bytes=broadcast_bytes).collect()}
    for i, t in enumerate(TEXTS, 1):
        same = [j for j, u in enumerate(TEXTS, 1) if lower(u) == lower(t)]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), i == max(same))
        assert r.text_sha256 == hashlib.sha256(lower(t).encode()).hexdigest()


def test_few_bits_change_nothing(docs):
    texts = [f"t{i % 40}" for i in range(300)]
    a = X.dedup_report(docs(texts)).orderBy("doc_id").collect()
    assert a == X.dedup_report(docs(texts), bits_per_row=1).orderBy("doc_id").collect()
    assert sum(r.kept for r in a) == 40


def test_dedup_keeps_columns_and_one_row_of_repeated_rows(docs):
    src = docs(["a", "A", "b", "b"], [1, None, 3, 3])
    out = X.dedup(src)
    assert out.columns == src.columns and out.schema["kept"].dataType == src.schema["kept"].dataType
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "a"), (3, "b")]


def test_null_ids_and_empty_table(docs):
    assert [r.kept for r in X.dedup_report(docs(["a", "a"], [None, None])).collect()].count(True) == 1
    assert X.dedup_report(docs(["a"]).limit(0)).count() == 0 and X.dedup(docs(["a"]).limit(0)).count() == 0


def test_hot_group(docs):
    texts = ["hot"] * 700 + [f"t{i}" for i in range(1300)]
    got = X.dedup_report(docs(texts)).collect()
    assert {r.keep_id for r in got if r.group_size == 700} == {700} and sum(r.kept for r in got) == 1301


def test_no_python_on_the_main_path(docs):
    plan = X.dedup(docs(["a"]))._jdf.queryExecution().toString() + X.dedup_report(docs(["a"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
