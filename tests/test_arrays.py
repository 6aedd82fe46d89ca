"""JSON arrays and lines read by many tasks: whole objects, their places, broken files."""

import json
import random

import pytest
from docpairs.operators import metrics as M
from docpairs.sources import arrays, places

NASTY = ['plain', 'quote " inside', 'brace } and { and [ ]', 'back\\slash \\" end\\\\', 'line\nbreak\ttab', 'größe 日本語 🎉 \u2028', '', '}', '"', '\\', '{"a": [1, "}"]}',
         'def f():\n    return {"k": [1, 2, "\\"]"]}\n', None]
SCHEMA = "id long, code string, nested struct<a:array<string>,b:struct<c:string>>"


@pytest.fixture
def split_bytes(spark):
    """Sets how many bytes of a file a task reads at most."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {k: spark.conf.get(k, None) for k in keys}

    def use(n):
        for k, v in zip(keys, (n, 1, 1)):
            spark.conf.set(k, str(v))
    yield use
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def items(n, seed=1):
    rnd = random.Random(seed)
    return [{"id": i, "code": "".join(rnd.choice(NASTY) or "" for _ in range(rnd.randint(0, 4))) if i % 7 else rnd.choice(NASTY),
             "nested": {"a": [rnd.choice(NASTY) for _ in range(rnd.randint(0, 3))], "b": {"c": rnd.choice(NASTY)}}} for i in range(n)]


def rows(df):
    return [(r.place, r.id, r.code, r.nested.asDict(True)) for r in df.orderBy("place").collect()]


@pytest.mark.parametrize("style, size", [(dict(indent=2, ensure_ascii=False), 211), (dict(), 97), (dict(indent=1, separators=(",", ":")), 1 << 20)])
def test_one_array_file_read_by_many_tasks(spark, split_bytes, tmp_path, style, size):
    data = items(16)
    path = tmp_path / "a.json"
    path.write_text(json.dumps(data, **style) + "\n", encoding="utf-8")
    split_bytes(size)
    tasks = arrays._pieces(spark, str(path)).rdd.getNumPartitions()
    assert tasks > 4 if size < 1000 else tasks <= 2
    got = rows(arrays.read_json_array(spark, str(path), SCHEMA))
    assert got == [(i, d["id"], d["code"], d["nested"]) for i, d in enumerate(data)]
    assert [r.whole for r in arrays.file_states(arrays.split_states(spark, str(path))).collect()] == [True]


def test_object_over_many_splits(spark, split_bytes, tmp_path):
    data = [{"id": 0, "code": "a", "nested": None}, {"id": 1, "code": "} \" [" * 400, "nested": None}, {"id": 2, "code": "b", "nested": None}]
    path = tmp_path / "a.json"
    path.write_text(json.dumps(data), encoding="utf-8")
    split_bytes(150)
    got = arrays.read_json_array(spark, str(path), SCHEMA).orderBy("place").collect()
    assert [(r.place, r.id, r.code) for r in got] == [(i, d["id"], d["code"]) for i, d in enumerate(data)]


SMALL = {"[]": [], " [ ]\n": [], '[{"id": 1}]': [1], '[{"id": 1}, 5, "x", null, ["y", {"id": 9}], {"id": 2}]': [1, 2]}
CUT = {'[{"id": 1}, {"id": 2': [1], '[{"id": 1}, {"id": 2, "code": "abc': [1], '[{"id": 1}': [1], '[{"id": 1}, {"id"': [1], '[{"id": 1},\n': [1],
       '{"id": 3}': [], '[{"id": 1, "x": [{"id"': []}


@pytest.mark.parametrize("size", [13, 1 << 20])
def test_small_and_broken_files(spark, split_bytes, tmp_path, size):
    """A file that is cut off is told, and gives its whole objects only."""
    texts = {**SMALL, **CUT}
    for i, text in enumerate(texts):
        (tmp_path / f"{i:02d}.json").write_text(text)
    split_bytes(size)
    states = arrays.split_states(spark, str(tmp_path))
    assert [r.whole for r in arrays.file_states(states).orderBy("file").collect()] == [t in SMALL for t in texts]
    got = {}
    for r in arrays.read_json_array(spark, str(tmp_path), "id long").orderBy("place").collect():
        got.setdefault(r.file[-7:-5], []).append((r.place_in_file, r.id))
    assert got == {f"{i:02d}": list(enumerate(ids)) for i, ids in enumerate(texts.values()) if ids}


def test_written_arrays_are_json_in_row_order(spark, tmp_path):
    data = items(300, 4)
    df = spark.createDataFrame([(d["id"], d["code"]) for d in data], "id long, code string").repartitionByRange(5, "id").sortWithinPartitions("id")
    arrays.save_json_array(df, str(tmp_path / "out"))
    files = sorted(p for p in (tmp_path / "out").iterdir() if p.suffix == ".txt")
    assert len(files) == 5
    assert [x for f in files for x in json.loads(f.read_text(encoding="utf-8"))] == [{"id": d["id"], "code": d["code"]} for d in data]
    back = arrays.read_json_array(spark, str(tmp_path / "out"), "id long, code string").orderBy("place").collect()
    assert [(r.place, r.id, r.code) for r in back] == [(i, d["id"], d["code"]) for i, d in enumerate(data)]


def test_lines_of_files_of_different_splits_align(spark, split_bytes, tmp_path):
    a = [f"line {i} " + "x" * (i % 90) if i % 13 else "" for i in range(160)]
    b = [f"zeile {i} größe" * (i % 5) for i in range(172)]
    for name, lines in (("a", a), ("b", b)):
        (tmp_path / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    split_bytes(300)
    left = places.read_lines(spark, str(tmp_path / "a"))
    split_bytes(1500)
    right = places.read_lines(spark, str(tmp_path / "b"))
    assert left.select("split_start").distinct().count() > 15 > right.select("split_start").distinct().count() > 1
    got = M.align_by_place(left.withColumnRenamed("value", "reference"), right.withColumnRenamed("value", "prediction"))
    rows = got.orderBy("place").collect()
    assert [(r.place, r.reference, r.prediction) for r in rows if r.status == "matched"] == [(i, x, y) for i, (x, y) in enumerate(zip(a, b))]
    assert [(r.place, r.reference, r.prediction) for r in rows if r.status == "missing_reference"] == [(i, None, b[i]) for i in range(160, 172)]


def test_effects_compose():
    text = json.dumps(items(20, 9), ensure_ascii=False) + "}"
    rnd = random.Random(2)
    cuts = sorted(rnd.sample([i + 1 for i, c in enumerate(text) if c == "}"], 30))
    state = (False, 0, 0)
    for i, j in zip([0, *cuts], [*cuts, len(text)]):
        if i < j:
            state = arrays.then(state, {s: arrays.effect(text[i:j], s) for s in (False, True)})
    assert state == arrays.effect(text, False) == (False, -1, -1)
