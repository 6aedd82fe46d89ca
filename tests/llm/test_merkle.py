import random
from hashlib import sha256
from zlib import crc32

from docpairs.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, pos int, leaf string, total long"


def h(*x):
    return sha256("".join(x).encode()).hexdigest()


def leaf(r):
    return h(*["-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in merkle.FIELDS])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        s = i - i % 3
        out.append((i % 3, level[s:i] + level[i + 1:s + 3]))
        i //= 3
    return out


def brute_force(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in by[s]])
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            steps = path(trees[s], i) + path(top, k)
            touched = r["doc_id"] is not None and r["text"] is not None and crc32(str(r["doc_id"]).encode()) % 2 == 0
            node = leaf({**r, "text": r["text"].replace("\n", "")} if touched else r)
            for at, others in steps:
                node = h(*others[:at], node, *others[at:])
            out.append((r["doc_id"], leaf(r), trees[s][-1][0], top[-1][0], h(*[x for _, o in steps for x in o]), node, node == top[-1][0]))
    return out


def same(df, rows):
    key = lambda t: tuple((x is not None, x) for x in t)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(brute_force(rows), key=key)


def as_dicts(data):
    return [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), d)) for d in data]


def test_nulls_repeated_rows_extreme_ids_and_clashing_columns(spark):
    pick = random.Random(3).choice
    ids = [None, 5, -7, 2**62, -2**63, 2**63 - 1, *range(200)]
    data = [(pick(ids), pick([None, "", "a\nb", "xy"]), pick(["en", None]), pick([None, "", "s", "é", "z"]), pick([None, 3]), "q", 1, "l", 2) for _ in range(1200)]
    same(merkle.manifest(spark.createDataFrame(data, SCHEMA).repartition(5)), as_dicts(data))


def test_hot_source_of_several_passes(spark):
    data = [(i * 3, "t\n" * (i % 3), "en", "big", 1, "q", 1, "l", 2) for i in range(1500)]
    data += [(i, "t", "en", f"s{i}", 1, "q", 1, "l", 2) for i in range(300)]
    same(merkle.manifest(spark.createDataFrame(data, SCHEMA)), as_dicts(data))


def test_empty_table_and_lone_leaf(spark):
    one = [(4, "a" * 200_000, "en", "s", 1, "q", 1, "l", 2)]
    df = spark.createDataFrame(one, SCHEMA)
    assert merkle.manifest(df.limit(0)).count() == 0
    (row,) = merkle.manifest(df).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == h() and row.verified


def test_places_are_ranks_and_leaves_are_not_sorted(spark):
    ids = random.Random(1).sample(range(-10**12, 10**12), 3000)
    rows = spark.createDataFrame([("=a" if i % 3 else "=b", d, "x", None) for i, d in enumerate(ids)], "g string, doc_id long, leaf string, other string")
    placed = merkle.placed(rows)
    got = {(r.g, r.doc_id): (r.pos, r.total) for r in placed.collect()}
    for g in ("=a", "=b"):
        mine = sorted(d for (k, d) in got if k == g)
        assert [got[g, d] for d in mine] == [(i, len(mine)) for i in range(len(mine))]
    assert "rangepartitioning" not in placed._jdf.queryExecution().executedPlan().toString()


def test_query_equals_brute_force(spark, sf):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    same(merkle.op13_merkle_manifest(spark, sf), rows)
