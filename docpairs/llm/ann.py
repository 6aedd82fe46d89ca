"""Approximate nearest neighbours by learned partitions.

The index is fitted on a sample of at most ``SAMPLE`` distinct vectors: their neighbour
graph is cut into balanced parts (recursive spectral bisection, all groups of a level at
once, then moves that gain edges while sizes stay within 5 %), and a small network with
one hidden layer learns which parts hold a vector's neighbours. It then gives every
vector of the table its part, and a query goes to its most probable parts, as many as
together have the probability at which the sample's held-out vectors (every fifth, not
used in training) find ``RECALL`` of their nearest. What a query meets there is ranked by
the exact cosine in double precision on the original vectors.

Everything but the fit covers all rows. The tasks search blocks: a part is cut into
pieces of ``PIECE`` vectors, and the queries of a part into pieces of ``QUERIES``, so a
part that holds a third of all rows is many blocks. Equal vectors are one class: a class
is searched once, however many rows or queries it has, and stands for its ``top + 1``
smallest ids, since no other of its rows can be among the ``top`` nearest of any query.
Those ids are picked by a window whose limit is applied in the tasks before the shuffle.

The number of parts follows from the number of classes, a quarter of its root, up to
``MOST_PARTS``, which the sample can still tell apart.

Cases: vectors that are null, zero, hold null or non-finite components, or whose length
is not the table's most frequent one (ties: the smallest) take no part, nor do rows with
a null vec_id; copies of a row are one row; rows that share an id but not the vector are
rows of their own, and a query leaves out only itself; with fewer candidates than ``top``
all are returned; an empty table gives no rows; extra columns take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, written

TOP, EVERY = 5, 50
SAMPLE, NEIGHBOURS, MOST_PARTS = 16384, 10, 256
HIDDEN, EPOCHS, RATE = 128, 30, 2e-3
RECALL = 0.96
PIECE, QUERIES = 8192, 2048


# ------------------------------------------------------------------ the graph and its parts
def nearest(base: np.ndarray, who: np.ndarray, k: int) -> np.ndarray:
    """For the rows ``who`` of ``base`` (unit vectors) their ``k`` nearest other rows."""
    out = np.empty((len(who), k), np.int32)
    for at in range(0, len(who), 256):
        some = who[at:at + 256]
        scores = base[some] @ base.T
        scores[np.arange(len(some)), some] = -np.inf
        best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(scores, best, 1), axis=1, kind="stable")
        out[at:at + 256] = np.take_along_axis(best, order, 1)
    return out


def bisected(graph: np.ndarray, levels: int) -> np.ndarray:
    """Groups 0 .. 2^levels - 1 of about equal size: each level cuts every group at the
    median of the second eigenvector of its own part of the graph."""
    n, k = graph.shape
    a, b = np.repeat(np.arange(n), k), graph.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    group = np.zeros(n, np.int64)
    for level in range(levels):
        inside = group[a] == group[b]
        u, v = a[inside], b[inside]
        degree = np.maximum(np.bincount(u, minlength=n), 1)
        mass = np.bincount(group, weights=degree, minlength=1 << level)
        x = np.random.default_rng(level).standard_normal(n)
        for _ in range(60):
            x -= (np.bincount(group, weights=x * degree, minlength=1 << level) / np.maximum(mass, 1))[group]
            x = 0.5 * x + 0.5 * np.bincount(u, weights=x[v], minlength=n) / degree
            norm = np.sqrt(np.bincount(group, weights=x * x, minlength=1 << level))
            x /= np.maximum(norm, 1e-30)[group]
        order = np.lexsort((x, group))
        size = np.bincount(group, minlength=1 << level)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        group = 2 * group + (place >= (size[group] + 1) // 2)
    return group


def balanced_parts(graph: np.ndarray, parts: int, slack: float = 0.05, rounds: int = 10) -> np.ndarray:
    """The part of each node; few edges leave a part, sizes differ by ``slack`` at most."""
    n, k = graph.shape
    part = bisected(graph, max(parts.bit_length() - 1, 0))
    size = np.bincount(part, minlength=parts)
    most, least = int(np.ceil(n / parts * (1 + slack))), int(n / parts * (1 - slack))
    for _ in range(rounds if parts > 1 else 0):
        edges = np.zeros((n, parts), np.int32)
        np.add.at(edges, (np.repeat(np.arange(n), k), part[graph.ravel()]), 1)
        np.add.at(edges, (graph.ravel(), np.repeat(part, k)), 1)
        gain = edges.max(axis=1) - edges[np.arange(n), part]
        to, moved = edges.argmax(axis=1), 0
        for i in np.argsort(-gain, kind="stable")[:int((gain > 0).sum())]:
            if size[to[i]] < most and size[part[i]] > least:
                size[to[i]] += 1
                size[part[i]] -= 1
                part[i] = to[i]
                moved += 1
        if not moved:
            break
    return part


# ------------------------------------------------------------------ the classifier
def trained(x: np.ndarray, goal: np.ndarray, seed: int = 7) -> list[np.ndarray]:
    """Weights of a network with one hidden layer whose softmax follows ``goal`` (a
    distribution over the parts for each row of ``x``); Adam on the cross entropy."""
    rng = np.random.default_rng(seed)
    d, p = x.shape[1], goal.shape[1]
    w = [rng.standard_normal((d, HIDDEN)) * np.sqrt(2 / d), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, p)) * np.sqrt(1 / HIDDEN), np.zeros(p)]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            rows = order[at:at + 256]
            hidden, out = forward(w, x[rows])
            error = (out - goal[rows]) / len(rows)
            back = (error @ w[2].T) * (hidden > 0)
            step += 1
            for i, g in enumerate((x[rows].T @ back, back.sum(0), hidden.T @ error, error.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] -= RATE * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    return w


def forward(w: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hidden layer and the parts' probabilities."""
    hidden = np.maximum(x @ (w[0] * np.sqrt(x.shape[1])) + w[1], 0)
    score = hidden @ w[2] + w[3]
    score = np.exp(score - score.max(axis=1, keepdims=True))
    return hidden, score / score.sum(axis=1, keepdims=True)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


class Router:
    """The fitted classifier: the part of a vector, and the parts a query looks in."""

    def __init__(self, weights: list[np.ndarray] | None, mass: float):
        self.weights, self.mass = weights, mass

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.ones((len(vectors), 1))
        return forward(self.weights, unit(vectors))[1]

    def part(self, vectors: np.ndarray) -> np.ndarray:
        return self.probabilities(vectors).argmax(axis=1)

    def looks(self, vectors: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
        """Which parts each query looks in: the most probable ones until they have ``mass``
        of the probability and ``least`` vectors."""
        p = self.probabilities(vectors)
        order = np.argsort(-p, axis=1, kind="stable")
        sorted_p = np.take_along_axis(p, order, 1)
        before = np.cumsum(sorted_p, axis=1) - sorted_p
        held = sizes[order]
        use = (before < self.mass) | (np.cumsum(held, axis=1) - held < least)
        out = np.zeros(p.shape, bool)
        np.put_along_axis(out, order, use, 1)
        return out


def fitted(sample: np.ndarray, graph: np.ndarray, parts: int, recall: float = RECALL, top: int = TOP) -> Router:
    """The router of a sample (unit vectors) and its neighbour graph."""
    n = len(sample)
    if parts < 2 or n <= 2 * parts:
        return Router(None, 1.0)
    part = balanced_parts(graph, parts)
    goal = np.zeros((n, parts))
    np.add.at(goal, (np.repeat(np.arange(n), graph.shape[1]), part[graph.ravel()]), 1.0)
    goal[np.arange(n), part] += 1.0
    goal /= goal.sum(axis=1, keepdims=True)
    held_out = np.arange(n) % 5 == 0
    router = Router(trained(sample[~held_out], goal[~held_out]), 1.0)
    # The probability that stands before a neighbour's part is what has to be looked through.
    p = router.probabilities(sample)
    own = p.argmax(axis=1)
    want = own[graph[held_out][:, :top]]
    mine = p[held_out]
    mine_sorted = -np.sort(-mine, axis=1)
    rank = np.argsort(np.argsort(-mine, axis=1, kind="stable"), axis=1, kind="stable")
    before = np.cumsum(mine_sorted, axis=1) - mine_sorted
    needed = np.take_along_axis(before, np.take_along_axis(rank, want, 1), 1)
    router.mass = float(np.quantile(needed, recall)) + 1e-9
    return router


def parts_for(classes: int, sampled: int) -> int:
    """A power of two near a quarter of the root of ``classes``."""
    wanted = max(np.sqrt(max(classes, 1)) / 4, 1.0)
    return int(min(2 ** round(np.log2(wanted)), MOST_PARTS, 2 ** int(np.log2(max(sampled / 64, 1)))))


# ------------------------------------------------------------------ on Spark
def stacked(column) -> np.ndarray:
    """A matrix of an Arrow column of lists of equal length."""
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, vector`` of the distinct rows that take part."""
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{vector_col}`").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(fine & F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    size = sizes["size"] if sizes else 0
    return rows.where(F.size("vector") == size).groupBy("vec_id", "vector").agg(F.lit(1).alias("one")).drop("one")


def classes_of(rows: DataFrame, top: int) -> DataFrame:
    """``class, vector, ids``: the distinct vectors with their ``top + 1`` smallest ids."""
    order = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top + 1)
    grouped = few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return grouped.select(F.monotonically_increasing_id().alias("class"), "vector", "ids")


def fit(classes: DataFrame, number: int, sample: int = SAMPLE, recall: float = RECALL, top: int = TOP) -> Router:
    """Fit a router on at most ``sample`` classes, picked by the hash of the vector."""
    spark = classes.sparkSession
    share = min(1.0, sample / max(number, 1))
    picked = classes.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vector").limit(sample)
    vectors = stacked(picked.toArrow().column("vector").combine_chunks())
    order = np.lexsort(vectors.T)
    vectors = vectors[order]
    n = len(vectors)
    k = min(NEIGHBOURS, n - 1)
    parts = parts_for(number, n)
    if k < TOP or parts < 2:
        return Router(None, 1.0)
    base = unit(vectors)
    shipped = spark.sparkContext.broadcast(base.astype(np.float32))   # at most ``sample`` rows

    def run(batches):
        for batch in batches:
            who = np.concatenate([np.arange(s, min(s + 256, n)) for s in batch.column(0).to_pylist()] or [np.zeros(0, np.int64)])
            near = nearest(shipped.value, who, k)
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(list(near), pa.list_(pa.int32()))], ["node", "near"])

    starts = spark.range(0, n, 256, numPartitions=-(-n // 1024))
    graph = starts.mapInArrow(run, "node bigint, near array<int>").toArrow().sort_by("node")
    return fitted(base, stacked(graph.column("near").combine_chunks()).astype(np.int64), parts, recall, top)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of ``a`` with the same row of ``b``; a pair's value does not
    depend on what else is in the block."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def block_best(queries: np.ndarray, vectors: np.ndarray, first_id: np.ndarray, top: int):
    """``(query, vector, cosine)`` of each query's ``top`` nearest vectors of a block, ties
    by ``first_id``. Found by a product of unit vectors, ranked by exact cosines."""
    out, unit_v, k = [], unit(vectors), min(top, len(vectors))
    for at in range(0, len(queries), 256):
        some = queries[at:at + 256]
        scores = unit(some) @ unit_v.T
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        q, v = np.nonzero(scores >= least[:, None] - 1e-9)
        exact = cosines(some[q], vectors[v])
        order = np.lexsort((first_id[v], -exact, q))
        q, v, exact = q[order], v[order], exact[order]
        n = np.bincount(q, minlength=len(some))
        keep = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) < top
        out.append((q[keep] + at, v[keep], exact[keep]))
    return [np.concatenate(x) for x in zip(*out)]


def search(df: DataFrame, is_query, top: int = TOP, sample: int = SAMPLE, recall: float = RECALL, piece: int = PIECE,
           queries: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows where ``is_query(vec_id)`` holds."""
    spark = df.sparkSession
    rows = written(usable(df), "vectors")
    classes = written(classes_of(rows, top), "classes")
    asked = written(rows.where(is_query(F.col("vec_id"))).join(classes, "vector").select(F.col("vec_id").alias("query_id"), "class"), "queries")
    router = spark.sparkContext.broadcast(fit(classes, classes.count(), sample, recall, top))

    def place(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(router.value.part(stacked(batch.column("vector"))), pa.int32())],
                                             ["class", "vector", "ids", "part"])

    vector = classes.schema["vector"].dataType.simpleString()
    index = written(classes.mapInArrow(place, f"class bigint, vector {vector}, ids array<bigint>, part int"), "index")
    held = {r["part"]: r["n"] for r in index.groupBy("part").agg(F.sum(F.size("ids")).alias("n")).collect()}   # MOST_PARTS rows
    sizes = np.array([held.get(p, 0) for p in range(max(held, default=0) + 1)], np.int64)
    if router.value.weights is not None:
        sizes = np.resize(np.concatenate([sizes, np.zeros(MOST_PARTS, np.int64)]), len(router.value.weights[3]))

    def look(batches):
        for batch in batches:
            q, p = np.nonzero(router.value.looks(stacked(batch.column("vector")), sizes, top + 1)) if batch.num_rows else (np.zeros(0, int),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), batch.column("class").take(pa.array(q)), batch.column("vector").take(pa.array(q))],
                                             ["part", "asked", "vector"])

    wanted = classes.join(asked.select("class").distinct(), "class").select("class", "vector")
    looks = written(wanted.mapInArrow(look, f"part int, asked bigint, vector {vector}"), "looks")
    cuts = (index.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias("pieces"))
            .join(looks.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / queries).cast("int").alias("turns")), "part"))

    def dealt(frame, key, own, other):
        """Rows with their own number within the part, copied to each number of the other side."""
        number = F.pmod(F.xxhash64(key), F.col(own)).cast("int").alias(own)
        return frame.join(F.broadcast(cuts), "part").select(   # at most MOST_PARTS rows
            *frame.columns, number, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other))

    keys = ["part", "pieces", "turns"]
    blocks = dealt(index, "class", "pieces", "turns").groupBy(*keys).cogroup(dealt(looks, "asked", "turns", "pieces").groupBy(*keys))

    def best(held: pa.Table, sought: pa.Table) -> pa.Table:
        if not held.num_rows or not sought.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(("asked", "class", "ids", "score"), (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64()))})
        held, sought = held.combine_chunks(), sought.combine_chunks()
        ids = held.column("ids").combine_chunks()
        first = np.array([x[0] for x in ids.to_pylist()], np.int64)
        q, v, score = block_best(stacked(sought.column("vector").combine_chunks()), stacked(held.column("vector").combine_chunks()), first, top + 1)
        return pa.table({"asked": sought.column("asked").take(pa.array(q)), "class": held.column("class").take(pa.array(v)),
                         "ids": ids.take(pa.array(v)), "score": pa.array(score, pa.float64())})

    found = written(blocks.applyInArrow(best, "asked bigint, class bigint, ids array<bigint>, score double"), "found")
    each = found.select("asked", "class", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id", "class")
    ranked = each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top + 1)
    lists = ranked.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "class", "score"))).alias("near"))
    met = asked.join(lists, F.col("class") == F.col("asked"))
    others = F.slice(F.filter("near", lambda x: ~((x["vec_id"] == F.col("query_id")) & (x["class"] == F.col("asked")))), 1, top)
    return met.select("query_id", F.posexplode_outer(others).alias("at", "x")).where("x IS NOT NULL").select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op12_learned_partitions(spark, sf_dir):
    return search(read(spark, sf_dir, "embeddings"), lambda i: i % EVERY == 0)
