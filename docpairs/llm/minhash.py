"""Near-duplicate detection by min-max hashing.

A document's set holds its distinct shingles of ``shingle`` words (with fewer words, the
whole sequence as one); without words it is empty and linked with nothing. Under each
permutation of the shingle hashes both the minimum and the maximum are kept, so ``k``
evaluations give ``2 k`` signature values; each agrees between two sets with probability
equal to their similarity. ``rows`` values make a band, and documents that agree in a
band are candidates. With 6 rows and 36 bands (108 permutations) a pair at similarity 0.8
is missed with probability 2e-5.

Documents with equal sets are one class and only its smallest id takes part further, so
copies cost one row each. Candidates are confirmed on the full sets, and components
follow from the confirmed links. Not every pair of a band is tested, only what the
components need: the first round compares a bucket's first member with all others. The
last round compares the outsiders of a bucket, its members outside its largest component
by then, with all its members of other components; a bucket whose members share a
component drops out. So a group of thousands of near copies costs a test per member and
band at most, and yet no two documents of a bucket stay apart untested. Only while a
bucket has more than ``PIECE`` outsiders, up to three rounds between them compare some of
the outsiders (eight, 64, 512) with the rest, so that fewer are left. A round costs many
small jobs, whatever it compares, so their number is bounded.

The first round confirms its pairs on the full sets and keeps what sets a member apart
from its bucket's first member. From the second round on, two members of a bucket are
compared by these differences: with c and d shingles in common with a first member of n,
and s shingles that both differences share, they have exactly c + d - n + s shingles in
common. Outsiders and members of a bucket meet in pieces of ``PIECE`` rows, sorted one
behind the other in a task, and only a spanning forest of the links becomes rows; a large
group of texts that are alike but not alike enough yields none.

Everything data-sized stays in tables under ``spark.checkpoint.dir``; the driver sees
counts only.

Cases: null and empty texts have an empty set and form their own components; rows that
share a ``doc_id`` are one document (their sets must be equal; the report has each row);
rows with a null id are reported as their own component, with a null ``component_id``;
extra columns are kept by ``drop_near_copies``; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_by, read, text_or_empty, written
from .wordhash import mix, slices, text_bytes, words

ROWS, BANDS = 6, 36
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Outsiders of a bucket that a round between the first and the last one compares with the
#: others: at first, their growth from round to round, and at most.
SOME, GROWTH, MOST = 8, 8, 512
#: Members of a bucket that one task compares with each other, and the shingles of their
#: differences, which a task holds (on average: rows are dealt by hash).
PIECE, SHINGLES = 2048, 1 << 20
#: From this similarity (in percent) to a bucket's first member on, the difference is kept:
#: for every pair, so that no pair of later rounds has to become a row to be told.
NEAR = 0
#: Differences of more shingles are held as sorted arrays, 8 bytes each, not as sets.
LONG = 2048


# ------------------------------------------------------------------ sets and signatures
def shingle_sets(column, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """``(values, counts)``: the sorted distinct shingle hashes of each text, end to end."""
    data, offsets = text_bytes(column)
    text, hashes = words(data, offsets)
    n = np.bincount(text, minlength=len(column))
    first = np.cumsum(n) - n
    size = np.minimum(n, shingle)                       # words in a text's shingles
    count = np.where(n > 0, n - size + 1, 0)            # shingles before they are made distinct
    owner = np.repeat(np.arange(len(column)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]
    value = np.zeros(len(owner), np.uint64)
    for k in range(shingle):
        inside = size[owner] > k
        value[inside] = mix(value[inside] * np.uint64(0x9E3779B97F4A7C15) + hashes[at[inside] + k])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    owner, value = owner[new], value[new]
    return value, np.bincount(owner, minlength=len(column))


def min_max_signature(values: np.ndarray, counts: np.ndarray, permutations: int) -> np.ndarray:
    """``(sets, 2 * permutations)``: minimum and maximum of each non-empty set under each
    permutation; rows of empty sets are left out."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    out = np.empty((len(starts), 2 * permutations), np.uint64)
    if len(starts):
        seeds = mix(np.arange(1, permutations + 1, dtype=np.uint64))
        for k in range(permutations):
            permuted = (values ^ seeds[k]) * (seeds[k] | np.uint64(1))
            permuted ^= permuted >> np.uint64(29)
            permuted *= np.uint64(0xBF58476D1CE4E5B9)
            out[:, 2 * k] = np.minimum.reduceat(permuted, starts)
            out[:, 2 * k + 1] = np.maximum.reduceat(permuted, starts)
    return out


def band_keys(signature: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit key per set and band; the band's number is part of the key."""
    out = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(signature), mix(np.array([b + 1], np.uint64))[0])
        for r in range(rows):
            key = mix(key ^ signature[:, (b * rows + r) % signature.shape[1]])
        out[:, b] = key
    return out


def sketches(docs: DataFrame, shingle: int, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """``doc_id, n_shingles, set_hash, bands`` of every whole text; ``set_hash`` (two
    64-bit sums) and ``bands`` are null for an empty set."""
    permutations = -(-rows * bands // 2)

    def run(batches):
        held_by("minhash")
        for batch in batches:
            for at, part in slices(batch.column(1), 4 << 20):
                values, counts = shingle_sets(part, shingle)
                some = counts > 0
                starts = (np.cumsum(counts) - counts)[some]
                keys = band_keys(min_max_signature(values, counts, permutations), rows, bands)
                sums = [np.zeros(len(part), np.uint64) for _ in range(2)]
                for k, s in enumerate(sums):
                    if len(starts):
                        s[some] = np.add.reduceat(mix(values + np.uint64(k + 1)), starts) + counts[some].astype(np.uint64)
                empty = pa.array(~some)
                lists = pa.array(np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array(counts.astype(np.int64)),
                     *[pa.array(s.view(np.int64), mask=np.asarray(~some)) for s in sums],
                     pa.ListArray.from_arrays(lists, pa.array(keys.ravel().view(np.int64)), mask=empty)],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands"])
    return _source(docs).mapInArrow(run, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>")


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, shingles``: the full set of every whole text."""
    def run(batches):
        held_by("minhash")
        for batch in batches:
            for at, part in slices(batch.column(1), 4 << 20):
                values, counts = shingle_sets(part, shingle)
                lists = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.ListArray.from_arrays(lists, pa.array(values.view(np.int64)))],
                    ["doc_id", "shingles"])
    return _source(docs).mapInArrow(run, "doc_id bigint, shingles array<bigint>")


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text"))


# ------------------------------------------------------------------ links and components
def compared(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``(a, b)`` that are near each other, with ``na`` and ``nb`` (set sizes),
    ``common``, ``linked``, and ``apart``: the shingles in one of both sets only."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    sized = pairs.join(left, "a").join(right, "b").withColumns({
        "na": F.size("set_a"), "nb": F.size("set_b"), "common": F.size(F.array_intersect("set_a", "set_b"))})
    together = F.col("na") + F.col("nb") - F.col("common")
    apart = F.concat(F.array_except("set_a", "set_b"), F.array_except("set_b", "set_a"))
    return sized.where(100 * F.col("common") >= min(NEAR, percent) * together).select(
        "a", "b", "na", "nb", "common", (100 * F.col("common") >= percent * together).alias("linked"), apart.alias("apart"))


def merge_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``(id, component)`` after joining the components that ``links`` connect; a
    component is named by its smallest id. Works on the graph of components: each takes
    the smallest neighbour, then pointers are halved, until nothing changes."""
    at = labels.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    to = labels.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    edges = links.join(at, "a").join(to, "b").where("ca <> cb").select(
        F.least("ca", "cb").alias("u"), F.greatest("ca", "cb").alias("v")).distinct()
    edges = written(edges, "edges")
    if not edges.limit(1).count():
        return labels
    roots = written(edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct()
                    .withColumn("root", F.col("id")), "roots")
    while True:
        # Every root takes the smallest root next to it ...
        named = (edges.join(roots.select(F.col("id").alias("u"), F.col("root").alias("ru")), "u")
                 .join(roots.select(F.col("id").alias("v"), F.col("root").alias("rv")), "v").where("ru <> rv"))
        smaller = (named.select(F.greatest("ru", "rv").alias("root"), F.least("ru", "rv").alias("next"))
                   .groupBy("root").agg(F.min("next").alias("next")))
        smaller = written(smaller, "hooks")
        if not smaller.limit(1).count():
            break
        # ... and what it took may itself have moved: follow twice before the next round.
        hop = smaller.select(F.col("root").alias("next"), F.col("next").alias("next2"))
        hops = smaller.join(hop, "next", "left").select("root", F.coalesce("next2", "next").alias("next"))
        roots = written(roots.join(hops, "root", "left").select("id", F.coalesce("next", "root").alias("root")), "roots")
    moved = roots.select(F.col("id").alias("component"), "root")
    return written(labels.join(moved, "component", "left").select("id", F.coalesce("root", "component").alias("component")), "labels")


def link_components(docs: DataFrame, table: DataFrame, shingle: int, percent: int = PERCENT) -> DataFrame:
    """``(id, component)`` for the classes of ``table`` that share a bucket with another."""
    some = table.where("set_a IS NOT NULL AND doc_id IS NOT NULL")
    first = some.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("id"))
    # One row per class carries the bands on.
    reps = some.join(first.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    entries = reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = written(entries.join(shared, "bucket"), "buckets")
    labels = written(members.select("id").distinct().withColumn("component", F.col("id")), "labels")
    wanted = docs.join(labels.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = written(full_sets(wanted, shingle), "sets")
    firsts = _first_members(members.withColumn("component", F.col("id")), 1, [])
    pivots = written(firsts.select(F.col("f_bucket").alias("bucket"), F.col("f.id").alias("a")), "pivots")
    others = members.join(pivots, "bucket").where("a < id")
    near = written(compared(others.select("a", F.col("id").alias("b")).distinct(), sets, percent), "near")
    labels = merge_components(labels, written(near.where("linked").select("a", "b"), "links"))
    facts = near.select("a", F.col("b").alias("id"), *FACTS[1:])
    number = SOME
    while True:
        now = others.join(labels, "id")
        # Only buckets that still hold more than one component matter.
        mixed = (now.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
                 .groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("held"))
                 .where("held > 1").select("bucket", F.col("most.component").alias("main")))
        here = written(now.join(mixed, "bucket").join(facts, ["a", "id"]).drop("a"), "apart")
        outside = here.where(OUTSIDE)
        largest = outside.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0
        last = largest <= PIECE or number > MOST
        if last:
            firsts = outside.select(F.col("bucket").alias("f_bucket"), F.struct("id", *FACTS).alias("f"))
        else:
            firsts = _first_members(outside, number, FACTS[1:])
        links = bucket_links(here, firsts, percent, first=OUTSIDE if last else "false")
        labels = merge_components(labels, written(links, "links"))
        if last:
            return labels
        number *= GROWTH


FACTS = ["component", "na", "nb", "common", "apart"]
#: The members of a bucket outside its largest component.
OUTSIDE = "component <> main"


def bucket_links(here: DataFrame, firsts: DataFrame, percent: int, piece: int | None = None, first: str = "false") -> DataFrame:
    """``a, b``: links between first members (any of the bucket's) and members of the buckets.
    ``first`` may tell the first members among ``here``: two of them are then compared once.

    Members and first members of a bucket are dealt in pieces, and every two pieces meet. A
    meeting keeps track of what its links have joined: members that share a component by
    then are not compared, so it gives a spanning forest of its components, one row less
    than it has components, however many members are alike."""
    piece = piece or PIECE

    def pieces(apart):
        return F.ceil(F.greatest(F.count(F.lit(1)) / piece, F.sum(F.size(apart)) / SHINGLES)).cast("int")

    sizes = (here.groupBy("bucket").agg(pieces("apart").alias("pieces"))
             .join(firsts.groupBy(F.col("f_bucket").alias("bucket")).agg(pieces("f.apart").alias("f_pieces")), "bucket"))
    every = [F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias(name) for c, name in (("pieces", "piece"), ("f_pieces", "f_piece"))]
    members = here.join(sizes, "bucket").select("bucket", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece"), every[1],
                                                F.lit(1).alias("turn"), "id", F.expr(first).alias("first"), *FACTS)
    heads = firsts.join(sizes, F.col("bucket") == F.col("f_bucket")).select(
        "bucket", every[0], F.pmod(F.xxhash64("f.id"), F.col("f_pieces")).cast("int").alias("f_piece"),
        F.lit(0).alias("turn"), "f.id", F.lit(True).alias("first"), *[f"f.{c}" for c in FACTS])
    place = ["bucket", "piece", "f_piece"]
    dealt = heads.unionByName(members).repartition(*place).sortWithinPartitions(*place, "turn", "id")

    def run(batches):
        now, heads, parent = None, [], {}

        def root(c):
            while c in parent:
                c = parent[c]
            return c

        for batch in batches:
            a, b = [], []
            lists = batch.column("apart")    # a row's list becomes a set only when it is the row's turn
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i, r in enumerate(zip(*[batch.column(c).to_pylist() for c in (*place, "turn", "id", "first", *FACTS[:-1])])):
                *at, turn, who, one, component, na, nb, common = r
                if at != now:
                    now, heads, parent = at, [], {}
                apart = held(flat[ends[i]:ends[i + 1]])
                if not turn:
                    heads.append((who, component, nb, common, apart))
                    continue
                mine = root(component)
                for head, its, hb, shared, differs in heads:
                    if one and head >= who:    # the first member behind it is compared with it
                        break
                    other = root(its)
                    if other == mine:
                        continue
                    # No more than the smaller set, or the shorter difference, can be shared.
                    most = min(hb, nb, shared + common - na + min(len(differs), len(apart)))
                    if 100 * most < percent * (hb + nb - most):
                        continue
                    both = shared + common - na + in_both(differs, apart)
                    if 100 * both < percent * (hb + nb - both):
                        continue
                    parent[max(other, mine)] = mine = min(other, mine)
                    a.append(min(head, who))
                    b.append(max(head, who))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return dealt.mapInArrow(run, "a bigint, b bigint")


def held(values: np.ndarray):
    """The distinct shingles of a difference: a set, a sorted array if there are many."""
    return frozenset(values.tolist()) if len(values) <= LONG else np.sort(values)


def in_both(x, y) -> int:
    """How many shingles two differences share."""
    if isinstance(x, frozenset) and isinstance(y, frozenset):
        return len(x & y)
    if isinstance(x, frozenset):
        x, y = y, x
    y = np.fromiter(y, np.int64, len(y)) if isinstance(y, frozenset) else y
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    return int((x[at] == y).sum())


def _first_members(here: DataFrame, number: int, facts: list[str]) -> DataFrame:
    """``f_bucket, f``: the ``number`` members of smallest id of each bucket, as structs.
    Buckets are cut into pieces first, so that no task sorts a whole large one."""
    piece = here.withColumn("piece", F.pmod(F.xxhash64("id"), F.lit(64)))
    for keys in (["bucket", "piece"], ["bucket"]):
        order = Window.partitionBy(*keys).orderBy("id")
        piece = piece.withColumn("place", F.row_number().over(order)).where(F.col("place") <= number)
    return piece.select(F.col("bucket").alias("f_bucket"), F.struct("id", "component", *facts).alias("f"))


def components(docs: DataFrame, shingle: int, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    table = written(sketches(docs, shingle, rows, bands), "sketches")
    labels = link_components(docs, table, shingle, percent)
    classes = (table.where("set_a IS NOT NULL").groupBy("set_a", "set_b", "n_shingles")
               .agg(F.min("doc_id").alias("id")))
    named = classes.join(labels, "id", "left").select(
        "set_a", "set_b", "n_shingles", F.coalesce("component", "id").alias("class_component"))
    out = table.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id"))
    return (out.select("doc_id", "n_shingles", component.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def drop_near_copies(docs: DataFrame, shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, columns unchanged."""
    dropped = components(docs, shingle, percent).where("NOT kept").select(F.col("doc_id").alias("drop_id")).distinct()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return row.join(dropped, F.col("doc.doc_id") == F.col("drop_id"), "left_anti").select("doc.*")


def op1_minhash_near_dedup(spark, sf_dir):
    return components(read(spark, sf_dir, "documents"), 2)
