"""A Merkle manifest of a dataset: a leaf per row, a tree per source, a tree of sources.

``H`` is the lower-case hex SHA-256 of its inputs, end to end. A row's leaf is ``H`` of
doc_id, source, lang, n_chars and text, each ``-`` where null, else its UTF-8 byte count,
``:`` and the value. The leaves of a source stand in ascending order of doc_id; three
consecutive nodes become their ``H`` until one is left, the source's subroot, and the
subroots in the order of their sources give the root the same way.

Where a leaf stands is found by rank, not by sorting the leaves. The ids of a source are a
compressed bitmap: one 64-bit word for each 64 ids of which any is there, built by tasks
and merged with ``bit_or``, so a source that holds most rows sends a word per task and 64
ids. Popcount directories over 1,024 words, 1,024 of those, and so on, give what stands
before a word; the rank of an id is that and the popcount of the word below the id's bit.
Rows that meet their word by a join know their place at once.

The nodes are then laid into slot arrays of 3^5, keyed by source and place. An array is
reduced by five levels inside its row, so a tree of n leaves takes log(n) / log(243)
shuffles up. On the way down each array gets the path from its top to the root once, and
all its leaves fold theirs in the same row.

Cases: a null doc_id stands before all others and null sources before all others; rows
that share source and doc_id stand in the order of their leaves (copies are alike, so
their order does not matter); their words hold more rows than bits, and only the rows of
such words are ranked by a distributed sort. Null and empty texts differ (``-`` and
``0:``). Rows with a null doc_id are never tampered with. Extra columns take no part. An
empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.index import dense_index
from .common import read, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN, LEVELS = 3, 5
SLOTS = RUN ** LEVELS
#: Bits of an id inside its word, and bits of a word's number inside its directory.
WORD, FAN = 6, 10
#: Added to a word's number, so that negative ids have one as well.
ZERO = 1 << 63 - WORD


def coded(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(**values: Column) -> Column:
    return F.sha2(F.concat(*[coded(values[f]) for f in FIELDS]).cast("binary"), 256)


def without_newlines(doc_id: Column, text: Column) -> Column:
    """The check's tampering: where 2 divides the id's CRC-32, the text without newlines."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.translate(text, "\n", "")).otherwise(text)


def leaves(docs: DataFrame, tamper=without_newlines) -> DataFrame:
    """``g, doc_id, leaf, other``: the source as a key that is never null and sorts like
    the sources, and the leaf after ``tamper`` (null where it is the same)."""
    own = {f: F.col(f) for f in FIELDS}
    leaf, other = leaf_digest(**own), leaf_digest(**{**own, "text": tamper(F.col("doc_id"), F.col("text"))})
    source = F.col("source").cast("string")
    return (docs.select(*[F.col(f"`{f}`") for f in FIELDS])
            .select(F.coalesce(F.concat(F.lit("="), source), F.lit("-")).alias("g"), F.col("doc_id").cast("bigint").alias("doc_id"),
                    leaf.alias("leaf"), other.alias("other"))
            .withColumn("other", F.when(F.col("other") != F.col("leaf"), F.col("other"))))


# ------------------------------------------------------------------ places by rank
def _word(df: DataFrame) -> DataFrame:
    """The row's word (``some``: the id is not null; ``word``) and its bit in it."""
    return df.withColumns({"some": F.col("doc_id").isNotNull(), "word": F.coalesce(F.shiftright("doc_id", WORD) + F.lit(ZERO), F.lit(0)),
                           "bit": F.col("doc_id").bitwiseAND((1 << WORD) - 1).cast("int")})


def bitmap_words(rows: DataFrame) -> DataFrame:
    """``g, some, word, bits, n``: the sources' compressed bitmaps and how many rows each
    word has. A word with more rows than bits has ids that occur more than once."""
    return (_word(rows).groupBy("g", "some", "word")
            .agg(F.coalesce(F.bit_or(F.expr("shiftleft(1L, bit)")), F.lit(0)).alias("bits"), F.count(F.lit(1)).alias("n")))


def directories(words: DataFrame) -> DataFrame:
    """``words`` with ``offset`` (rows of the source before the word) and ``total`` (its rows).

    A directory entry sums 1,024 entries of the one below, so no window holds more rows;
    there are as many directories as the ids' common leading bits leave to tell apart."""
    low, high = words.where("some").agg(F.min("word"), F.max("word")).first()
    keys, level, tables = ["g", "some"], words.select("g", "some", F.col("word").alias("at"), "n"), []
    while True:
        inside = Window.partitionBy(*keys, "up").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn("up", F.shiftright("at", FAN))
        tables.append(level.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("n"))
        level = level.groupBy(*keys, F.col("up").alias("at")).agg(F.sum("n").alias("n"))
        if low is None or low >> FAN == high >> FAN:
            break
        low, high = low >> FAN, high >> FAN
    # One entry for the null id and one for the others is left of each source.
    first = Window.partitionBy("g").orderBy("some").rowsBetween(Window.unboundedPreceding, -1)
    offsets = level.select(*keys, F.col("at").alias("up"), F.coalesce(F.sum("n").over(first), F.lit(0)).alias("offset"),
                           F.sum("n").over(Window.partitionBy("g")).alias("total"))
    for table in reversed(tables):
        offsets = table.join(offsets, [*keys, "up"]).select(*keys, F.col("at").alias("up"), (F.col("offset") + F.col("before")).alias("offset"), "total")
    return words.join(offsets.withColumnRenamed("up", "word"), [*keys, "word"])


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` (written) with ``pos``, the place in the source, and ``total``."""
    words = written(directories(written(bitmap_words(rows), "bitmaps")), "directories")
    repeated = F.col("n") != F.bit_count("bits")
    met = _word(rows).join(words, ["g", "some", "word"])
    below = F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, bit)")))
    keep = [*rows.columns, "total"]
    once = met.where(~repeated).select(*keep, (F.col("offset") + below).alias("pos"))
    if not words.where(repeated).limit(1).count():
        return once
    crowd = written(met.where(repeated).select(*keep, "some", "word", "offset").withColumn("row", F.monotonically_increasing_id()), "repeated")
    ranked = dense_index(crowd, ["g", "some", "word", "doc_id", "leaf", "row"], "rank")
    starts = ranked.groupBy("g", "some", "word").agg(F.min("rank").alias("start"))
    more = ranked.join(starts, ["g", "some", "word"]).select(*keep, (F.col("offset") + F.col("rank") - F.col("start")).alias("pos"))
    return once.unionByName(more)


# ------------------------------------------------------------------ slot arrays
def digest(nodes) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def fold(nodes: list[str], total: int) -> list[list[str]]:
    """The levels above an array of a tree that is ``total`` nodes wide there."""
    out, width = [nodes], total
    for _ in range(LEVELS):
        if width == 1:
            break
        out.append([digest(out[-1][i:i + RUN]) for i in range(0, len(out[-1]), RUN)])
        width = -(-width // RUN)
    return out


def _arrays(nodes: DataFrame, more: tuple = ()) -> DataFrame:
    """Slot arrays ``g, block, total, node`` (and ``more``) of nodes with a place; slots of
    an array are its places in order, without gaps."""
    slots = F.array_sort(F.collect_list(F.struct((F.col("pos") % SLOTS).cast("int").alias("slot"), "node", *more)))
    packed = nodes.groupBy("g", F.floor(F.col("pos") / SLOTS).cast("bigint").alias("block")).agg(F.first("total").alias("total"), slots.alias("slots"))
    return packed.select("g", "block", "total", *[F.col(f"slots.{c}").alias(c) for c in ("node", *more)])


def _up(batches):
    for batch in batches:
        totals, arrays = batch.column("total").to_pylist(), batch.column("node")
        tops = [fold(a.as_py(), t)[-1][0] for a, t in zip(arrays, totals)]
        yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("block"), pa.array([-(-t // SLOTS) for t in totals], pa.int64()),
                                          pa.array(tops, pa.string())], ["g", "pos", "total", "node"])


def raised(nodes: DataFrame, more: tuple = ()) -> tuple[list[DataFrame], DataFrame]:
    """``(arrays of every pass, tops)``; ``tops`` has ``g, node, turn``: each tree's root and
    the pass that reached it."""
    passes, tops = [], []
    while True:
        passes.append(written(_arrays(nodes, () if passes else more), "slots"))
        up = written(passes[-1].select("g", "block", "total", "node").mapInArrow(_up, "g string, pos bigint, total bigint, node string"), "nodes")
        tops.append(up.where("total = 1").select("g", "node", F.lit(len(passes) - 1).alias("turn")))
        nodes = up.where("total > 1")
        if not nodes.limit(1).count():
            return passes, reduce(DataFrame.unionByName, tops)


PATH = "places array<int>, others array<array<string>>"
PATH_TYPES = [pa.list_(pa.int32()), pa.list_(pa.list_(pa.string()))]


def _beside(level: list[str], i: int) -> tuple[int, list[str]]:
    """The node's place in its run and the others of the run."""
    start = i - i % RUN
    return i % RUN, level[start:i] + level[i + 1:start + RUN]


def _down(batches):
    """From an array with the path of its top to the path of each of its nodes."""
    for batch in batches:
        out = {"g": [], "block": [], "places": [], "others": []}
        for r in batch.to_pylist():
            levels = fold(r["node"], r["total"])
            for slot in range(len(r["node"])):
                steps = [_beside(level, slot // RUN ** k) for k, level in enumerate(levels[:-1])]
                out["g"].append(r["g"])
                out["block"].append(r["block"] * SLOTS + slot)
                out["places"].append([p for p, _ in steps] + r["places"])
                out["others"].append([o for _, o in steps] + r["others"])
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), [pa.string(), pa.int64(), *PATH_TYPES])], list(out))


def paths(passes: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The arrays of the first pass with the path of each one's top. ``tops`` gives each
    tree's ``turn`` and the path above its root."""
    upper = None
    for turn in reversed(range(len(passes))):
        above = tops.where(F.col("turn") == turn).select("g", F.lit(0).cast("bigint").alias("block"), "places", "others")
        if upper is not None:
            above = above.unionByName(upper)
        met = passes[turn].join(above, ["g", "block"])
        if turn:
            upper = written(met.mapInArrow(_down, f"g string, block bigint, {PATH}"), "paths")
    return met


def _proofs(batches):
    """A row for each leaf: the digest of its siblings and the root folded from it."""
    for batch in batches:
        for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            levels = fold(r["node"], r["total"])
            above = list(zip(r["places"], r["others"]))
            texts = ["".join(x for _, o in above for x in o)]   # the siblings from a level's nodes up
            for level in reversed(levels[:-1]):
                texts = ["".join(_beside(level, i)[1]) + texts[i // RUN if len(texts) > 1 else 0] for i in range(len(level))]
            out = {"doc_id": r["doc_id"], "leaf": r["node"], "proof_sha256": [sha256(t.encode()).hexdigest() for t in texts], "folded_root": []}
            for slot, (leaf, other) in enumerate(zip(r["node"], r["other"])):
                node = other or leaf
                for place, others in [_beside(level, slot // RUN ** k) for k, level in enumerate(levels[:-1])] + above:
                    node = digest([*others[:place], node, *others[place:]])
                out["folded_root"].append(node)
            n = len(r["node"])
            yield pa.RecordBatch.from_arrays([pa.array([r["g"]] * n, pa.string()), pa.array(out["doc_id"], pa.int64()),
                                              *[pa.array(out[c], pa.string()) for c in ("leaf", "proof_sha256", "folded_root")]],
                                             ["g", "doc_id", "leaf", "proof_sha256", "folded_root"])


def _source_paths(batches):
    """The paths above the subroots, by source."""
    for batch in batches:
        out = {"g": [], "subroot": [], "turn": [], "places": [], "others": []}
        for r in batch.to_pylist():
            levels = fold(r["node"], r["total"])
            for slot, (source, turn) in enumerate(zip(r["source"], r["turn"])):
                steps = [_beside(level, slot // RUN ** k) for k, level in enumerate(levels[:-1])]
                for c, v in zip(out, (source, r["node"][slot], turn, [p for p, _ in steps] + r["places"], [o for _, o in steps] + r["others"])):
                    out[c].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), [pa.string(), pa.string(), pa.int32(), *PATH_TYPES])], list(out))


def manifest(docs: DataFrame, tamper=without_newlines) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row."""
    rows = written(leaves(docs, tamper), "leaves")
    nodes = placed(rows).withColumnRenamed("leaf", "node")
    passes, subroots = raised(nodes, ("doc_id", "other"))
    subroots = written(subroots, "subroots")
    sources = dense_index(subroots, ["g"], "pos")
    tree = sources.select(F.lit("").alias("g"), "pos", F.lit(subroots.count()).cast("bigint").alias("total"), "node", F.col("g").alias("source"), "turn")
    over, top = raised(tree, ("source", "turn"))
    last = top.first()  # the one root; none of an empty table
    root = F.lit(last["node"] if last else None).cast("string")
    bare = top.select("g", "turn", F.array().cast("array<int>").alias("places"), F.array().cast("array<array<string>>").alias("others"))
    above = written(paths(over, bare).mapInArrow(_source_paths, f"g string, subroot string, turn int, {PATH}"), "source-paths")
    found = paths(passes, above.drop("subroot")).mapInArrow(
        _proofs, "g string, doc_id bigint, leaf string, proof_sha256 string, folded_root string")
    named = found.join(above.select("g", "subroot"), "g")
    return named.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def op13_merkle_manifest(spark, sf_dir):
    return manifest(read(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH RECURSIVE c AS (
  SELECT doc_id, coalesce('=' || source, '-') AS g,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text
  FROM documents),
crc(i, v) AS (
  SELECT CAST(i AS BIGINT), list_reduce(range(0, 9), lambda x, k: CASE WHEN k = 0 THEN x WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, CAST(i AS BIGINT))
  FROM range(256) t(i)),
tab AS (SELECT list(v ORDER BY i) AS t FROM crc),
l AS (
  SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS bare,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ascii(CAST(doc_id AS VARCHAR)[k]) AS BIGINT))),
      lambda x, b: xor(x // 256, t[xor(x % 256, b) + 1])), CAST(4294967295 AS BIGINT)) % 2 = 0 AS touched,
    row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n
  FROM c, tab),
up(g, lvl, pos, h, n) AS (
  SELECT g, 0, pos, leaf, n FROM l
  UNION ALL
  SELECT g, max(lvl) + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 2) // 3 FROM up WHERE n > 1 GROUP BY g, pos // 3),
s AS (SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n, lvl AS depth FROM up WHERE n = 1),
top(lvl, pos, h, n) AS (
  SELECT 0, pos, h, n FROM s
  UNION ALL
  SELECT max(lvl) + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY pos // 3),
nodes AS (SELECT g, lvl, pos, h FROM up
          UNION ALL SELECT s.g, s.depth + t.lvl, t.pos, t.h FROM top t, s WHERE t.lvl > 0 OR t.pos <> s.pos),
walk(doc_id, g, leaf, lvl, pos, depth, spos, sibs, fold) AS (
  SELECT l.doc_id, l.g, leaf, 0, l.pos, s.depth, s.pos, '', CASE WHEN touched THEN bare ELSE leaf END FROM l JOIN s ON l.g = s.g
  UNION ALL
  SELECT w.doc_id, w.g, w.leaf, w.lvl + 1, w.here // 3, w.depth, w.spos,
    w.sibs || coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (WHERE x.pos <> w.here), ''),
    sha256(string_agg(CASE WHEN x.pos = w.here THEN w.fold ELSE x.h END, '' ORDER BY x.pos))
  FROM (SELECT *, CASE WHEN lvl = depth THEN spos ELSE pos END AS here FROM walk) w
  JOIN (SELECT g, lvl, pos, h FROM up WHERE n > 1
        UNION ALL SELECT s.g, s.depth + t.lvl, t.pos, t.h FROM top t, s WHERE t.n > 1) x
    ON x.g = w.g AND x.lvl = w.lvl AND x.pos // 3 = w.here // 3
  GROUP BY w.doc_id, w.g, w.leaf, w.lvl, w.here, w.depth, w.spos, w.sibs, w.fold),
ends AS (SELECT *, row_number() OVER (PARTITION BY g, doc_id, leaf ORDER BY lvl DESC) AS rn FROM walk)
SELECT e.doc_id, e.leaf, s.h AS subroot, r.h AS root, sha256(e.sibs) AS proof_sha256, e.fold AS folded_root, e.fold = r.h AS verified
FROM ends e JOIN s ON e.g = s.g, (SELECT h FROM top WHERE n = 1) r WHERE rn = 1
"""
