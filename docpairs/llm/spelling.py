"""Spelling variants of a corpus's words: which words are one edit apart.

Words are the maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased, of at least
``MIN_LENGTH`` code points and ``MIN_COUNT`` occurrences. Two words are near if one
inserted, deleted or replaced code point turns one into the other.

A sorted list is scanned with one edit matrix for all words looked for: the row of a
prefix is worked out once and stands for every word of the list that starts with it, as a
word takes over the rows up to the length it shares with the word before it (the LCP).
Rows are banded (three cells, since one edit moves a word by one place at most) and hold
the words looked for that are still within one edit; where none is left, the whole range
of the list that shares the prefix is skipped.

One edit leaves the first or the last half of a word as it is. So there are two sorted
lists, of the words and of the words spelled backwards, and in each a word only looks
among those that share its first ``kept_prefix`` code points; the second list leaves out
what the first one finds. A list is cut by place into blocks of ``BLOCK`` words. The
first and last words of the blocks (a word for each 4,096 of the vocabulary) go to the
tasks and tell each word which blocks to look in: those of its prefix, without the blocks
whose common prefix already is more than one edit away. So a prefix that a third of all
words share is many blocks, and a word looks in few of them. Words that look in one block
are dealt in parts of ``SEEKERS``. No pair of words is made that is not a result, and a
task returns a count and a best word for each word, not the pairs.

Cases: a null text has no words; runs of rows with a null doc_id lose no code point;
repeated rows count as often as they occur; an empty table, or one without such words,
gives no rows; extra columns take no part.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.index import dense_index
from .common import lower_ascii, read, written

MIN_LENGTH, MIN_COUNT, FACTOR = 6, 5, 5
BLOCK, SEEKERS = 8192, 65536
LAST = "\U0010ffff"
FAR = 2  # a cell beyond one edit


# ------------------------------------------------------------------ the words
def damaged(doc_id: Column, run: Column, divisor: int = 199) -> Column:
    """The run without one code point where ``divisor`` divides the CRC-32 of
    ``<doc_id>:<run>``; the CRC tells which."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % divisor == 0, cut).otherwise(run)


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, change=damaged) -> DataFrame:
    """``word, n`` over whole texts."""
    runs = docs.select(F.col("doc_id").alias("d"), F.explode_outer(
        F.regexp_extract_all(lower_ascii(F.col("text").cast("string")), F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("run"))
    words = runs.where("run IS NOT NULL").select(change(F.col("d"), F.col("run")).alias("word"))
    return (words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_count))


# ------------------------------------------------------------------ sorted lists in blocks
def kept_prefix(length: int, min_length: int = MIN_LENGTH) -> int:
    """Code points that a word of this length shares with any near word at one of its ends."""
    return max((length - 1) // 2, min_length // 2)


def shared(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def within_reach(word: str, prefix: str) -> bool:
    """Can a word that starts with ``prefix`` be ``word`` or one edit from it? A single edit
    may as well be made at the first difference."""
    i = shared(word, prefix)
    return i == len(prefix) or word[i + 1:].startswith(prefix[i + 1:]) or word[i:].startswith(prefix[i + 1:]) or word[i + 1:].startswith(prefix[i:])


def blocks_of(word: str, lows: list[str], highs: list[str], min_length: int = MIN_LENGTH) -> list[int]:
    """The blocks of a sorted list in which near words with the word's prefix can be."""
    prefix = word[:kept_prefix(len(word), min_length)]
    first, last = bisect_left(highs, prefix), bisect_right(lows, prefix + LAST) - 1
    if first >= last:
        return [first] if first == last else []
    return [b for b in range(first, last + 1) if within_reach(word, lows[b][:shared(lows[b], highs[b])])]


def sorted_lists(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``back, key, n, at, block``: the words (``back`` 0) and their reverses (1) with their
    places in the sorted list."""
    sides = words.select(F.explode(F.array(F.struct(F.lit(0).alias("back"), F.col("word").alias("key")),
                                           F.struct(F.lit(1).alias("back"), F.reverse("word").alias("key")))).alias("s"), "n")
    listed = dense_index(sides.select("s.back", "s.key", "n"), ["key"], "at", group_cols=["back"])
    return listed.withColumn("block", F.floor(F.col("at") / block).cast("int"))


def routed(lists: DataFrame, total: int, block: int, min_length: int) -> DataFrame:
    """``back, block, key``: which blocks each word looks in."""
    ends = lists.where((F.col("at") % block).isin(0, block - 1) | (F.col("at") == total - 1)).select("back", "at", "key").collect()
    edges = {}
    for back in (0, 1):
        mine = sorted((r["at"], r["key"]) for r in ends if r["back"] == back)
        edges[back] = ([k for at, k in mine if at % block == 0], [k for at, k in mine if at % block == block - 1 or at == total - 1])
    shipped = lists.sparkSession.sparkContext.broadcast(edges)

    def run(batches):
        for batch in batches:
            backs, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [blocks_of(k, *shipped.value[b], min_length) for b, k in zip(backs, keys)]
            take = pa.array(np.repeat(np.arange(len(keys)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array([b for f in found for b in f], pa.int32()),
                                              batch.column(1).take(take)], ["back", "block", "key"])
    return lists.select("back", "key").mapInArrow(run, "back int, block int, key string")


# ------------------------------------------------------------------ the scan
def letters(words: list[str], width: int) -> np.ndarray:
    """Code points of the words, a row each, with zeros behind."""
    out = np.zeros((len(words), width), np.uint32)
    for i, w in enumerate(words):
        out[i, :len(w)] = np.frombuffer(w.encode("utf-32-le"), np.uint32)
    return out


def scan(listed: list[str], seekers: list[str], min_length: int = MIN_LENGTH):
    """``(place in the list, seeker)`` arrays of all pairs one edit apart that share the
    seeker's ``kept_prefix``. ``listed`` is sorted.

    The list is read letter by letter, all ranges of a depth together: a range holds the
    words with one prefix, and a row of the matrix belongs to a range and a seeker. Where
    words of a range part (the LCP of neighbours is the depth), it becomes several."""
    found_at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if not listed or not seekers:
        return found_at[0], found[0]
    width = max(map(len, listed))
    words, marks = letters(listed, width + 1), letters(seekers, max(width, max(map(len, seekers))) + 3)
    lengths, sizes = np.array([len(w) for w in listed]), np.array([len(s) for s in seekers])
    lcp = np.concatenate([[-1], (words[1:] != words[:-1]).argmax(axis=1)])
    # Inside its prefix a seeker's letters must agree, so it starts at the prefix's range.
    exact = np.array([kept_prefix(len(s), min_length) for s in seekers])
    low = np.array([bisect_left(listed, s[:k]) for s, k in zip(seekers, exact)])
    high = np.array([bisect_right(listed, s[:k] + LAST, lo) for s, k, lo in zip(seekers, exact, low)])
    lo, hi, who, cells = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3), np.int8)
    for depth in range(exact.min(), width + 1):
        new = np.flatnonzero((exact == depth) & (low < high))
        if len(new):     # from here on a seeker's letter may be left out
            lo, hi, who = np.concatenate([lo, low[new]]), np.concatenate([hi, high[new]]), np.concatenate([who, new])
            cells = np.concatenate([cells, np.tile(np.array([FAR, 0, 1], np.int8), (len(new), 1))])
        ended = np.flatnonzero(lengths[lo] == depth)
        if len(ended):
            cell = sizes[who[ended]] - depth + 1
            near = (cell >= 0) & (cell <= 2)
            near[near] = cells[ended[near], cell[near]] == 1
            found_at.append(lo[ended[near]])
            found.append(who[ended[near]])
            lo[ended] += 1
        # The ranges of the next depth: one for each letter that goes on.
        parts = np.append(np.flatnonzero(lcp <= depth), len(listed))
        first, last = np.searchsorted(parts, lo), np.searchsorted(parts, hi)
        times = np.maximum(last - first, 0)
        row = np.repeat(np.arange(len(lo)), times)
        part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + first[row]
        lo, hi, who = parts[part], np.minimum(parts[part + 1], hi[row]), who[row]
        old, mark = cells[row], words[lo, depth]
        q = [marks[who, depth + k] != mark if depth + k >= 0 else True for k in (-1, 0, 1)]
        left = np.minimum(old[:, 0] + q[0], old[:, 1] + 1)
        mid = np.minimum(np.minimum(old[:, 1] + q[1], old[:, 2] + 1), left + 1)
        right = np.minimum(old[:, 2] + q[2], mid + 1)
        alive = np.minimum(np.minimum(left, mid), right) < FAR   # other ranges are skipped as a whole
        lo, hi, who = lo[alive], hi[alive], who[alive]
        cells = np.minimum(np.stack([left, mid, right], axis=1)[alive], FAR).astype(np.int8)
    return np.concatenate(found_at), np.concatenate(found)


NEAR_SCHEMA = "word string, n_near bigint, near_n bigint, near string"


def near_words(words: DataFrame, block: int = BLOCK, seekers: int = SEEKERS, min_length: int = MIN_LENGTH) -> DataFrame:
    """``word, n_near, near_n, near``: how many near words each word has (words with none
    are left out), and the one of largest n, of those the first in code-point order."""
    lists = written(sorted_lists(words, block), "sorted-lists")
    total = words.count()
    looks = written(routed(lists, total, block, min_length), "routes")
    parts = looks.groupBy("back", "block").agg(F.ceil(F.count(F.lit(1)) / seekers).cast("int").alias("parts"))
    seek = looks.join(parts, ["back", "block"]).select("back", "block", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), "key")
    hold = lists.join(parts, ["back", "block"]).select("back", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "key", "n")

    def run(held: pa.Table, sought: pa.Table) -> pa.Table:
        listed = sorted(zip(held.column("key").to_pylist(), held.column("n").to_pylist()))
        keys, n = [k for k, _ in listed], np.array([c for _, c in listed], np.int64)
        who = sorted(sought.column("key").to_pylist())
        back = held.column("back")[0].as_py() if held.num_rows else 0
        at, of = scan(keys, who, min_length)
        best: dict[int, list] = {}
        for a, o in zip(at.tolist(), of.tolist()):
            word, near = who[o], keys[a]
            if back:
                word, near = word[::-1], near[::-1]
                if shared(word, near) >= kept_prefix(len(word), min_length):
                    continue         # found in the list of the words themselves
            offer = (-int(n[a]), near)
            have = best.get(o)
            if have is None:
                best[o] = [word, 1, offer]
            else:
                have[1] += 1
                have[2] = min(have[2], offer)
        rows = list(best.values())
        return pa.table({"word": pa.array([r[0] for r in rows], pa.string()), "n_near": pa.array([r[1] for r in rows], pa.int64()),
                         "near_n": pa.array([-r[2][0] for r in rows], pa.int64()), "near": pa.array([r[2][1] for r in rows], pa.string())})

    keys = ["back", "block", "part"]
    found = hold.groupBy(*keys).cogroup(seek.groupBy(*keys)).applyInArrow(run, NEAR_SCHEMA)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    return (written(found, "near-words").groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
            .select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near")))


# ------------------------------------------------------------------ forms and roots
def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form``: forms followed to the last. A form is more
    frequent than its word by a factor, so chains are short; each turn doubles what is
    followed."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                             F.col("next").isNotNull().alias("moved")), "roots")
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        now = now.drop("moved")


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, factor: int = FACTOR,
             change=damaged, block: int = BLOCK, seekers: int = SEEKERS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs``."""
    words = written(word_counts(docs, min_length, min_count, change), "words")
    near = near_words(words, block, seekers, min_length)
    is_form = F.col("near_n") >= factor * F.col("n")
    judged = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near")).alias("form"),
        F.when(is_form, F.col("near_n")).alias("form_n")), "forms")
    last = roots(judged.where("form IS NOT NULL").select("word", "form"))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir):
    return variants(read(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH RECURSIVE crc AS (
  SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), [CAST(k AS BIGINT) FOR k IN range(8)]), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS v
  FROM range(256) r(i)),
tab AS (SELECT list(v ORDER BY i) AS t FROM crc),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]+')) AS run
  FROM documents),
once AS (SELECT doc_id, run, count(*) AS times, hex(encode(doc_id || ':' || run)) AS bytes FROM runs GROUP BY doc_id, run),
hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(range(0, len(bytes) // 2), lambda k: CAST('0x' || bytes[2 * k + 1:2 * k + 2] AS BIGINT))),
      lambda x, b: xor(x // 256, t[xor(x % 256, b) + 1])), CAST(4294967295 AS BIGINT)) AS h
  FROM once, tab),
said AS (SELECT CASE WHEN h % 199 = 0 THEN run[:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word, times FROM hashed),
w AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM said WHERE len(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
cut AS (SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(0, len(word))) AS i FROM w) c),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, c.n, w.word, w.n FROM cut c JOIN w ON c.rest = w.word
  UNION SELECT w.word, w.n, c.word, c.n FROM cut c JOIN w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, min({'less': -near_n, 'near': near}) AS b FROM near GROUP BY word),
judged AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 5 * w.n THEN b.near END AS form,
    CASE WHEN -b.less >= 5 * w.n THEN -b.less END AS form_n
  FROM w LEFT JOIN best ON w.word = best.word),
walk AS (
  SELECT word, word AS root, form AS next FROM judged
  UNION ALL SELECT walk.word, walk.next, j.form FROM walk JOIN judged j ON j.word = walk.next)
SELECT j.word, j.form, k.root, j.n, CAST(j.n_near AS BIGINT) AS n_near, CAST(j.form_n AS BIGINT) AS form_n
FROM judged j JOIN walk k ON k.word = j.word WHERE k.next IS NULL
"""
