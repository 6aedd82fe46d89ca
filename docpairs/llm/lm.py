"""N-gram language model with interpolated modified Kneser-Ney smoothing (order 2).

Spark counts, the model is a folder of sorted arrays, and the scoring tasks map those
files into memory.

1. Words: every task counts the hashes of its words; the counts are shuffled by range of
   the hash and each shard becomes two arrays (sorted hashes, counts). A word's number is
   its place in that order over all shards.
2. Bigrams: every task counts pairs of numbers; a shard gets a range of first words, but
   the pairs of a first word with more than a quarter of a shard's mean share are dealt
   by the whole pair. Each shard becomes two arrays (sorted pairs, counts) and gives the
   words' context statistics (total, how many pairs were seen once, twice, more often) and
   continuation counts, which become arrays of the word shards.
3. Discounts come from the counts of counts (one row reaches the driver).
4. Scoring looks the words and pairs of a few MB of text up in the mapped arrays.

Where ``spark.checkpoint.dir`` is no file path, a worker copies a file to its own scratch
folder when it first maps it.

Cases: null and empty texts have one token, the end; words unseen in training share the
uniform part; with no training rows every probability is 1; rows with a null id train
and are scored; repeated rows count each; an empty table gives no rows; extra columns do
not reach the result. All training texts are counted whole; nothing is pruned.
"""

from __future__ import annotations

import io
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_by, local_path, read, run_folder, save_file, text_or_empty
from .wordhash import mix, slices, text_bytes, words

END = np.uint64(0x5EED0FE4D0000001)
#: Distinct keys a task holds before it hands partial counts on.
HELD = 1 << 19
#: Bytes of text that are worked on at once.
SLICE = 3 << 20
#: Tokens per shard of pairs.
SHARD_TOKENS = 1_000_000


# ------------------------------------------------------------------ arrays
def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class Tally:
    """Counts of uint64 keys in bounded memory: ``add`` gives back what overflows."""

    def __init__(self, held: int = HELD):
        self.held, self.parts, self.size = held, [], 0

    def add(self, keys: np.ndarray):
        if len(keys):
            keys, counts = np.unique(keys, return_counts=True)
            self.parts.append((keys, counts.astype(np.int64)))
            self.size += len(keys)
        if self.size > 2 * self.held:
            merged = self._merge()
            if len(merged[0]) > self.held:
                yield merged
                self.parts, self.size = [], 0
            else:
                self.parts, self.size = [merged], len(merged[0])

    def _merge(self):
        keys, counts = map(np.concatenate, zip(*self.parts))
        self.parts = []
        return summed(keys, counts)

    def rest(self):
        if self.parts:
            yield self._merge()


def range_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a hash by its range: sorted keys have sorted shards."""
    return (((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int32)


def save_array(folder: str, name: str, values: np.ndarray) -> None:
    out = io.BytesIO()
    np.save(out, values)
    save_file(folder, f"{name}.npy", out.getvalue())


_COPIES: dict[str, str] = {}


def load_array(folder: str, name: str) -> np.ndarray:
    """A file of the model, mapped into memory."""
    path = local_path(folder)
    if path is None:
        from pyarrow import fs
        uri = f"{folder}/{name}.npy"
        if uri not in _COPIES:
            store, remote = fs.FileSystem.from_uri(uri)
            handle, copy = tempfile.mkstemp(suffix=".npy")
            with store.open_input_stream(remote) as src, os.fdopen(handle, "wb") as out:
                while chunk := src.read(1 << 22):
                    out.write(chunk)
            _COPIES[uri] = copy
        return np.load(_COPIES[uri], mmap_mode="r")
    return np.load(f"{path}/{name}.npy", mmap_mode="r")


def by_slice(sorted_shards: np.ndarray):
    """``(shard, from, to)`` of each run in a sorted array of shard numbers."""
    if len(sorted_shards):
        first = np.flatnonzero(np.concatenate([[True], sorted_shards[1:] != sorted_shards[:-1]]))
        for a, b in zip(first, [*first[1:], len(sorted_shards)]):
            yield int(sorted_shards[a]), a, b


# ------------------------------------------------------------------ the model in a worker
class Words:
    """Numbers, counts and statistics of words, from the mapped word shards."""

    def __init__(self, folder: str, sizes: list[int]):
        self.folder, self.shards = folder, len(sizes)
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.size = int(self.base[-1])
        self.arrays: dict[str, np.ndarray] = {}

    def array(self, kind: str, shard: int) -> np.ndarray:
        name = f"{kind}-{shard:06d}"
        if name not in self.arrays:
            self.arrays[name] = load_array(self.folder, name)
        return self.arrays[name]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each hash, -1 for an unseen word. ``hashes``: sorted, distinct."""
        out = np.full(len(hashes), -1, np.int64)
        for shard, a, b in by_slice(range_shard(hashes, self.shards)):
            known = self.array("word", shard)
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes[a:b]), len(known) - 1)
                hit = known[at] == hashes[a:b]
                out[a:b][hit] = at[hit] + self.base[shard]
        return out

    def shard_of(self, numbers: np.ndarray) -> np.ndarray:
        return (np.searchsorted(self.base, numbers, side="right") - 1).astype(np.int32)

    def values(self, kind: str, numbers: np.ndarray) -> np.ndarray:
        """Values of sorted numbers below ``size``."""
        out = np.zeros(len(numbers), np.int64)
        for shard, a, b in by_slice(self.shard_of(numbers)):
            out[a:b] = self.array(kind, shard)[numbers[a:b] - self.base[shard]]
        return out


def pair_shard(pairs: np.ndarray, first: np.ndarray, hot: np.ndarray, n_words: int, shards: int) -> np.ndarray:
    plain = first * shards // (n_words + 1)
    return np.where(hot, (mix(pairs) >> np.uint64(20)).astype(np.int64) % shards, plain).astype(np.int32)


def token_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a slice of texts, each text closed by ``END``, and the place of
    each text's end token."""
    data, offsets = text_bytes(column)
    text, hashes = words(data, offsets)
    ends = np.cumsum(np.bincount(text, minlength=len(column)) + 1) - 1
    out = np.full(len(hashes) + len(column), END)
    out[np.arange(len(hashes)) + text] = hashes
    return out, ends


def first_words(numbers: np.ndarray, ends: np.ndarray, start: int) -> np.ndarray:
    """The number before each token; ``start`` before a text's first."""
    before = np.empty_like(numbers)
    before[1:] = numbers[:-1]
    before[0] = start
    before[ends[:-1] + 1] = start
    return before


def _number_tokens(vocabulary: Words, hashes: np.ndarray) -> np.ndarray:
    distinct, back = np.unique(hashes, return_inverse=True)
    return vocabulary.numbers(distinct)[back]


def _hot(vocabulary: Words, first: np.ndarray, limit: float) -> np.ndarray:
    """Whether each first word (sorted) is hot; the text start always is."""
    hot = first == vocabulary.size
    inside = ~hot
    hot[inside] = vocabulary.values("count", first[inside]) > limit
    return hot


# ------------------------------------------------------------------ training in Spark
def _count_words(shards: int):
    def run(batches):
        held_by("lm-words")     # lets go of the model that the worker scored with before
        tally = Tally()
        for batch in batches:
            for _, part in slices(batch.column(0), SLICE):
                for keys, counts in tally.add(token_hashes(part)[0]):
                    yield _counted(range_shard(keys, shards), keys, counts)
        for keys, counts in tally.rest():
            yield _counted(range_shard(keys, shards), keys, counts)
    return run


def _counted(shard, keys, counts):
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(keys.view(np.int64)), pa.array(counts)],
                                      ["shard", "key", "n"])


def _combined(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    keys = table.column("key").to_numpy().view(np.uint64)
    return table.column("shard")[0].as_py(), *summed(keys, table.column("n").to_numpy())


def _save_words(folder: str):
    def run(table: pa.Table) -> pa.Table:
        held_by("lm-words")
        shard, keys, counts = _combined(table)
        save_array(folder, f"word-{shard:06d}", keys)
        save_array(folder, f"count-{shard:06d}", counts)
        return pa.table({"shard": pa.array([shard], pa.int32()), "size": [len(keys)], "tokens": [int(counts.sum())]})
    return run


def _count_pairs(vocabulary_of, limit: float, shards: int):
    def run(batches):
        vocabulary, tally = vocabulary_of(), Tally()

        def out(pairs, counts):
            first = (pairs >> np.uint64(32)).astype(np.int64)
            hot = _hot(vocabulary, first, limit)
            return _counted(pair_shard(pairs, first, hot, vocabulary.size, shards), pairs, counts)

        for batch in batches:
            for _, part in slices(batch.column(0), SLICE):
                hashes, ends = token_hashes(part)
                numbers = _number_tokens(vocabulary, hashes)
                before = first_words(numbers, ends, vocabulary.size)
                pairs = before.astype(np.uint64) << np.uint64(32) | numbers.astype(np.uint64)
                for done in tally.add(pairs):
                    yield out(*done)
        for done in tally.rest():
            yield out(*done)
    return run


_STATISTICS = ("follows", "total", "once", "twice", "more")


def _save_pairs(vocabulary_of, folder: str):
    def run(table: pa.Table) -> pa.Table:
        vocabulary = vocabulary_of()
        shard, pairs, counts = _combined(table)
        save_array(folder, f"pair-{shard:06d}", pairs)
        save_array(folder, f"seen-{shard:06d}", counts.astype(np.uint32))
        first, last = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        numbers = np.unique(np.concatenate([first, last]))
        numbers = numbers[numbers < vocabulary.size]
        at_first, at_last = np.searchsorted(numbers, first), np.searchsorted(numbers, last)
        n = len(numbers)
        inside = first < vocabulary.size
        of_first = [np.bincount(at_first[inside & ok], weights=w[inside & ok], minlength=n)[:n].astype(np.int64)
                    for ok, w in ((counts > 0, counts), (counts == 1, np.ones(len(pairs))),
                                  (counts == 2, np.ones(len(pairs))), (counts > 2, np.ones(len(pairs))))]
        starts = [int(x) for x in (counts[~inside].sum(), *((counts[~inside] == k).sum() for k in (1, 2)), (counts[~inside] > 2).sum())]
        seen = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        columns = [np.bincount(at_last, minlength=n)[:n].astype(np.int64), *of_first]
        # Two rows that are no words, one of the shard each: counts of counts, and the text start as first word.
        special = [[len(pairs), *seen], [0, *starts]]
        owner = [shard % vocabulary.shards] * 2
        out = {"shard": pa.array(np.concatenate([vocabulary.shard_of(numbers), owner]), pa.int32()),
               "number": pa.array(np.concatenate([numbers, [-1, -2]]))}
        for k, name in enumerate(_STATISTICS):
            out[name] = pa.array(np.concatenate([columns[k], [special[0][k], special[1][k]]]).astype(np.int64))
        return pa.table(out)
    return run


def _save_statistics(vocabulary_of, folder: str):
    def run(table: pa.Table) -> pa.Table:
        vocabulary = vocabulary_of()
        shard = table.column("shard")[0].as_py()
        numbers = table.column("number").to_numpy()
        is_word = numbers >= 0
        low, size = vocabulary.base[shard], int(vocabulary.base[shard + 1] - vocabulary.base[shard])
        special, follows = {}, None
        for name in _STATISTICS:
            values = table.column(name).to_numpy()
            sums = np.bincount(numbers[is_word] - low, weights=values[is_word], minlength=size).astype(np.int64)
            save_array(folder, f"{name}-{shard:06d}", sums)
            follows = sums if name == "follows" else follows
            special[name] = int(values[numbers == -1].sum()), int(values[numbers == -2].sum())
        out = {f"all_{name}": [v[0]] for name, v in special.items()}
        out |= {f"start_{name}": [v[1]] for name, v in special.items()}
        out |= {f"follows_{k}": [int((follows == k).sum())] for k in (1, 2, 3, 4)}
        return pa.table(out)
    return run


def discounts(counts_of_counts) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from n1..n4; 0.5, 1, 1.5 where those are too few."""
    n1, n2, n3, n4 = counts_of_counts
    if min(n1, n2, n3, n4) == 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.05 * k), k - 0.05)
                 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


class Model:
    """What scoring needs, small enough to go with the task: sizes, discounts, places."""

    def __init__(self, folder, sizes, tokens, shards, limit, totals):
        self.folder, self.sizes, self.tokens, self.shards, self.limit = folder, sizes, tokens, shards, limit
        self.n_words = int(sum(sizes))
        t = {k: int(v or 0) for k, v in totals.items()}
        self.pairs = t.get("all_follows", 0)
        self.d2 = discounts([t.get(f"all_{k}", 0) for k in ("total", "once", "twice", "more")])
        follows = [t.get(f"follows_{k}", 0) for k in (1, 2, 3, 4)]
        self.d1 = discounts(follows)
        self.start = [t.get(f"start_{k}", 0) for k in ("total", "once", "twice", "more")]
        self.follows = follows

    def words(self) -> Words:
        return _words(self.folder, tuple(self.sizes))

    def _unigram(self, follows: np.ndarray) -> np.ndarray:
        """Continuation probability, interpolated with the uniform distribution over the
        words and one unknown word."""
        if not self.pairs:
            return np.full(len(follows), 1.0 / (self.n_words + 1))
        d = np.select([follows == 0, follows == 1, follows == 2], [0.0, self.d1[0], self.d1[1]], self.d1[2])
        more = self.n_words - self.follows[0] - self.follows[1]
        left = (self.d1[0] * self.follows[0] + self.d1[1] * self.follows[1] + self.d1[2] * more) / self.pairs
        return np.maximum(follows - d, 0) / self.pairs + left / (self.n_words + 1)

    def log_probabilities(self, numbers: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log10 probability of each token after the one before it."""
        vocabulary = self.words()
        known, back = np.unique(numbers, return_inverse=True)
        inside = known >= 0
        of = {}
        for name in _STATISTICS:
            of[name] = np.zeros(len(known), np.int64)
            if self.pairs:
                of[name][inside] = vocabulary.values(name, known[inside])
        unigram = self._unigram(of["follows"])[back]
        before = first_words(numbers, ends, vocabulary.size)
        starts = before == vocabulary.size
        place = first_words(back, ends, 0)
        total, once, twice, more = (np.where(starts, s, of[name][place])
                                    for s, name in zip(self.start, _STATISTICS[1:]))
        seen = np.zeros(len(numbers), np.int64)
        both = (before >= 0) & (numbers >= 0)
        if self.pairs and both.any():
            pairs = before[both].astype(np.uint64) << np.uint64(32) | numbers[both].astype(np.uint64)
            distinct, where = np.unique(pairs, return_inverse=True)
            seen[both] = self._seen(vocabulary, distinct)[where]
        d = np.select([seen == 0, seen == 1, seen == 2], [0.0, self.d2[0], self.d2[1]], self.d2[2])
        context = total > 0
        kept = (self.d2[0] * once + self.d2[1] * twice + self.d2[2] * more) / np.maximum(total, 1)
        p = np.where(context, np.maximum(seen - d, 0) / np.maximum(total, 1) + kept * unigram, unigram)
        return np.log10(p)

    def _seen(self, vocabulary: Words, pairs: np.ndarray) -> np.ndarray:
        first = (pairs >> np.uint64(32)).astype(np.int64)
        shard = pair_shard(pairs, first, _hot(vocabulary, first, self.limit), vocabulary.size, self.shards)
        order = np.argsort(shard, kind="stable")
        out = np.zeros(len(pairs), np.int64)
        for s, a, b in by_slice(shard[order]):
            rows = order[a:b]
            try:
                known = vocabulary.array("pair", s)
            except FileNotFoundError:  # no pair fell into this shard
                continue
            at = np.minimum(np.searchsorted(known, pairs[rows]), len(known) - 1)
            hit = known[at] == pairs[rows]
            out[rows[hit]] = vocabulary.array("seen", s)[at[hit]]
        return out


def _words(folder: str, sizes: tuple[int, ...]) -> Words:
    """The words of a model; a worker keeps the maps of one model at a time."""
    held = held_by("lm")
    if folder not in held:
        held.clear()
        held[folder] = Words(folder, list(sizes))
    return held[folder]


def train(texts: DataFrame, folder: str) -> Model:
    """Train on the column ``text`` of ``texts``; the arrays go to ``folder``."""
    src = texts.select(text_or_empty("text").alias("text"))
    shards = 2 * max(1, src.rdd.getNumPartitions())
    counted = src.mapInArrow(_count_words(shards), "shard int, key bigint, n bigint")
    made = (counted.groupBy("shard").applyInArrow(_save_words(folder), "shard int, size bigint, tokens bigint"))
    meta = {r.shard: r for r in made.collect()}  # one row per shard
    sizes = [int(meta[s].size) if s in meta else 0 for s in range(shards)]
    tokens = sum(int(r.tokens) for r in meta.values())
    if not tokens:
        return Model(folder, [0], 0, 1, 0.0, {})
    for s in set(range(shards)) - set(meta):
        save_array(folder, f"word-{s:06d}", np.zeros(0, np.uint64))
    if sum(sizes) >= (1 << 32) - 1:
        raise ValueError("more distinct words than a pair of 32-bit numbers can hold")
    pair_shards = max(1, -(-tokens // SHARD_TOKENS))
    limit = tokens / (4 * pair_shards)
    vocabulary_of = lambda: _words(folder, tuple(sizes))
    pairs = src.mapInArrow(_count_pairs(vocabulary_of, limit, pair_shards), "shard int, key bigint, n bigint")
    columns = ", ".join(f"{c} bigint" for c in ("number", *_STATISTICS))
    statistics = pairs.groupBy("shard").applyInArrow(_save_pairs(vocabulary_of, folder), f"shard int, {columns}")
    names = [f"{a}_{b}" for a in ("all", "start") for b in _STATISTICS] + [f"follows_{k}" for k in (1, 2, 3, 4)]
    parts = statistics.groupBy("shard").applyInArrow(_save_statistics(vocabulary_of, folder),
                                                     ", ".join(f"{c} bigint" for c in names))
    totals = parts.agg(*[F.sum(c).alias(c) for c in names]).first().asDict()
    return Model(folder, sizes, tokens, pair_shards, limit, totals)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of every whole text."""
    def run(batches):
        vocabulary = model.words() if model.tokens else None
        for batch in batches:
            for at, part in slices(batch.column(1), SLICE):
                hashes, ends = token_hashes(part)
                starts = np.concatenate([[0], ends[:-1] + 1])
                counts = np.zeros(len(hashes), np.int64)
                numbers = np.full(len(hashes), -1, np.int64)
                if vocabulary is not None:
                    numbers = _number_tokens(vocabulary, hashes)
                    known, back = np.unique(numbers, return_inverse=True)
                    c = np.zeros(len(known), np.int64)
                    c[known >= 0] = vocabulary.values("count", known[known >= 0])
                    counts = c[back]
                base = np.log10((counts + 1) / (model.tokens + model.n_words + 1))
                logs = model.log_probabilities(numbers, ends) if vocabulary is not None else np.zeros(len(hashes))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array(np.diff(np.append(starts, len(hashes)))),
                     pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)),
                     pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(logs, starts))],
                    ["doc_id", "n_tokens", "n_known", "base_score", "score"])
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text"))
    return src.mapInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")


def held_out(col="doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def perplexity(log10_probability, n_tokens):
    """Column: perplexity of a text from its score and token count."""
    return F.pow(F.lit(10.0), -log10_probability / n_tokens)


def op3_kneser_ney(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = train(docs.where(~held_out("doc_id")), run_folder(spark, "lm"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known",
                         F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score",
                         perplexity(F.col("score"), F.col("n_tokens")).alias("perplexity"))
