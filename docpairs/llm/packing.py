"""Best-fit packing by bin completion.

Documents are tokenised, documents longer than a sequence are cut into full pieces (the
first piece takes the remainder), and the pieces are packed into sequences of
``capacity`` tokens.

Packing runs in groups of about ``GROUP`` pieces, dealt by a hash of the written row's
number, so every group is bounded however many pieces a source, a length or an id holds.
Groups do not exchange pieces; the README has what that costs. Inside a group a branch-and-bound
search takes the largest remaining piece, enumerates the undominated fillings around it
(any number of further pieces, best fill first, each when the search comes back for it),
and prunes a branch when the space it leaves free exceeds what a solution with one
sequence fewer than the incumbent could leave. The incumbent is the best-fit-decreasing solution, replaced by every better one
found; the search is over the bins that it leaves space in, and ends at the lower bound
ceil(tokens / capacity), when no branch is left, or after a stated number of fillings.

Cases: null text is empty; every document ends with the end token, so it has at least one
piece; null and repeated ids are packed like others (a repeated row is its own document);
an empty table gives no rows; extra columns do not reach the result.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_by, read, text_or_empty, written
from .forms import spelled, stem, text_forms

CAPACITY = 2048
GROUP = 16384
#: Fillings that the search looks at in a group beyond the first descent.
NODES = 2000
#: Steps for one filling by sums of an earlier node, before a node takes sums of its own.
STALE_STEPS = 2048
#: Word forms whose ids a worker remembers; further forms are encoded each time.
CACHED_FORMS = 800_000


# ------------------------------------------------------------------ tokenising
class PieceEncoder:
    """Token ids of texts as little-endian 32-bit bytes; each distinct form of a word
    goes to the tokenizer once per worker."""

    def __init__(self, path: str, cached_forms: int = CACHED_FORMS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cached_forms = cached_forms
        self.forms: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _ids(self, parts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in encoded]

    def _find(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of forms that are not known yet: those of a word and those of the marks
        after it are looked up apart."""
        stems = {w: stem(w) for w in missing}
        new = [x for x in set(stems.values()) if x not in self.forms]
        marks = list({w[len(x):] for w, x in stems.items() if x != w} - self.marks.keys())
        found = self._ids([*marks, *map(spelled, new)])
        self.marks.update(zip(marks, found))
        ids = dict(zip(new, found[len(marks):]))
        for w, x in stems.items():
            if x != w:
                ids[w] = (ids[x] if x in ids else self.forms[x]) + self.marks[w[len(x):]]
        if len(self.forms) < self.cached_forms:
            self.forms.update((w, x) for w, x in ids.items() if len(w) <= 64)
        return ids

    def encode(self, text: str) -> bytes:
        head, words, newline = text_forms(text)
        first = self._ids([head])[0] if head else b""
        ids = list(map(self.forms.get, words))
        if None in ids:
            gaps = [i for i, x in enumerate(ids) if x is None]
            new = self._find({words[i] for i in gaps})
            for i in gaps:
                ids[i] = new[words[i]]
        return first + b"".join(ids)[4 * newline:]


def _encoder(path: str, cached_forms: int = CACHED_FORMS) -> PieceEncoder:
    """One encoder per worker process and tokenizer."""
    held, key = held_by("packing"), (path, cached_forms)
    if key not in held:
        held[key] = PieceEncoder(path, cached_forms)
    return held[key]


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                     ("length", pa.int64()), ("ids", pa.binary())])


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0,
                 cached_forms: int = CACHED_FORMS) -> DataFrame:
    """``doc_id, piece, start, length, ids``: the pieces of each document's tokens (its
    ids, then ``end_id``); ``ids`` holds little-endian unsigned 32-bit numbers."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def pieces(batches):
        encoder = _encoder(tokenizer_path, cached_forms)
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py()) + end
                n = len(ids) // 4
                start, stop = 0, (n - 1) % capacity + 1
                piece = 0
                while start < n:
                    rows.append((doc_id, piece, start, stop - start, ids[4 * start:4 * stop]))
                    start, stop, piece = stop, stop + capacity, piece + 1
                size += len(ids)
                if size > 4 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text"))
    return src.mapInArrow(pieces, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


def _batch(rows):
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECES.types)], schema=_PIECES)


# ------------------------------------------------------------------ packing
def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of lengths; each length goes to the fullest bin it fits."""
    bins: list[list[int]] = []
    by_space: dict[int, list[int]] = {}
    spaces = np.zeros(capacity + 1, dtype=bool)
    for x in sorted(lengths, reverse=True):
        at = int(np.argmax(spaces[x:])) + x if x <= capacity else capacity + 1
        if at <= capacity and spaces[at]:
            b = by_space[at].pop()
            if not by_space[at]:
                spaces[at] = False
            bins[b].append(x)
            space = at - x
        else:
            bins.append([x])
            b, space = len(bins) - 1, capacity - x
        if space > 0:
            by_space.setdefault(space, []).append(b)
            spaces[space] = True
    return bins


def _sums(counts: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """The distinct lengths, ascending, for each number of the smallest of them the sums
    up to ``capacity`` that their pieces reach, as bits, and the bits of the lengths."""
    sizes = [v for v, n in enumerate(counts) if n]
    reached, mask = [1], (2 << capacity) - 1
    for v in sizes:
        bits, left, step = reached[-1], min(counts[v], capacity // v), 1
        while left > 0:
            step = min(step, left)
            bits |= bits << v * step
            left -= step
            step *= 2
        reached.append(bits & mask)
    return sizes, reached, sum(1 << v for v in sizes)


class _Stale(Exception):
    """The sums of an earlier node lead to too many dead ends here."""


def _exact(counts: list[int], sums, space: int, upto: int, steps: list[float]):
    """Sets of the ``upto`` smallest lengths that fill ``space`` to the last token, larger
    pieces first. Sums of more pieces than remain cost dead ends, never a set."""
    if not space:
        yield ()
        return
    sizes, reached, _ = sums
    for j in range(min(upto, bisect_right(sizes, space)) - 1, -1, -1):
        if not reached[j + 1] >> space & 1:
            return
        steps[0] -= 1
        if steps[0] < 0:
            raise _Stale
        v = sizes[j]
        for n in range(min(counts[v], space // v), 0, -1):
            if reached[j] >> space - n * v & 1:
                for rest in _exact(counts, sums, space - n * v, j, steps):
                    yield (v,) * n + rest


def _spread(bits: int, n: int) -> int:
    """Every bit, and the ``n`` after it."""
    done = 0
    while done < n:
        step = min(done + 1, n - done)
        bits |= bits << step
        done += step
    return bits


def _dominated(counts: list[int], present: int, fill: tuple[int, ...], slack: int) -> bool:
    """Whether one other remaining length could be added, or replace some of the pieces
    and leave no more space: fewer, larger pieces are never harder to place elsewhere.
    ``present`` has the bits of all lengths that may remain."""
    several, single = 0, 1
    for v in fill:
        several |= several << v | (single ^ 1) << v
        single |= 1 << v
    better = _spread(several, slack)
    if slack:  # one piece, or none, gives way to something longer only
        better |= _spread(single << 1, slack - 1)
    better &= present
    while better:
        v = better.bit_length() - 1
        if counts[v] > fill.count(v):
            return True
        better ^= 1 << v
    return False


def completions(counts: list[int], space: int, sums, least=lambda: 0):
    """Undominated sets of remaining lengths that fit ``space``, any number of pieces,
    best fill first, of equal fills the one with larger pieces; None stands for a
    dominated one. Ends below a fill of ``least()``. ``sums`` come from this node or one
    above it; the caller restores ``counts`` before it asks for the next set."""
    total = space
    while total >= max(0, least()):
        given, fresh = 0, sums is None
        while True:
            if sums is None:
                sums = _sums(counts, space)
            steps = [float("inf") if fresh else STALE_STEPS]
            try:
                for k, fill in enumerate(_exact(counts, sums, total, len(sums[0]), steps)):
                    if k >= given:
                        given += 1
                        yield None if _dominated(counts, sums[2], fill, space - total) else fill
                break
            except _Stale:
                sums, fresh = None, True
        below = sums[1][bisect_right(sums[0], space)] & ((1 << total) - 1)
        total = below.bit_length() - 1


def bin_completion(lengths: list[int], capacity: int, nodes: int = NODES) -> list[list[int]]:
    """As few bins as the search finds within ``nodes`` fillings beyond its first descent."""
    full = [[x] for x in lengths if x >= capacity]
    rest = [x for x in lengths if x < capacity]
    if not rest:
        return full
    best = best_fit_decreasing(rest, capacity)
    if len(best) == -(-sum(rest) // capacity):
        return full + best
    # Bins that best fit fills to the last token stay; the search is over the others.
    full += [b for b in best if sum(b) == capacity]
    best = [b for b in best if sum(b) < capacity]
    rest = [x for b in best for x in b]
    total = sum(rest)
    bound = -(-total // capacity)
    counts = np.bincount(rest, minlength=capacity + 1).tolist()
    # Bins so far: largest, its further fillings, the filling taken, waste before it.
    path: list[tuple] = []
    # Sums by the depth at which they were taken, with the pieces left there.
    tables = [(0, len(rest), _sums(counts, capacity))]
    waste, left, budget = 0, len(rest), nodes + len(rest)

    def most() -> int:
        """The free space that a better solution may have."""
        return (len(best) - 1) * capacity - total

    def place(x: int, fills) -> bool:
        """Close the bin of ``x`` with its next filling; False: it has no other."""
        nonlocal waste, left, budget
        for fill in fills:
            budget -= 1
            if fill is not None and waste + capacity - x - sum(fill) <= most():
                path.append((x, fills, fill, waste))
                for v in fill:
                    counts[v] -= 1
                left -= 1 + len(fill)
                waste += capacity - x - sum(fill)
                return True
            if budget <= 0:
                break
        counts[x] += 1
        return False

    def undo() -> bool:
        """Take back bins until one has another filling to try; False: none has."""
        nonlocal waste, left
        while path and budget > 0:
            x, fills, fill, waste = path.pop()
            for v in fill:
                counts[v] += 1
            left += 1 + len(fill)
            while tables[-1][0] > len(path):
                tables.pop()
            if place(x, fills):
                return True
        return False

    while budget > 0:
        if left == 0:
            if len(path) < len(best):
                best = [[x, *fill] for x, _, fill, _ in path]
            if len(best) == bound or not undo():
                break
            continue
        if left * 2 < tables[-1][1]:
            tables.append((len(path), left, _sums(counts, capacity)))
        x = path[-1][0] if path else capacity
        while not counts[x]:
            x -= 1
        counts[x] -= 1
        space, before = capacity - x, waste
        fills = completions(counts, space, tables[-1][2], lambda s=space, w=before: s + w - most())
        if not place(x, fills) and not undo():
            break
    return full + best


def _pack_group(capacity: int, nodes: int, key: list[str], columns: list[str]):
    def pack(table: pa.Table) -> pa.Table:
        order = [("length", "descending")] + [(k, "ascending") for k in key]
        table = table.sort_by(order)
        lengths = table.column("length").to_numpy()
        rows: dict[int, list[int]] = {}
        for row in range(len(lengths) - 1, -1, -1):
            rows.setdefault(int(lengths[row]), []).append(row)
        seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        group = table.column("pack_group")[0].as_py()
        for number, members in enumerate(bin_completion(lengths.tolist(), capacity, nodes)):
            at = 0
            for length in members:
                row = rows[length].pop()
                seq[row], off[row] = (group << 32) + number, at
                at += length
        return (table.select(columns).append_column("sequence_id", pa.array(seq))
                .append_column("offset", pa.array(off)))
    return pack


def pack(pieces: DataFrame, key: list[str], capacity: int = CAPACITY, group: int = GROUP,
         nodes: int = NODES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of at most
    ``capacity``. ``key`` names the columns that put rows of one length in order. Rows are
    written and numbered once before, so that they are counted and dealt without running
    their input twice; they are dealt by their numbers, so groups are even whatever the
    keys are (null, or one id many times)."""
    rows = written(pieces.withColumn("pack_row", F.monotonically_increasing_id()), "pieces")
    n_groups = max(1, -(-rows.count() // group))
    dealt = rows.withColumn("pack_group", F.pmod(F.xxhash64("pack_row"), F.lit(n_groups))).drop("pack_row")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return dealt.groupBy("pack_group").applyInArrow(
        _pack_group(capacity, nodes, key, pieces.columns), f"{schema}, sequence_id bigint, offset bigint")


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids, sequence_id, offset``."""
    return pack(token_pieces(docs, tokenizer_path, capacity), ["doc_id", "piece"], capacity)


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def pack_digests(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY,
                 cached_forms: int = CACHED_FORMS) -> DataFrame:
    """As ``packed_documents`` with the CRC-32 of the ids instead of the ids, taken
    before anything is shuffled or written."""
    pieces = token_pieces(docs, tokenizer_path or default_tokenizer(), capacity, cached_forms=cached_forms)
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")),
                ["doc_id", "piece"], capacity)


def op7_best_fit_packing(spark, sf_dir):
    return pack_digests(read(spark, sf_dir, "documents"))


def ids_crc32(ids) -> int:
    """Reference form of the digest, for tests."""
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())
