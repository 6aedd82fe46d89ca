"""Byte-level BPE by a lazily determinised finite-state transducer.

Encoding. For every prefix of a pre-token there is exactly one BPE encoding, and a
sequence of tokens is that encoding exactly when each neighbouring pair is: merging the
bytes of the two tokens gives the two tokens back. So the encodings of all prefixes form
a non-deterministic transducer: a hypothesis is the node of the vocabulary's byte trie
reached since the last token boundary, the token before that boundary, and the tokens
not yet emitted. ``Transducer`` runs all live hypotheses at once (subset construction):
a state is the set of hypotheses, a step reads one byte, and what all hypotheses have in
common is emitted. A hypothesis dies when its bytes are no prefix of a token, which
bounds the lookahead by the longest token. States and steps are built when first needed
and kept, up to ``max_states``; then the tables start anew.

Decoding. ``Utf8Stream`` takes chunks of token bytes and gives text: the state is the
incomplete tail (at most three bytes) of the last chunk.

The ids equal those of the tiktoken library for the same ranks and pattern.

Cases: null text is empty (no ids); every byte is a token, so any text can be encoded;
texts of any length are cut at pre-token boundaries and a pre-token is read byte by byte;
ill-formed bytes decode to U+FFFD; a repeated row gives a repeated result.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_by, read, text_or_empty
from .forms import spelled, stem, text_forms

#: Word forms whose ids a worker remembers, and states kept by the transducer.
CACHED_FORMS = 1_000_000
MAX_STATES = 200_000


def load_ranks(lines) -> dict[bytes, int]:
    """Ranks from lines of ``base64(token) rank``."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_by_rank(data: bytes, ranks: dict[bytes, int], below: int = 1 << 60) -> list[bytes]:
    """BPE by definition: merge the leftmost pair of lowest rank until none is under
    ``below``. Only single tokens come here; the transducer does the texts."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """``encode(pre_token) -> ids`` through lazily built deterministic states."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.token = {i: t for t, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.at_node: list[int] = [-1]
        for t, i in ranks.items():
            node = 0
            for b in t:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.at_node.append(-1)
                node = self.children[node][b]
            self.at_node[node] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.spines: dict[tuple[int, bool], list[int]] = {}
        self._reset()

    def _reset(self):
        start = ((0, -1, ()),)
        self.states = [start]
        self.number = {start: 0}
        self.steps: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def _spine(self, token: int, left: bool) -> list[int]:
        """The tokens at the left (or right) edge of ``token`` while it is merged, from
        its first (last) byte up to itself."""
        key = (token, left)
        if key not in self.spines:
            data = self.token[token]
            if len(data) == 1:
                self.spines[key] = [token]
            else:
                parts = merge_by_rank(data, self.ranks, token)
                self.spines[key] = self._spine(self.ranks[parts[0 if left else -1]], left) + [token]
        return self.spines[key]

    def follows(self, left: int, right: int) -> bool:
        """Whether ``right`` may stand after ``left`` (-1: at the start): no merge over
        the boundary comes before the next merge of the tokens that touch it."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is not None:
            return known
        if len(self.pairs) > 8 * self.max_states:
            self.pairs.clear()
        self.pairs[key] = known = left < 0 or self._stays_apart(left, right)
        return known

    def _stays_apart(self, left: int, right: int) -> bool:
        ls, rs = self._spine(left, False), self._spine(right, True)
        i = j = 0
        none = 1 << 60
        while True:
            next_l = ls[i + 1] if i + 1 < len(ls) else none
            next_r = rs[j + 1] if j + 1 < len(rs) else none
            over = self.ranks.get(self.token[ls[i]] + self.token[rs[j]], none)
            if over < next_l and over <= next_r and over < none:
                return False
            if next_l == next_r == none:
                return True
            if next_l <= next_r:
                i += 1
            else:
                j += 1

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        live, boundary = [], None
        for node, before, pending in self.states[state]:
            after = self.children[node].get(byte)
            if after is None:
                continue
            token = self.at_node[after]
            if token >= 0 and boundary is None and self.follows(before, token):
                boundary = (0, token, pending + (token,))
            if self.children[after]:
                live.append((after, before, pending))
        if boundary is None:
            raise ValueError(f"no token for byte {byte}")
        live.append(boundary)
        common = live[0][2]
        for _, _, pending in live[1:]:
            n = 0
            while n < min(len(common), len(pending)) and common[n] == pending[n]:
                n += 1
            common = common[:n]
        # By age of the last boundary: equal sets of hypotheses come in equal order.
        after = tuple([(node, before, pending[len(common):]) for node, before, pending in live])
        if after not in self.number:
            self.number[after] = len(self.states)
            self.states.append(after)
            self.steps.append({})
        self.steps[state][byte] = self.number[after], common
        return self.number[after], common

    def encode(self, pre_token: bytes) -> list[int]:
        whole = self.ranks.get(pre_token)
        if whole is not None:  # the library takes a known pre-token as it is
            return [whole]
        if len(self.states) > self.max_states:
            self._reset()
        state, out, steps = 0, [], self.steps
        for byte in pre_token:
            step = steps[state].get(byte)
            state, emitted = step if step is not None else self._step(state, byte)
            if emitted:
                out.extend(emitted)
        for node, _, pending in self.states[state]:
            if node == 0:
                out.extend(pending)
        return out


class Utf8Stream:
    """Incremental UTF-8 decoder: ``feed`` chunks of bytes, then ``end``."""

    def __init__(self):
        self.tail = b""

    @staticmethod
    def _open(data: bytes) -> int:
        """How many of the last bytes begin a character that is not complete."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b < 0x80:
                return 0
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                return back if need > back and b < 0xF8 else 0
        return 0

    def feed(self, chunk: bytes) -> str:
        data = self.tail + chunk
        keep = self._open(data)
        self.tail = data[len(data) - keep:] if keep else b""
        return data[:len(data) - keep].decode("utf-8", errors="replace")

    def end(self) -> str:
        tail, self.tail = self.tail, b""
        return tail.decode("utf-8", errors="replace")


class Codec:
    """Encoding and decoding of whole texts for one vocabulary and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cached_forms: int = CACHED_FORMS):
        import regex
        self.find = regex.compile(pattern).findall
        self.transducer = Transducer(ranks)
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.token[i] = t
        self.decimal = [str(i) for i in range(len(self.token))]
        self.cached_forms = cached_forms
        self.forms: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _encode(self, piece: str) -> bytes:
        """Ids of a form as unsigned 32-bit numbers."""
        encode = self.transducer.encode
        return array("I", [i for m in self.find(piece) for i in encode(m.encode("utf-8"))]).tobytes()

    def _form(self, form: str) -> bytes:
        """Ids of a form, kept while there is room."""
        bare = stem(form)
        if bare == form:
            ids = self._encode(spelled(form))
        else:
            ids = (self.forms.get(bare) or self._form(bare)) + self._marks(form[len(bare):])
        if len(form) <= 64 and len(self.forms) < self.cached_forms:
            self.forms[form] = ids
        return ids

    def _marks(self, marks: str) -> bytes:
        if marks not in self.marks:
            self.marks[marks] = self._encode(marks)
        return self.marks[marks]

    def encode(self, text: str) -> list[int]:
        """Ids of a text; each distinct form is read once per worker."""
        head, words, newline = text_forms(text)
        ids = list(map(self.forms.get, words))
        if None in ids:
            for i in [i for i, known in enumerate(ids) if known is None]:
                ids[i] = self.forms.get(words[i]) or self._form(words[i])
        out = array("I", self._encode(head) if head else b"")
        out.frombytes(b"".join(ids)[4 * newline:])
        return out.tolist()

    def decode(self, ids: list[int], chunk: int = 65536):
        """The text of ``ids``, piece by piece."""
        stream, token = Utf8Stream(), self.token
        for at in range(0, len(ids), chunk):
            yield stream.feed(b"".join([token[i] for i in ids[at:at + chunk]]))
        yield stream.end()

    def digests(self, text: str) -> tuple[int, str, str]:
        ids = self.encode(text)
        decimal = self.decimal
        of_ids = hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest()
        of_text = hashlib.sha256()
        for part in self.decode(ids):
            of_text.update(part.encode("utf-8"))
        return len(ids), of_ids, of_text.hexdigest()


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process, vocabulary and pattern."""
    held, key = held_by("bpe"), (path, pattern)
    if key not in held:
        with open(path, "rb") as f:
            held[key] = Codec(load_ranks(f), pattern)
    return held[key]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids``: the token ids of every whole text."""
    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = pa.array([c.encode(t.as_py()) for t in part.column(1)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])
    return _source(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give an empty text."""
    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = pa.array(["".join(c.decode(i.as_py() or [])) for i in part.column(1)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), texts], ["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def codec_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode, decode the ids, digest
    both, one document at a time (no ids leave the worker)."""
    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            rows = [c.digests(t.as_py()) for t in batch.column(1)]
            n, of_ids, of_text = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return _source(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text"))


def op8_byte_bpe(spark, sf_dir):
    import public_tokenizers
    return codec_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                         public_tokenizers.PATTERN)
