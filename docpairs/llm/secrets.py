"""Secret scan by assignment-aware lexing.

Three base patterns give spans of kind ``assign``, ``access`` and ``hex`` (leftmost,
non-overlapping for each kind). Over these the method reads the text as source or
configuration lines: a small lexer finds ``name = literal`` pairs in the common forms
(``=``, ``:``, ``:=``, ``=>``, with an optional type or ``export``; bare, quoted with
escapes and other quotes, triple-quoted, template and block literals, of any length),
keeps the literal each plain name was last bound to, follows ``other = name`` to that literal,
and adds a ``literal`` span when the target's name is sensitive and the literal looks
like a secret, judged on all of it. The inside of a literal is read for statements too.
A plain quote goes over line breaks where no line has a blank in it (keys in armour).
Base spans are never removed.

Offsets count code points, end exclusive. ``redact`` replaces the spans in a table's
texts and leaves documents without spans as they are.

Cases: null text is empty and has no spans; texts of any length are read whole; equal texts have equal spans; rows are independent, so repeated rows
and null ids need no care; other columns of the table are kept unchanged.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_by, read, text_or_empty

#: The base patterns, in the order of the kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")

#: What makes a target's name sensitive, with its weight.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.6, "secret": 1.0, "token": 0.8,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.5, "authorization": 0.7, "bearer": 0.7,
    "private": 0.5, "access": 0.4, "key": 0.5, "signing": 0.4, "salt": 0.4, "cookie": 0.4, "session": 0.3,
}
#: Literals that stand for a value to be filled in.
PLACEHOLDERS = frozenset(["changeme", "example", "none", "null", "password", "placeholder", "redacted", "secret",
                          "test", "todo", "true", "false", "xxxxxx", "yourpassword", "your_password"])
MIN_LITERAL, MIN_SCORE = 6, 1.0

_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: A name is read from the start of its word, so a long word is read once.
_STATEMENT = re.compile(
    r"""(?:(?P<q>["'])(?P<key>[A-Za-z_][A-Za-z0-9_.-]*+)(?P=q)        # the target as a quoted key
          |(?<![A-Za-z0-9_.-])[0-9.-]*+(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+))  # or bare
        (?:\x20*+:\x20*+[A-Za-z_][A-Za-z0-9_]*+(?=\x20*+=[^=]))?      # a type between
        [\x20\t]*+(?::=|=>|=(?![=~>])|:(?![:/]))[\x20\t]*+            # the assignment
        (?:"{3}(?P<t2>(?:[^"\\]|\\[\s\S]|"(?!""))++)"{3}              # a quoted literal
          |'{3}(?P<t1>(?:[^'\\]|\\[\s\S]|'(?!''))++)'{3}
          |"(?P<d>(?:[^"\\\n]|\\[\s\S])++)"
          |'(?P<s>(?:[^'\\\n]|\\[\s\S])++)'
          |`(?P<b>(?:[^`\\]|\\[\s\S])++)`
          |"(?P<dl>(?:-----[A-Z0-9\x20]++-----|[^\s"\\]|\\[\s\S]|[\x20\t\r]*+\n[\x20\t]*+)++)"
          |'(?P<sl>(?:-----[A-Z0-9\x20]++-----|[^\s'\\]|\\[\s\S]|[\x20\t\r]*+\n[\x20\t]*+)++)'
          |(?P<block>(?<=[:\x20\t])[|>][-+0-9]{0,2}[\x20\t]*+(?:\#[^\n]*+)?(?=\r?\n|(?<=\r)\n))  # lines below
          |(?P<bare>[^\s"'`,;(){}\[\]]++))                             # a bare word or another name""",
    re.VERBOSE)
_QUOTED = ("t2", "t1", "d", "s", "b", "dl", "sl")
#: What stands around a literal's value: armour of keys, line breaks with their indent.
_AROUND = re.compile(r"-----(?:BEGIN|END)\x20[A-Z0-9\x20]+-----|[\x20\t\r]*+\n[\x20\t]*+")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the base patterns."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def name_score(name: str) -> float:
    """How sensitive a target's name is: the weights of its words, together."""
    words = [w.lower() for w in _NAME_PARTS.findall(name)]
    score = sum(NAME_WEIGHTS.get(w, 0.0) for w in words)
    return score + sum(0.5 for a, b in zip(words, words[1:]) if (a, b) in {("api", "key"), ("private", "key")})


def entropy(literal: str) -> float:
    """Shannon entropy in bits per character."""
    n = len(literal)
    return -sum(k / n * math.log2(k / n) for k in Counter(literal).values())


def literal_score(literal: str) -> float:
    """0 for a placeholder or prose; more for long, mixed, high-entropy literals."""
    literal = _AROUND.sub("", literal)
    if len(literal) < MIN_LITERAL or literal.lower() in PLACEHOLDERS or " " in literal.strip():
        return 0.0
    kinds = sum(any(map(f, literal)) for f in (str.islower, str.isupper, str.isdigit))
    kinds += not literal.isalnum()
    return min(1.0, entropy(literal) / 4.0) * min(1.0, len(literal) / 12.0) * (0.4 + 0.25 * kinds)


def _block(text: str, name: int, at: int) -> tuple[int, int] | None:
    """The span of the lines below ``at`` that are indented deeper than the name."""
    line = text.rfind("\n", 0, name) + 1
    before = text[line:name]
    base = len(before) if not before.strip(" \t-\"'") else len(before) - len(before.lstrip(" \t"))
    base -= before.endswith(('"', "'"))
    start = end = None
    at = text.find("\n", at) + 1
    while 0 < at < len(text):
        stop = text.find("\n", at)
        row = text[at:stop if stop >= 0 else len(text)]
        words = row.strip()
        if words:
            indent = len(row) - len(row.lstrip())
            if indent <= base:
                break
            if start is None:
                start = at + indent
            end = at + len(row.rstrip())
        at = stop + 1
    return None if start is None else (start, end)


def lexed_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of literals that reach a sensitive name, directly or through constants."""
    found: set[tuple[int, int, int]] = set()
    bound: dict[str, tuple[int, int]] = {}
    scores: dict[tuple[int, int], float] = {}
    m = _STATEMENT.search(text)
    while m:
        group = "name" if m["name"] is not None else "key"
        name, kind = m[group], m.lastgroup
        at = m.span(kind)
        further = at[0] if kind in _QUOTED else m.end()
        if kind == "block":
            at = _block(text, m.start(group), m.end())
        elif kind == "bare" and _IDENTIFIER.match(m["bare"]) and m["bare"] in bound:
            at = bound[m["bare"]]
        if at:
            bound[name] = at
            sensitive = name_score(name)
            if sensitive > 0:
                if at not in scores:
                    scores[at] = literal_score(text[at[0]:at[1]])
                if sensitive + scores[at] >= MIN_SCORE + 0.5:
                    found.add((at[0], 3, at[1]))
        m = _STATEMENT.search(text, further)
    return sorted(found)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans. A literal inside a base span adds nothing."""
    base = base_spans(text)
    if "=" not in text and ":" not in text:
        return base, base
    extra, i, reach = [], 0, -1
    for span in lexed_spans(text):
        while i < len(base) and base[i][0] <= span[0]:
            reach = max(reach, base[i][2])
            i += 1
        if span[2] > reach:
            extra.append(span)
    return base, sorted(base + extra)


def show(spans) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


def redact_text(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span (overlapping ones together) replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in scan(text)[1]:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def secret_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every whole text."""
    def run(batches):
        for batch in batches:
            rows = []
            for t in batch.column(1):
                base, spans = scan(t.as_py())
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((*n, hashlib.sha256(show(base).encode()).hexdigest(), show(spans)))
            a, b, c, digest, spans = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (a, b, c)),
                 pa.array(digest, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text"))
    return src.mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, "
                               "base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced; ``n_chars`` follows where it is a
    column. Texts without secrets (null too) come back unchanged, row for row."""
    @F.pandas_udf("string")
    def clean(texts):
        held_by("secrets")
        return texts.map(lambda t: t if t is None else redact_text(t, mark))

    columns = [F.when(F.col("clean_text").isNull() | (F.col("clean_text") == F.col("doc.text")), F.col(f"doc.`{c}`"))
               .otherwise(F.length("clean_text")).cast(t).alias(c) if c == "n_chars" else
               F.col("clean_text").alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c, t in docs.dtypes]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return row.withColumn("clean_text", clean(F.col("doc.text"))).select(*columns)


def op5_secret_scan(spark, sf_dir):
    return secret_spans(read(spark, sf_dir, "documents"))
