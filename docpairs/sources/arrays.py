"""Files that hold one JSON array of objects, read and written by many tasks.

Such a file has no line per object, so a task that starts in its middle does not know
whether it stands inside a string, nor how deep. The file is read in pieces that end at
``}`` (Spark's text reader splits files at any separator), and in two passes:

1. Each split works out what it does to either possible start, outside or inside a
   string: where it ends, and how far brackets open and close in it, in all and at
   lowest. (A split begins behind a ``}``, which no valid string escapes, so there is no
   third start.) These tables of two rows compose, so a running composition along a file,
   one row per split, tells the true start of every split.
2. Each split cuts out its objects from its true start. An object that runs on into later
   splits is left as fragments, which are put together by the split where it begins.

So an array of any size is read by as many tasks as it has splits, whatever its line
breaks, nesting, quotes and escapes. Objects keep their place in the array. Elements that
are no objects are skipped. ``file_states`` reports files whose array does not end as it
should (cut off, or no array); their whole objects are still read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .places import number_rows, split_columns

# A whole string, or one that the text's end cuts off (the group is empty then).
_STRING = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+("|\Z)', re.S)
_STRING_END = re.compile(r'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)
_MARK = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+("|\Z)|[{}\[\]]', re.S)
_STEP = np.zeros(256, np.int64)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1


# ------------------------------------------------------------------ what a text does to a state
def effect(text: str, inside: bool) -> tuple[bool, int, int]:
    """``(inside a string at the end, change of depth, lowest depth on the way)`` of a
    text that starts outside or ``inside`` a string, depths counted from its start."""
    at = 0
    if inside:
        end = _STRING_END.match(text)
        if not end:
            return True, 0, 0
        at = end.end()
    open_end = False

    def blank(m):
        nonlocal open_end
        open_end = open_end or not m[1]
        return ""
    bare = _STRING.sub(blank, text[at:] if at else text)
    steps = np.cumsum(_STEP[np.frombuffer(bare.encode("utf-8"), np.uint8)])
    return open_end, int(steps[-1]) if len(steps) else 0, int(min(steps.min(), 0)) if len(steps) else 0


def then(first: tuple, second: dict) -> tuple:
    """``first`` followed by a text with the effects ``second`` (by start state)."""
    inside, change, low = first
    end, more, lower = second[inside]
    return end, change + more, min(low, change + lower)


class Objects:
    """Cuts the objects out of a split's text, given piece by piece from a known state."""

    def __init__(self, inside: bool, depth: int):
        self.inside, self.depth, self.parts = inside, depth, []
        self.carried = self.open = depth >= 2    # an object of an earlier split is open

    def feed(self, text: str):
        """``(object, whether it began in an earlier split)`` for those that end in ``text``."""
        at = 0
        if self.inside:
            end = _STRING_END.match(text)
            if not end:
                if self.open:
                    self.parts.append(text)
                return
            at, self.inside = end.end(), False
        start = 0 if self.open else None
        for m in _MARK.finditer(text, at):
            mark = text[m.start()]
            if mark == '"':
                self.inside = not m[1]
            elif mark in "{[":
                self.depth += 1
                if self.depth == 2:
                    start = m.start() if mark == "{" else None
                    self.parts = []
            else:
                self.depth -= 1
                if self.depth <= 1:
                    if self.depth == 1 and mark == "}" and start is not None:
                        yield "".join(self.parts) + text[start:m.end()], self.carried
                    start, self.parts, self.carried = None, [], False
        self.open = start is not None
        if self.open:
            self.parts.append(text[start:])


# ------------------------------------------------------------------ pass 1: the splits' starts
def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "}").text(path).select("value", *split_columns(), F.col("_metadata.file_size").alias("size"))


def _runs(batch):
    """Consecutive rows of one split: ``(file, split start, text)``, each text ending in }."""
    files, starts, values = batch.column("file").to_pylist(), batch.column("split_start").to_pylist(), batch.column("value").to_pylist()
    at = 0
    while at < len(values):
        end = at + 1
        while end < len(values) and starts[end] == starts[at] and files[end] == files[at]:
            end += 1
        yield at, files[at], starts[at], "}".join(values[at:end]) + "}"
        at = end


def _effects(batches):
    now, known, read, size = None, None, 0, 0

    def row():
        values = [*now, *known[False], *known[True], read, size]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _EFFECTS_ARROW.types)], schema=_EFFECTS_ARROW)

    for batch in batches:
        for at, file, start, text in _runs(batch):
            if (file, start) != now:
                if now is not None:
                    yield row()
                now, known, read = (file, start), {False: (False, 0, 0), True: (True, 0, 0)}, 0
            read, size = read + len(text.encode("utf-8")), batch.column("size")[at].as_py()
            here = {s: effect(text, s) for s in (False, True)}
            known = {s: then(known[s], here) for s in (False, True)}
    if now is not None:
        yield row()


_EFFECTS = ("file string, split_start bigint, out_ends_in boolean, out_change bigint, out_low bigint, "
            "in_ends_in boolean, in_change bigint, in_low bigint, read bigint, size bigint")
_EFFECTS_ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[c.split()[1]])
                            for c in _EFFECTS.split(", ")])
_STARTS = "file string, split_start bigint, inside boolean, depth bigint, owner bigint, end_inside boolean, end_depth bigint, read bigint, size bigint"


def _starts(pdf: pd.DataFrame) -> pd.DataFrame:
    """The true start of each split of one file (one row per split): the composition of
    what stands before it, and the split in which the object open there began."""
    inside, depth, owner, out = False, 0, None, []
    for r in pdf.sort_values("split_start").itertuples():
        end, change, low = (r.in_ends_in, r.in_change, r.in_low) if inside else (r.out_ends_in, r.out_change, r.out_low)
        began = (inside, depth, owner)
        if depth < 2 or depth + low < 2:
            owner = r.split_start    # what is open at the end began here
        inside, depth = bool(end), depth + change
        out.append((r.file, r.split_start, *began, inside, depth, r.read, r.size))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _STARTS.split(", ")]).astype({"owner": "Int64"})


def split_states(spark: SparkSession, path: str) -> DataFrame:
    """One row per split: the state at its start and end."""
    seen = materialize(_pieces(spark, path).mapInArrow(_effects, _EFFECTS), "array-effects")
    return materialize(seen.groupBy("file").applyInPandas(_starts, _STARTS), "array-starts")


def file_states(states: DataFrame) -> DataFrame:
    """``file, whole, patched``: whether the file's array was closed at its end, and whether
    its last object owes its ``}`` to the reader. (A ``}`` is counted behind every piece,
    also behind the file's last one. Behind a closed array it takes the depth below zero.)"""
    last = states.groupBy("file").agg(F.max_by(F.struct("end_inside", "end_depth"), "split_start").alias("end"),
                                      (F.sum("read") > F.max("size")).alias("added"))
    closed = ~F.col("end.end_inside") & (F.col("end.end_depth") == -1) & F.col("added")
    return last.select("file", closed.alias("whole"), (F.col("added") & ~F.col("end.end_inside") & (F.col("end.end_depth") == 1)).alias("patched"))


# ------------------------------------------------------------------ pass 2: the objects
_CUT = "file string, split_start bigint, seq bigint, owner bigint, whole boolean, text string"
_CUT_ARROW = pa.schema([("file", pa.string()), ("split_start", pa.int64()), ("seq", pa.int64()), ("owner", pa.int64()),
                        ("whole", pa.bool_()), ("text", pa.string())])


def _cut(batches):
    now, objects, owner, seq, begun = None, None, None, 0, False

    def rest():
        """What the split leaves open: the start of an object, or a middle piece."""
        if objects.parts:
            own = now[1] if not objects.carried else owner
            return [(now[0], now[1], seq, own, False, "".join(objects.parts))]
        return []

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), _CUT_ARROW.types)], schema=_CUT_ARROW)

    for batch in batches:
        inside, depth, owners = (batch.column(c) for c in ("inside", "depth", "owner"))
        for at, file, start, text in _runs(batch):
            rows = []
            if (file, start) != now:
                rows += rest() if now is not None else []
                now, seq = (file, start), 0
                objects, owner = Objects(inside[at].as_py(), depth[at].as_py()), owners[at].as_py()
            for found, carried in objects.feed(text):
                if carried:   # the end of an object that began in an earlier split
                    rows.append((file, start, -1, owner, False, found))
                else:
                    rows.append((file, start, seq, start, True, found))
                    seq += 1
            if rows:
                yield batch_of(rows)
    if now is not None and (rows := rest()):
        yield batch_of(rows)


def array_objects(spark: SparkSession, path: str, states: DataFrame | None = None) -> DataFrame:
    """``text, file, place, place_in_file``: every object of the arrays as its JSON text,
    with its place."""
    states = split_states(spark, path) if states is None else states
    # One row per split, so the states are as many as the input has splits.
    told = _pieces(spark, path).join(F.broadcast(states.select("file", "split_start", "inside", "depth", "owner")), ["file", "split_start"])
    cut = materialize(told.select("file", "split_start", "value", "inside", "depth", "owner").mapInArrow(_cut, _CUT), "array-objects")
    whole = cut.where("whole").select("file", "split_start", "seq", "text")
    parts = cut.where("NOT whole").groupBy("file", F.col("owner").alias("split_start")).agg(
        F.array_sort(F.collect_list(F.struct("split_start", "text"))).alias("parts"), F.max(F.when(F.col("owner") == F.col("split_start"), F.col("seq"))).alias("seq"))
    joined = F.array_join(F.col("parts.text"), "")
    # An object that no split ends is no JSON; ``parsed`` would give nulls for it.
    ends = F.try_parse_json(joined).isNotNull()
    mended = parts.select("file", "split_start", "seq", joined.alias("text")).where(ends & F.col("seq").isNotNull())
    objects = number_rows(materialize(whole.unionByName(mended), "array-placed"))
    patched = file_states(states).where("patched").select("file")
    if not patched.limit(1).count():
        return objects
    # A file cut off inside its last object: that one is not whole.
    last = objects.join(patched, "file").groupBy("file").agg(F.max("place_in_file").alias("place_in_file"))
    return objects.join(last, ["file", "place_in_file"], "left_anti").select(objects.columns)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The objects of JSON-array files as rows of ``schema``, with ``file``, ``place`` and
    ``place_in_file``. Missing fields are null, others are left out."""
    objects = array_objects(spark, path)
    parsed = objects.select(F.from_json("text", schema).alias("row"), "file", "place", "place_in_file")
    return parsed.select("row.*", "file", "place", "place_in_file")


# ------------------------------------------------------------------ writing
def save_json_array(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write a JSON array per partition of ``df``, in the order of its rows, as a stream of
    lines: a file is never one string, whatever its size. Partitions without rows give no file."""
    def framed(batches):
        first = True
        for batch in batches:
            if batch.num_rows:
                lines = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([("[" if first and i == 0 else ",") + x for i, x in enumerate(lines)], pa.string())], ["value"])
                first = False
        if not first:
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], ["value"])

    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    rows.mapInArrow(framed, "value string").write.mode(mode).text(path)
    return path
