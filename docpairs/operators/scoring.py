"""Batch scoring around a user-supplied model.

A *predictor factory* is a picklable callable ``factory(model_type) -> predictor``
where ``predictor(codes: pandas.Series) -> pandas.Series`` of texts (or returns
None when no model is available). It is called once per task, in the prologue of
an iterator ``mapInPandas``, so the model is loaded once per worker process and
reused for every Arrow batch of that task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import EOS_IDX, join_tokens, strip_specials
from ..session import ensure_package_on_workers
from .vocab import decode

# The reference's messages and model names.
KNOWN_MODEL_TYPES = ("codebert", "seq2seq")
DEFAULT_MODEL_TYPE = "codebert"
NO_MODEL_MSG = "Error: No model loaded. Call load_model() first."
UNKNOWN_TYPE_MSG = "Error: Unknown model type."
MAX_GEN_LEN = 128

SCORE_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("model_used", T.StringType()),
    T.StructField("documentation", T.StringType()),
    T.StructField("error", T.StringType()),
])


def no_model(model_type: str):
    """Factory used when no checkpoint is configured: every known type is unloaded."""
    return None


def _score_batches(it, factory, id_col, code_col, type_col, default_type):
    cache = {}
    for pdf in it:
        types = pdf[type_col].fillna(default_type) if type_col else pd.Series([default_type] * len(pdf))
        out = pd.DataFrame({"request_id": pdf[id_col].astype("int64").values, "model_used": types.values,
                            "documentation": None, "error": None})
        for mt in pd.unique(types):
            sel = (types == mt).values
            if mt not in KNOWN_MODEL_TYPES:
                out.loc[sel, "error"] = UNKNOWN_TYPE_MSG
                continue
            if mt not in cache:  # one load per task and model type
                cache[mt] = factory(mt)
            pred = cache[mt]
            if pred is None:
                out.loc[sel, "error"] = NO_MODEL_MSG
                continue
            res = pd.Series(pred(pdf.loc[sel, code_col].reset_index(drop=True)))
            out.loc[sel, "documentation"] = res.values
        yield out


def score(df: DataFrame, factory=no_model, id_col: str = "request_id", code_col: str = "code",
          type_col: str | None = "model_type", default_type: str = DEFAULT_MODEL_TYPE) -> DataFrame:
    """Documentation for each code row. Errors go to ``error`` with a null
    ``documentation``. Works on batch and streaming DataFrames."""
    ensure_package_on_workers(df.sparkSession)
    cols = [id_col, code_col] + ([type_col] if type_col else [])
    return df.select(*cols).mapInPandas(
        lambda it: _score_batches(it, factory, id_col, code_col, type_col, default_type), SCORE_SCHEMA)


def argmax(logits) -> F.Column:
    """0-based index of the first maximum of an array."""
    l = F.col(logits) if isinstance(logits, str) else logits
    return (F.array_position(l, F.array_max(l)) - 1).cast("bigint")


def greedy_decode(steps: DataFrame, vocab: DataFrame, seq_col: str = "seq_id", pos_col: str = "pos",
                  logits_col: str = "logits", max_len: int = MAX_GEN_LEN,
                  known_bound: int | None = None) -> DataFrame:
    """I3 over a table of step logits: argmax per step, keep steps up to and including
    the first EOS and at most ``max_len``; decode with ``vocab``, drop specials, join.

    Steps are 0-based positions, so steps at or beyond ``max_len`` can never be
    kept; they are dropped before the regroup, which therefore holds at most
    ``max_len`` rows per sequence."""
    st = steps.where(F.col(pos_col) < max_len).select(seq_col, pos_col, argmax(logits_col).alias("_tok"))
    seqs = (st.groupBy(seq_col).agg(F.array_sort(F.collect_list(F.struct(pos_col, "_tok"))).alias("_s"))
            .select(seq_col, F.transform("_s", lambda x: x["_tok"]).alias("_ids")))
    cut = F.coalesce(F.nullif(F.array_position("_ids", F.lit(EOS_IDX)), F.lit(0)), F.size("_ids"))
    ids = seqs.select(seq_col, F.slice(F.slice("_ids", 1, cut), 1, max_len).alias("ids"))
    dec = decode(ids, "ids", vocab, id_col=seq_col, out_col="tokens", known_bound=known_bound, keep_ids=True)
    return dec.select(seq_col, "ids", join_tokens(strip_specials("tokens")).alias("text"))
