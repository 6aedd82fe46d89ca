"""All registered queries. Importing the query modules fills the registry."""

from __future__ import annotations

from . import (q_batching, q_extract, q_metrics, q_pairs, q_runlog, q_scoring,  # noqa: F401
               q_streaming, q_tokens, q_vectors, q_vocab, q_whole)
from .registry import ORACLE, QUERIES


def _wrap(name, fn):
    from ..session import ensure_checkpoint_dir, ensure_package_on_workers

    def run(spark, sf_dir):
        ensure_checkpoint_dir(spark)
        ensure_package_on_workers(spark)
        return fn(spark, sf_dir)
    run.__name__ = f"query_{name}"
    run.__doc__ = fn.__doc__
    return run


def queries():
    return {k: _wrap(k, v) for k, v in QUERIES.items()}


def oracle_sql():
    return dict(ORACLE)
