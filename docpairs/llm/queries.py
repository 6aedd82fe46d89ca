"""The registered queries of this subpackage: ``op1`` to ``op13``."""

from __future__ import annotations

from ..session import ensure_checkpoint_dir, ensure_package_on_workers
from . import (ann, bpe, exact_dedup, fingerprint, lm, merkle, minhash, packing, quality, secrets, spelling,
               urlfilter, warc)

_QUERIES = [
    (minhash.op1_minhash_near_dedup, None),
    (fingerprint.op2_order_minhash, None),
    (lm.op3_kneser_ney, None),
    (warc.op4_warc_round_trip, warc.ORACLE_SQL),
    (secrets.op5_secret_scan, None),
    (quality.op6_quality_classifier, None),
    (packing.op7_best_fit_packing, None),
    (bpe.op8_byte_bpe, None),
    (urlfilter.op9_url_filter, None),
    (exact_dedup.op10_exact_dedup, exact_dedup.ORACLE_SQL),
    (spelling.op11_spelling_variants, spelling.ORACLE_SQL),
    (ann.op12_learned_partitions, None),
    (merkle.op13_merkle_manifest, merkle.ORACLE_SQL),
]


def _wrap(fn):
    def run(spark, sf_dir):
        ensure_checkpoint_dir(spark)
        ensure_package_on_workers(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def queries():
    return {fn.__name__: _wrap(fn) for fn, _ in _QUERIES}


def oracle_sql():
    return {fn.__name__: sql for fn, sql in _QUERIES if sql}
