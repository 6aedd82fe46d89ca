"""Evaluation aggregates (M1-M7): corpus BLEU, ROUGE-1/2/L, exact match, model
comparison and alignment of predictions with references.

Per-row statistics are row-local array functions; the only shuffle is the final
``groupBy(model)`` whose partial aggregates run map-side (a handful of sums per
task), so a model holding most rows costs nothing extra.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ngrams as N
from ..functions import overlap as O
from ..functions import text as T
from ..functions.rows import explode_rows
from .index import dense_index

BLEU_ORDERS = (1, 2, 3, 4)
BLEU_EPSILON = 0.1  # smoothing "method 1": 0 matches -> epsilon / count
METRIC_ORDER = ("BLEU-1", "BLEU-2", "BLEU-3", "BLEU-4", "ROUGE-1", "ROUGE-2", "ROUGE-L", "Exact Match")


PARTS = ("bleu", "rouge_n", "rouge_l", "exact")


def parts_of(metrics) -> tuple:
    """The statistics of a row that ``metrics`` are made of."""
    kinds = {"BLEU": "bleu", "Exact Match": "exact", "ROUGE-L": "rouge_l", "ROUGE-1": "rouge_n", "ROUGE-2": "rouge_n"}
    return tuple(dict.fromkeys(kinds.get(m, kinds.get(m.split("-")[0])) for m in metrics))


def row_stats(df: DataFrame, ref_col: str = "reference", pred_col: str = "prediction",
              keys=("model", "pair_id"), stem: bool = True, parts=PARTS) -> DataFrame:
    """Per row, as far as ``parts`` asks for it: BLEU clipped matches m1..m4, denominators
    d1..d4 and lengths, ROUGE-1/2 and ROUGE-L F-measures (on stemmed tokens by default),
    ``lcs`` and the exact-match flag."""
    keys = list(keys)
    base = df.select(*keys, T.whitespace_tokens(ref_col).alias("_r"), T.whitespace_tokens(pred_col).alias("_p"),
                     T.rouge_tokens(ref_col).alias("_rr"), T.rouge_tokens(pred_col).alias("_rp"),
                     T.exact_match(ref_col, pred_col).alias("_em"))
    # All counts of a row come from one call, in a projection of its own, so each is
    # worked out once per row.
    counts = O.row_counts("_p", "_r", "_rp", "_rr", BLEU_ORDERS if "bleu" in parts else (), (1, 2) if "rouge_n" in parts else (),
                          "rouge_l" in parts, stem)
    over = base.select("*", counts.alias("_c"))
    n_p, n_r = F.size("_rp"), F.size("_rr")
    cols = list(keys)
    if "bleu" in parts:
        cols += [F.size("_p").cast("bigint").alias("hyp_len"), F.size("_r").cast("bigint").alias("ref_len")]
        for n in BLEU_ORDERS:
            cols.append(F.col("_c.bleu")[n - 1].alias(f"m{n}"))
            cols.append(F.greatest(F.size("_p") - n + 1, F.lit(1)).cast("bigint").alias(f"d{n}"))
    if "rouge_n" in parts:
        for n in (1, 2):
            m = F.col("_c.rouge")[n - 1]
            cols.append(N.fmeasure(m / F.greatest(n_p - n + 1, F.lit(1)), m / F.greatest(n_r - n + 1, F.lit(1))).alias(f"rouge{n}_f"))
    if "rouge_l" in parts:
        common = F.col("_c.lcs")
        cols += [common.alias("lcs"), F.when((n_p == 0) | (n_r == 0), F.lit(0.0))
                 .otherwise(N.fmeasure(F.try_divide(common, n_p), F.try_divide(common, n_r))).alias("rougeL_f")]
    if "exact" in parts:
        cols.append(F.col("_em").cast("int").alias("em"))
    return over.select(*cols)


def corpus_counts(stats: DataFrame, by=("model",)) -> DataFrame:
    """Sums per group of the statistics that ``stats`` has: BLEU numerators, denominators
    and lengths, ROUGE and EM means."""
    sums = [f"{k}{n}" for k in "md" for n in BLEU_ORDERS] + ["hyp_len", "ref_len"]
    means = {"rouge1_f": "rouge1", "rouge2_f": "rouge2", "rougeL_f": "rougeL", "em": "em"}
    aggs = [F.sum(c).cast("bigint").alias(c) for c in sums if c in stats.columns]
    aggs += [F.avg(c).alias(name) for c, name in means.items() if c in stats.columns]
    return stats.groupBy(*by).agg(*aggs, F.count(F.lit(1)).cast("bigint").alias("n_rows"))


def _bleu_k(k: int) -> Column:
    """Corpus BLEU-k (uniform weights over orders 1..k), x100, from the count columns."""
    def p(n):
        m, d = F.col(f"m{n}"), F.col(f"d{n}")
        return F.when(m == 0, F.lit(BLEU_EPSILON) / d).otherwise(m / d)
    hyp, ref = F.col("hyp_len"), F.col("ref_len")
    bp = (F.when(hyp > ref, F.lit(1.0)).when(hyp == 0, F.lit(0.0))
          .otherwise(F.exp(F.lit(1.0) - ref / hyp)))
    s = reduce(lambda a, b: a + b, [F.log(p(n)) / k for n in range(1, k + 1)])
    return F.when(F.col("m1") == 0, F.lit(0.0)).otherwise(bp * F.exp(s) * 100)


def metric_column(name: str) -> Column:
    """A metric from the corpus counts (x100, two decimals, HALF_UP)."""
    if name.startswith("BLEU-"):
        return F.round(_bleu_k(int(name[5:])), 2)
    return F.round(F.col({"ROUGE-1": "rouge1", "ROUGE-2": "rouge2", "ROUGE-L": "rougeL", "Exact Match": "em"}[name]) * 100, 2)


def evaluate_all(df: DataFrame, ref_col: str = "reference", pred_col: str = "prediction",
                 by=("model",), keys=("model", "pair_id"), metrics=METRIC_ORDER,
                 stem: bool = True) -> DataFrame:
    """M5: long table (by..., metric, value) of all metrics in one pass."""
    counts = corpus_counts(row_stats(df, ref_col, pred_col, keys, stem, parts_of(metrics)), by)
    wide = counts.select(*by, *[metric_column(m).alias(m) for m in metrics])
    return wide.unpivot(list(by), list(metrics), "metric", "value")


def bleu_counts(df: DataFrame, by=("model",)) -> DataFrame:
    """M1 counts: (model, n, matches, total, hyp_len, ref_len)."""
    counts = corpus_counts(row_stats(df, parts=("bleu",)), by)
    arms = [F.struct(F.lit(n).cast("bigint").alias("n"), F.col(f"m{n}").alias("matches"),
                     F.col(f"d{n}").alias("total")) for n in BLEU_ORDERS]
    return (counts.select(*by, "hyp_len", "ref_len", F.inline(F.array(*arms)))
            .select(*by, "n", "matches", "total", "hyp_len", "ref_len"))


def compare_models(long: DataFrame, name1: str, name2: str) -> DataFrame:
    """M6: metric, value of each model, winner (strict > for the first; ties -> second)."""
    wide = long.groupBy("metric").pivot("model", [name1, name2]).agg(F.first("value"))
    return wide.withColumn("winner", F.when(F.col(name1) > F.col(name2), F.lit(name1)).otherwise(F.lit(name2)))


def align(refs: DataFrame, preds: DataFrame, key: str = "pair_id") -> DataFrame:
    """M7 alignment by id: a full outer join with the match status of every id."""
    r = refs.select(key, F.col("reference"), F.lit(True).alias("_r"))
    p = preds.select(key, F.col("prediction"), F.lit(True).alias("_p"))
    j = r.join(p, key, "full_outer")
    status = (F.when(F.col("_r") & F.col("_p"), F.lit("matched"))
              .when(F.col("_r"), F.lit("missing_prediction")).otherwise(F.lit("missing_reference")))
    return j.select(key, "reference", "prediction", status.alias("status"))


def align_by_position(refs: DataFrame, preds: DataFrame, order_refs: list, order_preds: list) -> DataFrame:
    """M7 alignment of two files line by line: the n-th reference with the n-th
    prediction. Both sides get a dense global index; what one side has more is reported."""
    r = dense_index(refs, order_refs, "position").select("position", "reference")
    p = dense_index(preds, order_preds, "position").select("position", "prediction")
    return align(r, p, "position")


def align_by_place(refs: DataFrame, preds: DataFrame) -> DataFrame:
    """M7 alignment of two files by the rows' places in them (``place``, as the readers in
    ``sources.arrays`` and ``sources.places`` give it): no ids and no sort of the rows."""
    return align(refs.select("place", "reference"), preds.select("place", "prediction"), "place")


def long_text_counts(df: DataFrame, ref_tokens: str, pred_tokens: str, keys=("model", "pair_id"),
                     orders=BLEU_ORDERS, stem: bool = False) -> DataFrame:
    """Clipped n-gram matches for rows of any length: (keys..., n, matches, total,
    hyp_len, ref_len) per row and order, row-local: one linear pass and no shuffle."""
    keys = list(keys)
    base = df.select(*keys, F.size(pred_tokens).alias("hyp_len"), F.size(ref_tokens).alias("ref_len"),
                     O.clipped_overlaps(pred_tokens, ref_tokens, orders, stem).alias("_m"))
    arms = [F.struct(F.lit(n).cast("bigint").alias("n"), F.col("_m")[i].alias("matches")) for i, n in enumerate(orders)]
    return (base.select(*keys, "hyp_len", "ref_len", F.inline(F.array(*arms)))
            .select(*keys, "n", "matches",
                    F.greatest(F.col("hyp_len") - F.col("n") + 1, F.lit(1)).cast("bigint").alias("total"),
                    F.col("hyp_len").cast("bigint").alias("hyp_len"), F.col("ref_len").cast("bigint").alias("ref_len")))


def long_text_counts_exploded(df: DataFrame, ref_tokens: str, pred_tokens: str, keys=("model", "pair_id"),
                              orders=BLEU_ORDERS) -> DataFrame:
    """Clipped n-gram matches for rows of any length: (keys..., n, matches, total,
    hyp_len, ref_len) per row and order.

    The row-local form scans a row once per common gram, which is quadratic in the
    row; here both sides' grams are exploded and counted per (row, n, gram) in one
    aggregate, and min(count) is summed back per (row, n). The shuffle is keyed by
    row and gram, so a long row spreads over tasks and no group is larger than one
    gram of one row; repeated grams combine map-side."""
    keys = list(keys)
    # Both sides in one explode: side 0 = prediction, 1 = reference. One aggregate
    # keyed by (row, n, gram) yields both counts, so a single shuffle replaces two
    # aggregates and a join.
    arms = [F.struct(F.lit(side).alias("side"), F.lit(n).alias("n"), N.ngrams(col, n).alias("g"))
            for side, col in ((0, pred_tokens), (1, ref_tokens)) for n in orders]
    ex = explode_rows(df.select(*keys, F.inline(F.array(*arms))), [*keys, "side", "n"], F.col("g"), "gram")
    per_gram = ex.groupBy(*keys, "n", "gram").agg(F.count_if(F.col("side") == 0).alias("c"),
                                                   F.count_if(F.col("side") == 1).alias("rc"))
    m = per_gram.groupBy(*keys, "n").agg(F.sum(F.least("c", "rc")).cast("bigint").alias("matches"))
    lens = df.select(*keys, F.size(pred_tokens).alias("hyp_len"), F.size(ref_tokens).alias("ref_len"),
                     F.explode(F.array(*[F.lit(n) for n in orders])).alias("n"))
    return (lens.join(m, [*keys, "n"], "left")
            .select(*keys, F.col("n").cast("bigint").alias("n"),
                    F.coalesce("matches", F.lit(0)).cast("bigint").alias("matches"),
                    F.greatest(F.col("hyp_len") - F.col("n") + 1, F.lit(1)).cast("bigint").alias("total"),
                    F.col("hyp_len").cast("bigint").alias("hyp_len"), F.col("ref_len").cast("bigint").alias("ref_len")))


def bleu_from_long_counts(counts: DataFrame, by=("model",)) -> DataFrame:
    """Corpus BLEU-1..4 (model, metric, value) from per-row long-text counts."""
    wide = counts.groupBy(*by).agg(
        *[F.sum(F.when(F.col("n") == n, F.col("matches"))).cast("bigint").alias(f"m{n}") for n in BLEU_ORDERS],
        *[F.sum(F.when(F.col("n") == n, F.col("total"))).cast("bigint").alias(f"d{n}") for n in BLEU_ORDERS],
        F.sum(F.when(F.col("n") == 1, F.col("hyp_len"))).cast("bigint").alias("hyp_len"),
        F.sum(F.when(F.col("n") == 1, F.col("ref_len"))).cast("bigint").alias("ref_len"))
    names = [f"BLEU-{k}" for k in BLEU_ORDERS]
    return (wide.select(*by, *[F.round(_bleu_k(k), 2).alias(nm) for k, nm in zip(BLEU_ORDERS, names)])
            .unpivot(list(by), names, "metric", "value"))
