"""Evaluation queries (M1-M7) over ``eval_pairs`` (two models' predictions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics as M
from ..sources import arrays, fixtures
from ..streaming.streams import scratch
from . import duck as D
from .common import CLEANED_CTE, oracle, valid
from .registry import register


def d_ngrams(t: str, n: int) -> str:
    if n == 1:
        return t
    return (f"(CASE WHEN len({t}) >= {n} THEN list_transform(range(1, len({t}) - {n} + 2), "
            f"lambda i: array_to_string({t}[i:i + {n - 1}], ' ')) ELSE [] END)")


def d_lcs(a: str, b: str) -> str:
    return (f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE list_reduce({a}, lambda prev, x: "
            f"list_reduce(range(1, len({b}) + 1), lambda cur, j: list_append(cur, CASE WHEN {b}[j] = x "
            f"THEN prev[j] + 1 ELSE greatest(prev[j + 1], cur[j]) END), [0]), list_resize([0], len({b}) + 1, 0))[len({b}) + 1] END)")


def d_f(p: str, r: str) -> str:
    return f"(CASE WHEN ({p}) + ({r}) > 0 THEN 2.0 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0.0 END)"


def d_rouge_n(n: int, m: str) -> str:
    p = f"CAST({m} AS DOUBLE) / greatest(len(rp) - {n} + 1, 1)"
    r = f"CAST({m} AS DOUBLE) / greatest(len(rr) - {n} + 1, 1)"
    return d_f(p, r)


def stats_ctes(src: str = "eval_pairs", keys: str = "model, pair_id", lcs: bool = False) -> tuple:
    """Token arrays (ROUGE's stemmed), then per-row statistics, as CTEs ending in ``rs``.
    Clipped matches come from one group by row, order and gram; ``lcs`` adds the longest
    common subsequence by lists (short tables only)."""
    toks = (f"tk0 AS (SELECT {keys}, {D.whitespace_tokens('reference')} AS r, {D.whitespace_tokens('prediction')} AS p, "
            f"{D.rouge_tokens('reference')} AS rr, {D.rouge_tokens('prediction')} AS rp, "
            f"CAST({D.exact_match('reference', 'prediction')} AS INTEGER) AS em FROM {src})")
    each = " UNION ALL ".join(f"SELECT {keys}, '{c}' AS side, unnest({c}) AS token, generate_subscripts({c}, 1) AS pos FROM tk0"
                              for c in ("rr", "rp"))
    of = lambda t: ", ".join(f"{t}.{k}" for k in keys.split(", "))
    stems = (f"tkx AS ({each})", *D.stem_ctes("stems", "SELECT token FROM tkx"),
             f"tks AS (SELECT {keys}, list(stem ORDER BY pos) FILTER (WHERE side = 'rr') AS rr, "
             f"list(stem ORDER BY pos) FILTER (WHERE side = 'rp') AS rp FROM tkx JOIN stems USING (token) GROUP BY {keys})",
             f"tk AS (SELECT {of('tk0')}, r, p, coalesce(tks.rr, []) AS rr, coalesce(tks.rp, []) AS rp, "
             f"tk0.rr AS ur, tk0.rp AS up, em FROM tk0 LEFT JOIN tks USING ({keys}))")
    kinds = [("m", n, "p", "r") for n in (1, 2, 3, 4)] + [("s", n, "rp", "rr") for n in (1, 2)] + [("u", n, "up", "ur") for n in (1, 2)]
    grams = " UNION ALL ".join(f"SELECT {keys}, '{k}{n}' AS what, {side} AS side, unnest({d_ngrams(col, n)}) AS gram FROM tk"
                               for k, n, p, r in kinds for side, col in ((0, p), (1, r)))
    names = [f"{k}{n}" for k, n, _, _ in kinds]
    matched = (f"gr AS (SELECT {keys}, what, gram, count(*) FILTER (WHERE side = 0) AS c, count(*) FILTER (WHERE side = 1) AS rc "
               f"FROM ({grams}) g GROUP BY {keys}, what, gram)",
               f"mt AS (SELECT {keys}, " + ", ".join(f"CAST(coalesce(sum(least(c, rc)) FILTER (WHERE what = '{x}'), 0) AS BIGINT) AS {x}" for x in names)
               + f" FROM gr GROUP BY {keys})")
    cols = [of("tk"), "CAST(len(p) AS BIGINT) AS hyp_len", "CAST(len(r) AS BIGINT) AS ref_len"]
    for n in (1, 2, 3, 4):
        cols.append(f"coalesce(m{n}, 0) AS m{n}")
        cols.append(f"CAST(greatest(len(p) - {n} + 1, 1) AS BIGINT) AS d{n}")
    for n in (1, 2):
        cols.append(f"{d_rouge_n(n, f'coalesce(s{n}, 0)')} AS rouge{n}_f")
        cols.append(f"{d_rouge_n(n, f'coalesce(u{n}, 0)')} AS plain{n}_f")
    cols.append(f"CAST({d_lcs('rp', 'rr')} AS BIGINT) AS lcs" if lcs else "0 AS lcs")
    cols.append("em")
    rs = f"rs0 AS (SELECT {', '.join(cols)}, rp, rr FROM tk LEFT JOIN mt USING ({keys}))"
    rs2 = ("rs AS (SELECT *, CASE WHEN len(rp) = 0 OR len(rr) = 0 THEN 0.0 ELSE "
           f"{d_f('CAST(lcs AS DOUBLE) / len(rp)', 'CAST(lcs AS DOUBLE) / len(rr)')} END AS rougeL_f FROM rs0)")
    return (toks, *stems, *matched, rs, rs2)


def counts_cte(by: str = "model") -> str:
    sums = ", ".join([f"CAST(sum(m{n}) AS BIGINT) AS m{n}" for n in (1, 2, 3, 4)]
                     + [f"CAST(sum(d{n}) AS BIGINT) AS d{n}" for n in (1, 2, 3, 4)])
    return (f"cnt AS (SELECT {by}, {sums}, CAST(sum(hyp_len) AS BIGINT) AS hyp_len, CAST(sum(ref_len) AS BIGINT) AS ref_len, "
            f"avg(rouge1_f) AS rouge1, avg(rouge2_f) AS rouge2, avg(plain1_f) AS plain1, avg(plain2_f) AS plain2, "
            f"avg(rougeL_f) AS rougeL, avg(em) AS em FROM rs GROUP BY {by})")


def d_bleu(k: int) -> str:
    def p(n):
        return f"(CASE WHEN m{n} = 0 THEN 0.1 / d{n} ELSE CAST(m{n} AS DOUBLE) / d{n} END)"
    s = " + ".join(f"ln({p(n)}) / {k}" for n in range(1, k + 1))
    bp = "(CASE WHEN hyp_len > ref_len THEN 1.0 WHEN hyp_len = 0 THEN 0.0 ELSE exp(1.0 - CAST(ref_len AS DOUBLE) / hyp_len) END)"
    return f"round(CASE WHEN m1 = 0 THEN 0.0 ELSE {bp} * exp({s}) * 100 END, 2)"


METRIC_SQL = {f"BLEU-{k}": d_bleu(k) for k in (1, 2, 3, 4)}
METRIC_SQL.update({"ROUGE-1": "round(rouge1 * 100, 2)", "ROUGE-2": "round(rouge2 * 100, 2)",
                   "ROUGE-L": "round(rougeL * 100, 2)", "Exact Match": "round(em * 100, 2)"})


def d_long(metrics, by: str = "model") -> str:
    return " UNION ALL ".join(f"SELECT {by}, '{m}' AS metric, CAST({METRIC_SQL[m]} AS DOUBLE) AS value FROM cnt"
                              for m in metrics)


def _eval(spark, sf_dir):
    return fixtures.view(spark, sf_dir, "eval_pairs")


_CTES = (*stats_ctes(), counts_cte())
_V = ("eval_pairs",)


@register("bleu_counts", oracle(
    "SELECT model, CAST(n AS BIGINT) AS n, matches, total, hyp_len, ref_len FROM ("
    + " UNION ALL ".join(f"SELECT model, {n} AS n, m{n} AS matches, d{n} AS total, hyp_len, ref_len FROM cnt"
                         for n in (1, 2, 3, 4)) + ") x", *_CTES, views=_V))
def q_bleu_counts(spark, sf_dir):
    return M.bleu_counts(_eval(spark, sf_dir))


@register("bleu", oracle(d_long([f"BLEU-{k}" for k in (1, 2, 3, 4)]), *_CTES, views=_V))
def q_bleu(spark, sf_dir):
    return M.evaluate_all(_eval(spark, sf_dir), metrics=[f"BLEU-{k}" for k in (1, 2, 3, 4)])


@register("rouge_n", oracle(d_long(["ROUGE-1", "ROUGE-2"]), *_CTES, views=_V))
def q_rouge_n(spark, sf_dir):
    return M.evaluate_all(_eval(spark, sf_dir), metrics=["ROUGE-1", "ROUGE-2"])


# No oracle where an LCS of whole lines is in it (lists of thousands of tokens are out of
# reach of the SQL engine): tests/test_evaluators.py holds these against brute force.
@register("rouge_l")
def q_rouge_l(spark, sf_dir):
    return M.evaluate_all(_eval(spark, sf_dir), metrics=["ROUGE-L"])


@register("rouge_l_rows")
def q_rouge_l_rows(spark, sf_dir):
    s = M.row_stats(_eval(spark, sf_dir), parts=("rouge_l",))
    return s.select("model", "pair_id", "lcs", F.round("rougeL_f", 6).alias("rougeL_f"))


@register("exact_match", oracle(d_long(["Exact Match"]), *_CTES, views=_V))
def q_exact_match(spark, sf_dir):
    return M.evaluate_all(_eval(spark, sf_dir), metrics=["Exact Match"])


@register("evaluate_all")
def q_evaluate_all(spark, sf_dir):
    return M.evaluate_all(_eval(spark, sf_dir))


@register("compare_models")
def q_compare_models(spark, sf_dir):
    return M.compare_models(M.evaluate_all(_eval(spark, sf_dir)), "alpha", "beta")


# M7: references = docstrings of the valid test pairs, predictions = model alpha's.
_ALIGN = ("refs AS (SELECT pair_id, docstring AS reference FROM valid WHERE split = 'test')",
          "preds AS (SELECT pair_id, prediction FROM eval_pairs WHERE model = 'alpha')",
          "al AS (SELECT coalesce(r.pair_id, p.pair_id) AS pair_id, reference, prediction, "
          "CASE WHEN r.pair_id IS NOT NULL AND p.pair_id IS NOT NULL THEN 'matched' "
          "WHEN r.pair_id IS NOT NULL THEN 'missing_prediction' ELSE 'missing_reference' END AS status "
          "FROM refs r FULL OUTER JOIN preds p ON r.pair_id = p.pair_id)",
          "matched AS (SELECT 'file' AS model, pair_id, reference, prediction FROM al WHERE status = 'matched')")


def _aligned(spark, sf_dir):
    refs = valid(spark, sf_dir, "test").select("pair_id", F.col("docstring").alias("reference"))
    preds = _eval(spark, sf_dir).where(F.col("model") == "alpha").select("pair_id", "prediction")
    return M.align(refs, preds)


@register("align_predictions", oracle(
    "SELECT status, CAST(count(*) AS BIGINT) AS n FROM al GROUP BY status",
    CLEANED_CTE, *_ALIGN, views=("pairs", "eval_pairs")))
def q_align_predictions(spark, sf_dir):
    return _aligned(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@register("evaluate_from_files", oracle(
    f"SELECT metric, value FROM ({d_long(list(M.METRIC_ORDER))}) x",
    CLEANED_CTE, *_ALIGN, *stats_ctes("matched", lcs=True), counts_cte(), views=("pairs", "eval_pairs")))
def q_evaluate_from_files(spark, sf_dir):
    m = _aligned(spark, sf_dir).where(F.col("status") == "matched").withColumn("model", F.lit("file"))
    return M.evaluate_all(m).select("metric", "value")


# Line by line: the docstrings of the valid test pairs against alpha's predictions.
@register("align_by_position", oracle(
    "SELECT coalesce(r.position, p.position) AS position, reference, prediction, "
    "CASE WHEN r.position IS NULL THEN 'missing_reference' WHEN p.position IS NULL THEN 'missing_prediction' ELSE 'matched' END AS status "
    "FROM (SELECT reference, row_number() OVER (ORDER BY pair_id) - 1 AS position FROM refs) r "
    "FULL OUTER JOIN (SELECT prediction, row_number() OVER (ORDER BY pair_id) - 1 AS position FROM preds) p ON r.position = p.position",
    CLEANED_CTE, *_ALIGN[:2], views=("pairs", "eval_pairs")))
def q_align_by_position(spark, sf_dir):
    refs = valid(spark, sf_dir, "test").select("pair_id", F.col("docstring").alias("reference"))
    preds = _eval(spark, sf_dir).where(F.col("model") == "alpha").select("pair_id", "prediction")
    return M.align_by_position(refs, preds, ["pair_id"], ["pair_id"])


# M7 as files give it: two JSON arrays, written in the order of the rows and without ids,
# are aligned element by element.
@register("align_by_place", oracle(
    "SELECT coalesce(r.place, p.place) AS place, reference, prediction, "
    "CASE WHEN r.place IS NULL THEN 'missing_reference' WHEN p.place IS NULL THEN 'missing_prediction' ELSE 'matched' END AS status "
    "FROM (SELECT reference, row_number() OVER (ORDER BY pair_id) - 1 AS place FROM refs) r "
    "FULL OUTER JOIN (SELECT prediction, row_number() OVER (ORDER BY pair_id) - 1 AS place FROM preds) p ON r.place = p.place",
    CLEANED_CTE, *_ALIGN[:2], views=("pairs", "eval_pairs")))
def q_align_by_place(spark, sf_dir):
    def as_file(df, column):
        path = scratch(spark, column)
        rows = df.repartitionByRange(spark.sparkContext.defaultParallelism, "pair_id").sortWithinPartitions("pair_id")
        arrays.save_json_array(rows.select(column), path)
        return arrays.read_json_array(spark, path, f"{column} string")
    refs = valid(spark, sf_dir, "test").select("pair_id", F.col("docstring").alias("reference"))
    preds = _eval(spark, sf_dir).where(F.col("model") == "alpha").select("pair_id", "prediction")
    return M.align_by_place(as_file(refs, "reference"), as_file(preds, "prediction"))


# The distinct ROUGE tokens with their stems.
@register("stem_dim", oracle("SELECT token, stem FROM stems", *stats_ctes()[:-5], views=_V))
def q_stem_dim(spark, sf_dir):
    from ..functions.stem import stem_udf  # imported on use: defines a pandas UDF
    both = F.concat(T.rouge_tokens("reference"), T.rouge_tokens("prediction"))
    toks = _eval(spark, sf_dir).select(F.explode_outer(both).alias("token")).where(F.col("token").isNotNull()).distinct()
    return toks.select("token", stem_udf("token").alias("stem"))


# What stemming does: ROUGE-1 and ROUGE-2 on stemmed and on plain tokens.
@register("rouge_n_stemmed", oracle(
    " UNION ALL ".join(f"SELECT model, 'ROUGE-{n}' AS metric, CAST(round(rouge{n} * 100, 2) AS DOUBLE) AS value, "
                       f"CAST(round(plain{n} * 100, 2) AS DOUBLE) AS plain FROM cnt" for n in (1, 2)), *_CTES, views=_V))
def q_rouge_n_stemmed(spark, sf_dir):
    pairs, names = _eval(spark, sf_dir), ["ROUGE-1", "ROUGE-2"]
    plain = M.evaluate_all(pairs, metrics=names, stem=False).withColumnRenamed("value", "plain")
    return M.evaluate_all(pairs, metrics=names).join(plain, ["model", "metric"])
