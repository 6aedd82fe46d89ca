"""The operators on whole documents: each ``documents.text`` (1 to 20,000 words) is
cleaned, judged, tokenised, counted and scored as one text, with no prefix taken."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ngrams import fmeasure
from ..operators import cleaning
from ..operators import metrics as M
from ..operators import vocab as V
from ..sources import fixtures
from . import duck as D
from .common import oracle
from .q_metrics import d_bleu, d_ngrams
from .registry import register


def _docs(spark, sf_dir):
    return fixtures.spread(fixtures.table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


_WHOLE = (f"wc AS (SELECT doc_id, lang, {D.clean_code('text')} AS code, {D.clean_docstring('text')} AS docstring "
          "FROM documents)",
          f"wr AS (SELECT *, {D.reject_reason('code', 'docstring')} AS reason FROM wc)")


@register("whole_text_reject_reasons", oracle(
    "SELECT lang, coalesce(reason, 'kept') AS reason, CAST(count(*) AS BIGINT) AS n FROM wr GROUP BY 1, 2",
    *_WHOLE, views=()))
def q_whole_text_reject_reasons(spark, sf_dir):
    # The whole text plays both sides: cleaned as code and as a docstring.
    return cleaning.reject_reason_counts(_docs(spark, sf_dir), by=("lang",), code_col="text", doc_col="text")


@register("whole_text_token_freq", oracle(
    "SELECT token, CAST(count(*) AS BIGINT) AS freq, CAST(min({'p': doc_id, 'q': pos}).p AS BIGINT) AS first_id, "
    "CAST(min({'p': doc_id, 'q': pos}).q AS BIGINT) AS first_pos FROM "
    f"(SELECT doc_id, unnest(tk) AS token, generate_subscripts(tk, 1) - 1 AS pos FROM "
    f"(SELECT doc_id, {D.tokenize_text(D.clean_docstring('text'))} AS tk FROM documents) a) b GROUP BY token",
    views=()))
def q_whole_text_token_freq(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", T.tokenize_text(T.clean_docstring("text")).alias("tokens"))
    f = V.token_freq(d, "tokens", id_col="doc_id")
    return f.select("token", "freq", F.col("first.id").alias("first_id"), F.col("first.pos").alias("first_pos"))


@register("whole_text_code_vocab", oracle(
    "SELECT token, CAST(row_number() OVER (ORDER BY freq DESC, first) + 3 AS BIGINT) AS idx, freq FROM ("
    " SELECT token, CAST(count(*) AS BIGINT) AS freq, min({'p': doc_id, 'q': pos}) AS first FROM"
    f" (SELECT doc_id, unnest(tk) AS token, generate_subscripts(tk, 1) - 1 AS pos FROM"
    f"  (SELECT doc_id, {D.tokenize_code(D.clean_code('text'))} AS tk FROM documents) a) b"
    " GROUP BY token HAVING count(*) >= 2 ORDER BY freq DESC, first LIMIT 34996) c"
    " WHERE token NOT IN ('<PAD>', '<SOS>', '<EOS>', '<UNK>')"
    " UNION ALL SELECT '<PAD>', 0, 0 UNION ALL SELECT '<SOS>', 1, 0 UNION ALL SELECT '<EOS>', 2, 0 UNION ALL SELECT '<UNK>', 3, 0",
    views=()))
def q_whole_text_code_vocab(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", T.tokenize_code(T.clean_code("text")).alias("tokens"))
    return V.build_vocab(V.token_freq(d, "tokens", id_col="doc_id"), 2, 35000)


def _whole_eval(spark, sf_dir):
    e = fixtures.view(spark, sf_dir, "eval_whole")
    return e.select("model", "pair_id", T.whitespace_tokens("reference").alias("r"),
                    T.whitespace_tokens("prediction").alias("p"),
                    T.rouge_tokens("reference").alias("rr"), T.rouge_tokens("prediction").alias("rp"))


def _d_long(ref: str, pred: str, orders, name: str) -> tuple:
    grams = lambda col: " UNION ALL ".join(
        f"SELECT model, pair_id, {n} AS n, unnest({d_ngrams(col, n)}) AS gram FROM wt" for n in orders)
    return (f"{name}_p AS (SELECT model, pair_id, n, gram, count(*) AS c FROM ({grams(pred)}) x GROUP BY ALL)",
            f"{name}_r AS (SELECT model, pair_id, n, gram, count(*) AS c FROM ({grams(ref)}) x GROUP BY ALL)",
            f"{name}_m AS (SELECT p.model, p.pair_id, p.n, sum(least(p.c, r.c)) AS matches FROM {name}_p p "
            f"JOIN {name}_r r USING (model, pair_id, n, gram) GROUP BY ALL)",
            f"{name} AS (SELECT w.model, w.pair_id, CAST(k.n AS BIGINT) AS n, CAST(coalesce(m.matches, 0) AS BIGINT) AS matches, "
            f"CAST(greatest(len(w.{pred}) - k.n + 1, 1) AS BIGINT) AS total, CAST(len(w.{pred}) AS BIGINT) AS hyp_len, "
            f"CAST(len(w.{ref}) AS BIGINT) AS ref_len FROM wt w CROSS JOIN (SELECT unnest({list(orders)}) AS n) k "
            f"LEFT JOIN {name}_m m ON m.model = w.model AND m.pair_id = w.pair_id AND m.n = k.n)")


_WT = (f"wt AS (SELECT model, pair_id, {D.whitespace_tokens('reference')} AS r, {D.whitespace_tokens('prediction')} AS p, "
       f"{D.rouge_tokens('reference')} AS rr, {D.rouge_tokens('prediction')} AS rp FROM eval_whole)",)
_BLEU_LONG = _WT + _d_long("r", "p", (1, 2, 3, 4), "bl")


@register("whole_text_bleu_counts", oracle(
    "SELECT model, n, CAST(sum(matches) AS BIGINT) AS matches, CAST(sum(total) AS BIGINT) AS total, "
    "CAST(sum(hyp_len) AS BIGINT) AS hyp_len, CAST(sum(ref_len) AS BIGINT) AS ref_len FROM bl GROUP BY model, n",
    *_BLEU_LONG, views=("eval_whole",)))
def q_whole_text_bleu_counts(spark, sf_dir):
    c = M.long_text_counts(_whole_eval(spark, sf_dir), "r", "p")
    return c.groupBy("model", "n").agg(*[F.sum(x).cast("bigint").alias(x) for x in ("matches", "total", "hyp_len", "ref_len")])


def _d_bleu_long() -> str:
    cnt = ("SELECT model, " + ", ".join(
        [f"sum(CASE WHEN n = {n} THEN matches END) AS m{n}" for n in (1, 2, 3, 4)]
        + [f"sum(CASE WHEN n = {n} THEN total END) AS d{n}" for n in (1, 2, 3, 4)]
        + ["sum(CASE WHEN n = 1 THEN hyp_len END) AS hyp_len", "sum(CASE WHEN n = 1 THEN ref_len END) AS ref_len"])
        + " FROM bl GROUP BY model")
    return " UNION ALL ".join(f"SELECT model, 'BLEU-{k}' AS metric, CAST({d_bleu(k)} AS DOUBLE) AS value FROM ({cnt}) c"
                              for k in (1, 2, 3, 4))


@register("whole_text_bleu", oracle(_d_bleu_long(), *_BLEU_LONG, views=("eval_whole",)))
def q_whole_text_bleu(spark, sf_dir):
    return M.bleu_from_long_counts(M.long_text_counts(_whole_eval(spark, sf_dir), "r", "p"))


_ROUGE_LONG = _WT + _d_long("rr", "rp", (1, 2), "rg")


@register("whole_text_rouge_n", oracle(
    "SELECT model, CASE WHEN n = 1 THEN 'ROUGE-1' ELSE 'ROUGE-2' END AS metric, "
    "CAST(round(avg(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END) * 100, 2) AS DOUBLE) AS value FROM "
    "(SELECT model, n, CAST(matches AS DOUBLE) / total AS pr, CAST(matches AS DOUBLE) / greatest(ref_len - n + 1, 1) AS rc "
    "FROM rg) x GROUP BY model, n", *_ROUGE_LONG, views=("eval_whole",)))
def q_whole_text_rouge_n(spark, sf_dir):
    c = M.long_text_counts(_whole_eval(spark, sf_dir), "rr", "rp", orders=(1, 2))
    pr = F.col("matches") / F.col("total")
    rc = F.col("matches") / F.greatest(F.col("ref_len") - F.col("n") + 1, F.lit(1))
    per = c.select("model", "n", fmeasure(pr, rc).alias("f"))
    return (per.groupBy("model", "n").agg(F.round(F.avg("f") * 100, 2).alias("value"))
            .select("model", F.when(F.col("n") == 1, "ROUGE-1").otherwise("ROUGE-2").alias("metric"), "value"))


# ROUGE-L and the whole report on whole documents: no oracle (an LCS of 20,000 words is
# out of reach of the SQL engine's lists); the tests hold the functions against a plain
# dynamic programme.
@register("whole_text_rouge_l")
def q_whole_text_rouge_l(spark, sf_dir):
    return M.evaluate_all(fixtures.view(spark, sf_dir, "eval_whole"), metrics=["ROUGE-L"])


@register("whole_text_evaluate_all")
def q_whole_text_evaluate_all(spark, sf_dir):
    return M.evaluate_all(fixtures.view(spark, sf_dir, "eval_whole"))
