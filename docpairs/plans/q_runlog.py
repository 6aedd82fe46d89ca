"""Training-run analytics queries (L1-L9) over ``run_log``, ``logits`` and the
batch-level log derived from ``events``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import runlog as L
from ..sources import fixtures
from .common import oracle
from .registry import register


def _r6(c):
    return F.round(c, 6)


LSE = "(list_max(logits) + ln(list_reduce(logits, lambda acc, x: acc + exp(CAST(x AS DOUBLE) - list_max(logits)), 0.0::DOUBLE)))"
ZT = "CAST(logits[target + 1] AS DOUBLE)"
MEANL = "(list_reduce(logits, lambda acc, x: acc + CAST(x AS DOUBLE), 0.0::DOUBLE) / len(logits))"
TOK_MASKED = f"(0.95::DOUBLE * ({LSE} - {ZT}) + 0.05::DOUBLE * ({LSE} - {MEANL}))"
TOK_PLAIN = f"({LSE} - {ZT})"
_LOSS_CTES = (
    f"bm AS (SELECT batch_id, CAST(count(*) AS BIGINT) AS n_tokens, avg({TOK_MASKED}) AS batch_loss "
    f"FROM logits WHERE pos > 0 AND target <> 0 GROUP BY batch_id)",
    f"bu AS (SELECT batch_id, CAST(count(*) AS BIGINT) AS n_tokens, avg({TOK_PLAIN}) AS batch_loss "
    f"FROM logits GROUP BY batch_id)")


def _logits(spark, sf_dir):
    return fixtures.view(spark, sf_dir, "logits")


@register("masked_loss", oracle(
    "SELECT batch_id, n_tokens, round(batch_loss, 6) AS batch_loss FROM bm", *_LOSS_CTES, views=("logits",)))
def q_masked_loss(spark, sf_dir):
    b = L.batch_losses(_logits(spark, sf_dir), masked=True)
    return b.select("batch_id", "n_tokens", _r6("batch_loss").alias("batch_loss"))


@register("unmasked_loss", oracle(
    "SELECT batch_id, n_tokens, round(batch_loss, 6) AS batch_loss FROM bu", *_LOSS_CTES, views=("logits",)))
def q_unmasked_loss(spark, sf_dir):
    b = L.batch_losses(_logits(spark, sf_dir), masked=False)
    return b.select("batch_id", "n_tokens", _r6("batch_loss").alias("batch_loss"))


@register("logits_epoch_loss", oracle(
    "SELECT round((SELECT avg(batch_loss) FROM bm), 6) AS masked_epoch_loss, "
    "round((SELECT avg(batch_loss) FROM bu), 6) AS unmasked_epoch_loss, "
    "CAST((SELECT count(*) FROM bu) AS BIGINT) AS n_batches", *_LOSS_CTES, views=("logits",)))
def q_logits_epoch_loss(spark, sf_dir):
    # One pass: both batch losses per batch, then the mean of batch means of each
    # (a batch with no kept token has a null masked mean and is skipped, like avg).
    b = L.batch_losses_both(_logits(spark, sf_dir))
    return b.agg(_r6(F.avg("masked_loss")).alias("masked_epoch_loss"),
                 _r6(F.avg("unmasked_loss")).alias("unmasked_epoch_loss"),
                 F.count(F.lit(1)).cast("bigint").alias("n_batches"))


def _run_log(spark, sf_dir):
    return fixtures.view(spark, sf_dir, "run_log")


@register("epoch_report", oracle(
    "SELECT run, epoch, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss, "
    "round(val_loss - train_loss, 6) AS gap, round(exp(least(train_loss, 100.0)), 6) AS train_ppl, "
    "round(exp(least(val_loss, 100.0)), 6) AS val_ppl, "
    "round(greatest(0.1::DOUBLE, 0.5::DOUBLE * pow(0.95::DOUBLE, epoch)), 6) AS tf_ratio FROM run_log",
    views=("run_log",)))
def q_epoch_report(spark, sf_dir):
    r = L.epoch_report(_run_log(spark, sf_dir))
    return r.select("run", "epoch", *[_r6(c).alias(c) for c in
                                      ("train_loss", "val_loss", "gap", "train_ppl", "val_ppl", "tf_ratio")])


_BEST = ("bs AS (SELECT *, min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best FROM run_log)",
         "bi AS (SELECT *, coalesce(val_loss < prev_best, val_loss IS NOT NULL) AS improved FROM bs)",
         "bg AS (SELECT *, sum(CAST(improved AS INTEGER)) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM bi)",
         "bk AS (SELECT *, CAST(row_number() OVER (PARTITION BY run, grp ORDER BY epoch) - CASE WHEN grp > 0 THEN 1 ELSE 0 END AS BIGINT) AS streak FROM bg)",
         "bst AS (SELECT *, min(CASE WHEN streak >= 5 THEN epoch END) OVER (PARTITION BY run) AS stop_epoch FROM bk)",
         "es AS (SELECT run, epoch, train_loss, val_loss, prev_best, improved, streak, "
         "coalesce(epoch = stop_epoch, false) AS stopped_here FROM bst WHERE stop_epoch IS NULL OR epoch <= stop_epoch)")


@register("best_so_far", oracle(
    "SELECT run, epoch, round(val_loss, 6) AS val_loss, round(prev_best, 6) AS prev_best, improved FROM bi",
    *_BEST, views=("run_log",)))
def q_best_so_far(spark, sf_dir):
    b = L.best_so_far(_run_log(spark, sf_dir))
    return b.select("run", "epoch", _r6("val_loss").alias("val_loss"), _r6("prev_best").alias("prev_best"), "improved")


@register("early_stop", oracle(
    "SELECT run, epoch, round(val_loss, 6) AS val_loss, improved, streak, stopped_here FROM es",
    *_BEST, views=("run_log",)))
def q_early_stop(spark, sf_dir):
    e = L.early_stop(_run_log(spark, sf_dir))
    return e.select("run", "epoch", _r6("val_loss").alias("val_loss"), "improved", "streak", "stopped_here")


@register("best_checkpoint", oracle(
    "SELECT run, max(epoch) AS best_epoch, round(arg_max(val_loss, epoch), 6) AS best_val_loss FROM es "
    "WHERE improved GROUP BY run", *_BEST, views=("run_log",)))
def q_best_checkpoint(spark, sf_dir):
    b = L.best_checkpoint(_run_log(spark, sf_dir))
    return b.select("run", "best_epoch", _r6("best_val_loss").alias("best_val_loss"))


_BLOG = ("blog AS (SELECT event_type AS run, ts, event_id, value / 50 AS loss, "
         "CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS BIGINT) AS batch_idx FROM events)",)


def _blog(spark, sf_dir):
    return L.batch_log(fixtures.table(spark, sf_dir, "events"))


@register("sampled_progress", oracle(
    "SELECT run, batch_idx, round(loss, 6) AS loss FROM blog WHERE (batch_idx + 1) % 50 = 0", *_BLOG, views=()))
def q_sampled_progress(spark, sf_dir):
    s = L.sampled_progress(_blog(spark, sf_dir), 50)
    return s.select("run", "batch_idx", _r6("loss").alias("loss"))


@register("epoch_loss", oracle(
    "SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY d) AS BIGINT) AS epoch, "
    "round(epoch_loss, 6) AS epoch_loss, n_batches FROM (SELECT run, CAST(date_trunc('day', ts) AS DATE) AS d, "
    "avg(loss) AS epoch_loss, CAST(count(*) AS BIGINT) AS n_batches FROM blog GROUP BY 1, 2) x", *_BLOG, views=()))
def q_epoch_loss(spark, sf_dir):
    ev = fixtures.table(spark, sf_dir, "events")
    per = (ev.select(F.col("event_type").alias("run"), F.to_date("ts").alias("d"), (F.col("value") / 50).alias("batch_loss"))
           .groupBy("run", "d").agg(F.avg("batch_loss").alias("epoch_loss"), F.count(F.lit(1)).cast("bigint").alias("n_batches")))
    # One row per (run, day) after the aggregate: the window holds days, not events.
    w = Window.partitionBy("run").orderBy("d")
    return per.select("run", F.row_number().over(w).cast("bigint").alias("epoch"),
                      _r6("epoch_loss").alias("epoch_loss"), "n_batches")
