"""Training-run analytics (L1-L9) as table work over logged losses and logits.

Windows are partitioned by run and ordered by epoch: a run has one row per epoch,
so each window group is bounded by the number of epochs, not by the data.
Batch-level logs, which grow with the data, get their per-run order from the
distributed dense index instead of a run-partitioned window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import dense_index

LABEL_SMOOTHING = 0.05
PATIENCE = 5
TEACHER_FORCING = 0.5
TF_DECAY, TF_FLOOR = 0.95, 0.1
PPL_CAP = 100.0
PAD_TARGET = 0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def log_sum_exp(logits) -> Column:
    """Stable log-sum-exp of a numeric array (max subtracted first)."""
    l = _col(logits)
    m = F.array_max(l).cast("double")
    return m + F.log(F.aggregate(l, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - m)))


def token_loss(logits, target, smoothing: float = 0.0) -> Column:
    """Cross-entropy of one token, with label smoothing ``smoothing``:
    (1 - s) * (lse - z_target) + s * (lse - mean(z))."""
    l = _col(logits)
    lse = log_sum_exp(l)
    z = F.element_at(l, _col(target).cast("int") + 1).cast("double")
    nll = lse - z
    if not smoothing:
        return nll
    mean = F.aggregate(l, F.lit(0.0), lambda acc, x: acc + x.cast("double")) / F.size(l)
    return F.lit(1.0 - smoothing) * nll + F.lit(smoothing) * (lse - mean)


def batch_losses(logits: DataFrame, masked: bool = True, smoothing: float = LABEL_SMOOTHING,
                 by=("batch_id",)) -> DataFrame:
    """L1 (masked=True): drop position 0, ignore pad targets, label smoothing.
    L2 (masked=False): every position and target, no smoothing.
    Returns (by..., n_tokens, batch_loss): the mean token loss per batch."""
    df = logits
    if masked:
        df = df.where((F.col("pos") > 0) & (F.col("target") != PAD_TARGET))
        loss = token_loss("logits", "target", smoothing)
    else:
        loss = token_loss("logits", "target", 0.0)
    return (df.select(*by, loss.alias("_l")).groupBy(*by)
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_tokens"), F.avg("_l").alias("batch_loss")))


def batch_losses_both(logits: DataFrame, smoothing: float = LABEL_SMOOTHING, by=("batch_id",)) -> DataFrame:
    """L1 and L2 in one pass: per batch the masked, smoothed mean and the plain mean."""
    keep = (F.col("pos") > 0) & (F.col("target") != PAD_TARGET)
    lse = log_sum_exp("logits")
    z = F.element_at("logits", F.col("target").cast("int") + 1).cast("double")
    mean = F.aggregate("logits", F.lit(0.0), lambda acc, x: acc + x.cast("double")) / F.size("logits")
    staged = logits.select(*by, keep.alias("_k"), lse.alias("_lse"), z.alias("_z"), mean.alias("_mean"))
    masked = F.lit(1.0 - smoothing) * (F.col("_lse") - F.col("_z")) + F.lit(smoothing) * (F.col("_lse") - F.col("_mean"))
    return staged.groupBy(*by).agg(
        F.count_if("_k").cast("bigint").alias("n_masked"), F.avg(F.when(F.col("_k"), masked)).alias("masked_loss"),
        F.count(F.lit(1)).cast("bigint").alias("n_tokens"), F.avg(F.col("_lse") - F.col("_z")).alias("unmasked_loss"))


def epoch_loss(batches: DataFrame, by=()) -> DataFrame:
    """Mean over batches of batch means (not token-weighted)."""
    g = batches.groupBy(*by) if by else batches.groupBy()
    return g.agg(F.avg("batch_loss").alias("epoch_loss"), F.count(F.lit(1)).cast("bigint").alias("n_batches"))


def epoch_report(run_log: DataFrame, teacher_forcing: float = TEACHER_FORCING) -> DataFrame:
    """L3 + L7: gap, perplexities exp(min(loss, 100)), teacher-forcing ratio
    max(0.1, r * 0.95^epoch)."""
    return run_log.select(
        "run", "epoch", "train_loss", "val_loss",
        (F.col("val_loss") - F.col("train_loss")).alias("gap"),
        F.exp(F.least(F.col("train_loss"), F.lit(PPL_CAP))).alias("train_ppl"),
        F.exp(F.least(F.col("val_loss"), F.lit(PPL_CAP))).alias("val_ppl"),
        F.greatest(F.lit(TF_FLOOR), F.lit(teacher_forcing) * F.pow(F.lit(TF_DECAY), F.col("epoch"))).alias("tf_ratio"))


def best_so_far(run_log: DataFrame) -> DataFrame:
    """L4: running best before each epoch and whether this epoch improves on it
    (strictly lower validation loss; the first epoch improves on +inf). A missing
    loss never improves, as NaN never compares lower."""
    w = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.min("val_loss").over(w)
    return run_log.withColumn("prev_best", prev).withColumn(
        "improved", F.coalesce(F.col("val_loss") < F.col("prev_best"), F.col("val_loss").isNotNull()))


def early_stop(run_log: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """Epochs since the last improvement (``streak``); training stops at the first
    epoch whose streak reaches ``patience``; later epochs are dropped."""
    b = best_so_far(run_log)
    w = Window.partitionBy("run").orderBy("epoch")
    b = b.withColumn("_grp", F.sum(F.col("improved").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # Inside a group the first row is the improvement (counter 0); epochs before any
    # improvement (group 0) already count from 1.
    rn = F.row_number().over(Window.partitionBy("run", "_grp").orderBy("epoch"))
    b = b.withColumn("streak", (rn - F.when(F.col("_grp") > 0, 1).otherwise(0)).cast("bigint"))
    stop = F.min(F.when(F.col("streak") >= patience, F.col("epoch"))).over(Window.partitionBy("run"))
    b = b.withColumn("stop_epoch", stop)
    return (b.where(F.col("stop_epoch").isNull() | (F.col("epoch") <= F.col("stop_epoch")))
            .withColumn("stopped_here", F.coalesce(F.col("epoch") == F.col("stop_epoch"), F.lit(False)))
            .drop("_grp", "stop_epoch"))


def best_checkpoint(run_log: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """Epoch and validation loss of the last improvement before the stop."""
    kept = early_stop(run_log, patience).where("improved")
    best = F.max_by(F.struct("epoch", "val_loss"), F.col("epoch"))
    return kept.groupBy("run").agg(best.alias("_b")).select(
        "run", F.col("_b.epoch").alias("best_epoch"), F.col("_b.val_loss").alias("best_val_loss"))


def batch_log(events: DataFrame, scale: float = 50.0) -> DataFrame:
    """Batch-level loss log from the event stream: run = event type, loss = value / scale,
    batch_idx = 0-based position in (ts, event_id) order within the run."""
    base = events.select(F.col("event_type").alias("run"), "ts", "event_id",
                         (F.col("value") / scale).alias("loss"))
    return dense_index(base, ["ts", "event_id"], "batch_idx", group_cols=["run"])


def sampled_progress(blog: DataFrame, every: int) -> DataFrame:
    """The progress line printed every ``every``-th batch."""
    return blog.where((F.col("batch_idx") + 1) % every == 0)
