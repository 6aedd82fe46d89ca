"""Dense 0..n-1 index in a given order, without funnelling rows into one partition.

``row_number()`` with no ``PARTITION BY`` moves every row to a single task, and a
window partitioned by a low-cardinality column (a split) puts a third or more of
the data in one task. Instead:

1. range-partition on the order keys and sort inside each partition;
2. tag each row with its partition id and ``monotonically_increasing_id``;
3. materialise as a Parquet table in the shared directory named by
   ``spark.checkpoint.dir`` (one job), so every later pass sees the same tags even
   if executors are lost;
4. count rows per (group, partition): a table of at most groups x partitions rows;
5. running sum of those counts = offset of each partition; broadcast that tiny
   table back and add the position inside the partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def dense_index(df: DataFrame, order: list, out_col: str = "idx", group_cols: list | None = None,
                start: int = 0, num_partitions: int | None = None) -> DataFrame:
    """Add ``out_col`` = ``start`` + rank of the row in ``order`` (within ``group_cols``).

    ``order`` must make rows unique (add a tie-breaking key), otherwise ties get an
    arbitrary but consistent order."""
    spark = df.sparkSession
    group_cols = list(group_cols or [])
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group_cols] + [F.col(o) if isinstance(o, str) else o for o in order]
    tagged = materialize(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()), "dense-index")
    part = group_cols + ["_pid"]
    stats = tagged.groupBy(*part).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_min"))
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    # offsets has (groups x partitions) rows: a size bound independent of the data.
    out = tagged.join(F.broadcast(offsets.drop("_cnt")), part)
    return (out.withColumn(out_col, (F.col("_off") + F.col("_mid") - F.col("_min") + F.lit(start)).cast("bigint"))
            .drop("_pid", "_mid", "_min", "_off"))


def running_total(df: DataFrame, order: list, value_col: str, out_col: str) -> DataFrame:
    """Add ``out_col``: the sum of ``value_col`` over all rows before this one in ``order``,
    with the same two steps: sums of range partitions, then windows inside them."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = materialize(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()), "running-total")
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = tagged.groupBy("_pid").agg(F.sum(value_col).alias("_sum"))  # a row per partition
    offsets = sums.select("_pid", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (tagged.withColumn("_in", F.coalesce(F.sum(value_col).over(inside), F.lit(0))).join(F.broadcast(offsets), "_pid")
            .withColumn(out_col, F.col("_off") + F.col("_in")).drop("_pid", "_in", "_off"))


def bounded_rows(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows (a one-number action)."""
    return df.limit(max_rows + 1).count() <= max_rows


def maybe_broadcast(df: DataFrame, max_rows: int = 2_000_000, known_bound: int | None = None) -> DataFrame:
    """Broadcast ``df`` only when its row count is proven small.

    ``known_bound`` is a bound guaranteed by construction (e.g. a ``limit``); when
    it is absent the rows are counted. Beyond the bound the plain DataFrame is
    returned and the optimizer/AQE picks a shuffle join instead."""
    if known_bound is not None and known_bound <= max_rows:
        return F.broadcast(df)
    if bounded_rows(df, max_rows):
        return F.broadcast(df)
    return df
