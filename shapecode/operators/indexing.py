"""Dense per-source sample index (``i`` = 0, 1, 2, ... in a given order).

``row_number() OVER (PARTITION BY source ORDER BY ...)`` puts a whole
recording into one task.  A single recording may hold a third of all rows,
so the default method splits every recording across range partitions:

1. range-partition on ``(source, order...)`` and sort inside partitions;
   a hot source now spans many partitions, each holding a contiguous run;
2. tag rows with ``monotonically_increasing_id`` (partition id << 33 |
   position), which is increasing inside a partition;
3. count rows per ``(source, partition)`` -- at most #partitions + #sources
   rows -- and turn the counts into running offsets per source;
4. join the offsets back on ``(source, partition)``.  AQE turns this join
   into a broadcast when the measured offsets table is small, and keeps a
   shuffled join otherwise.

Steps 3 and 4 read the tagged rows twice.  Two range exchanges would sample
different bounds, so the tagged rows are written once with a reliable
checkpoint (shared storage from ``spark.checkpoint.dir``): both reads see
the same partitions, and a lost executor re-reads files instead of
re-deriving tags.

``i = offset + (mid - first mid of the run)``.

Decoded binary recordings (``sources.binary``) already carry ``i`` (the
record's position in the file), so they need no ranking at all; this
index is for tables whose sample order is given by columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shapecode.session import cut_lineage


def index_within(df: DataFrame, key: str, order_cols: list[str] | tuple[str, ...],
                 out: str = "i", method: str = "range",
                 num_partitions: int | None = None, keep_order: bool = True) -> DataFrame:
    order_cols = list(order_cols)
    if method == "window":
        w = Window.partitionBy(key).orderBy(*order_cols)
        return df.withColumn(out, F.row_number().over(w) - F.lit(1))
    if method != "range":
        raise ValueError(f"unknown index method {method!r}")
    spark = df.sparkSession
    # one range partition per input split (maxPartitionBytes each), at least
    # the shuffle width: a sorted piece stays as small as an input split
    # however large the input (fewer, larger pieces: raise maxPartitionBytes)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = num_partitions or max(width, df.rdd.getNumPartitions())
    ranged = (
        df.repartitionByRange(parts, key, *order_cols)
        .sortWithinPartitions(key, *order_cols)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    if not keep_order:       # callers that only need the index write less
        ranged = ranged.drop(*[c for c in order_cols if c != key])
    ranged = cut_lineage(ranged)
    runs = ranged.groupBy(key, "_pid").agg(
        F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_first"))
    before = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        key, "_pid", "_first",
        F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    return (
        ranged.join(offsets, [key, "_pid"], "inner")
        .withColumn(out, F.col("_off") + F.col("_mid") - F.col("_first"))
        .drop("_pid", "_mid", "_first", "_off")
    )
