"""Frames and windows over the long sample form.

Every grouping here is keyed by (source, frame) or (source, window), so a
group holds at most one frame or window: a hot source spreads over many
groups and tasks.  Sample order inside a group comes from sorting
``struct(i, value)``, never from ``collect_list`` order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapecode.config import DICT_FRACTION, TRAIN_FRACTION


def _ordered_values(col_i: str = "i", col_v: str = "value"):
    return F.transform(F.array_sort(F.collect_list(F.struct(col_i, col_v))), lambda z: z[col_v])


def tumbling_frames(samples: DataFrame, frame_len: int, cap: int | None = None,
                    value_col: str = "value", extra_aggs: dict | None = None) -> DataFrame:
    """Non-overlapping frames of ``frame_len`` samples.

    ``frame_ref`` is the index of the frame's first sample.  The trailing
    partial frame is dropped (A16); ``cap`` optionally limits frames per source.
    """
    s = samples
    if cap is not None:
        s = s.where(F.col("i") < F.lit(cap * frame_len))
    extra_aggs = extra_aggs or {}
    frames = (
        s.groupBy("source_id", F.floor(F.col("i") / F.lit(frame_len)).cast("bigint").alias("frame_no"))
        .agg(_ordered_values("i", value_col).alias("frame"), *[a.alias(k) for k, a in extra_aggs.items()])
        .where(F.size("frame") == F.lit(frame_len))
    )
    return frames.select("source_id", "frame_no",
                         (F.col("frame_no") * F.lit(frame_len)).alias("frame_ref"), "frame", *extra_aggs.keys())


def frame_budget(samples: DataFrame, frame_len: int, cap: int | None = None) -> DataFrame:
    """Samples, whole frames and dropped remainder per source."""
    n = F.count(F.lit(1))
    whole = F.floor(n / F.lit(frame_len)).cast("bigint")
    if cap is not None:
        whole = F.least(whole, F.lit(cap).cast("bigint"))
    return samples.groupBy("source_id").agg(
        n.alias("n_samples"), whole.alias("n_frames"),
        (n % F.lit(frame_len)).cast("bigint").alias("remainder"))


def training_budget(samples: DataFrame, w: int, step: int) -> DataFrame:
    """Per source ``max_w = N div S``, ``tr = int(0.2 max_w)``,
    ``k = int(0.1 tr)`` and the samples consumed ``W + (tr-1) S``."""
    n = F.count(F.lit(1))
    b = samples.groupBy("source_id").agg(n.alias("n_samples"))
    b = b.withColumn("max_w", F.floor(F.col("n_samples") / F.lit(step)).cast("bigint"))
    b = b.withColumn("tr", F.floor(F.lit(TRAIN_FRACTION) * F.col("max_w")).cast("bigint"))
    b = b.withColumn("k", F.floor(F.lit(DICT_FRACTION) * F.col("tr")).cast("bigint"))
    return b.withColumn(
        "samples_used",
        F.when(F.col("tr") > 0, F.lit(w) + (F.col("tr") - 1) * F.lit(step)).otherwise(F.lit(0)).cast("bigint"))


def sliding_windows(samples: DataFrame, w: int, step: int, budget: DataFrame | None = None,
                    method: str = "blocks", block_windows: int = 256) -> DataFrame:
    """Windows of ``w`` samples starting every ``step`` samples.

    ``blocks`` (default): samples are grouped in blocks of
    ``block_windows * step`` samples plus the ``w - step`` samples the last
    windows of a block need from the next one, so only that overlap is sent
    twice; windows are then cut inside the block row.  ``explode`` sends
    each sample to every window containing it (``ceil(w/step)`` copies).
    With a ``budget`` (from :func:`training_budget`) only windows ``j < tr``
    are built and samples past the training region are dropped first.
    """
    s = samples
    if budget is not None:
        s = s.join(budget.select("source_id", "tr"), "source_id").where(
            F.col("i") < F.lit(w) + (F.col("tr") - 1) * F.lit(step))
    if method == "explode":
        lo = F.greatest(F.lit(0).cast("bigint"),
                        F.ceil((F.col("i") - F.lit(w - 1)) / F.lit(step)).cast("bigint"))
        hi = F.floor(F.col("i") / F.lit(step)).cast("bigint")
        ex = s.withColumn("j", F.explode(F.sequence(lo, hi)))
        if budget is not None:
            ex = ex.where(F.col("j") < F.col("tr"))
        wins = (ex.groupBy("source_id", "j").agg(_ordered_values().alias("w"))
                .where(F.size("w") == F.lit(w)))
        return wins.select("source_id", "j", (F.col("j") * F.lit(step)).alias("start"), "w")
    # a block must own at least the overlap, so a sample reaches at most two blocks
    block_windows = max(block_windows, -(-(w - step) // step))
    m = block_windows * step                   # samples owned by a block
    b = F.floor(F.col("i") / F.lit(m)).cast("bigint")
    spill = w - step                           # samples the previous block also needs
    blocks = F.when((F.col("i") % F.lit(m) < F.lit(spill)) & (b > 0), F.array(b, b - 1)).otherwise(F.array(b)) \
        if spill > 0 else F.array(b)
    ex = s.withColumn("_blk", F.explode(blocks))
    keep = ["tr"] if budget is not None else []
    grp = ex.groupBy("source_id", "_blk", *keep).agg(_ordered_values().alias("_v"), F.min("i").alias("_i0"))
    # windows starting in the block: j = blk*block_windows + q, start = j*step
    q = F.sequence(F.lit(0), F.lit(block_windows - 1))
    wins = grp.select("source_id", "_blk", *keep, "_i0", F.posexplode(F.transform(
        q, lambda k: F.slice("_v", k * F.lit(step) + F.lit(1), F.lit(w)))).alias("_q", "w"))
    wins = wins.withColumn("j", F.col("_blk") * F.lit(block_windows) + F.col("_q"))
    wins = wins.where((F.size("w") == F.lit(w)) & (F.col("_i0") == F.col("_blk") * F.lit(m)))
    if budget is not None:
        wins = wins.where(F.col("j") < F.col("tr"))
    return wins.select("source_id", "j", (F.col("j") * F.lit(step)).alias("start"), "w")


def half_overlap_windows(frames: DataFrame, w: int, n: int) -> DataFrame:
    """The ``2n-1`` windows at ``k*w/2`` inside each frame, one row each.

    Pure projection + explode: no shuffle.
    """
    h = w // 2
    wins = F.transform(F.sequence(F.lit(0), F.lit(2 * n - 2)),
                       lambda k: F.slice("frame", k * F.lit(h) + F.lit(1), F.lit(w)))
    return frames.select("source_id", "frame_no", "frame_ref",
                         F.posexplode(wins).alias("k", "w")).withColumn("start", F.col("k") * F.lit(h))


def trimmed(frame_col: str, w: int, n: int):
    """Drop the first and last ``w/2`` samples of a frame."""
    h = w // 2
    return F.slice(frame_col, F.lit(h + 1), F.lit(n * w - w))
