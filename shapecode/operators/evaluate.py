"""Offline evaluation: labelled frames, splits, errors and threshold choice.

J1, P4, L3, L4, A6-A10, A12.  Everything stays distributed until the sweep
curve, which has at most ``SWEEP_STEPS`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shapecode.config import (NORMAL_CODE, SAMPLE_SEED, SPLIT_SEED, SWEEP_STEP, SWEEP_STEPS,
                              VALIDATION_FRACTION)


def labelled_frames(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Inner equi-join of scored frames and labels on (source, frame_ref).

    Both sides grow with the recordings and the planner cannot size coded
    frames, so the join is a merge: neither side is sent to the driver.
    """
    lab = labels.withColumnRenamed("record_id", "source_id")
    return scores.join(lab.hint("merge"), ["source_id", "frame_ref"], "inner")


def with_region(df: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``frame_ref <= cutoff`` is training, the rest is held out.

    ``cutoffs(source_id, cutoff)`` -- one row per source.
    """
    return df.join(cutoffs, "source_id", "left").withColumn(
        "region", F.when(F.col("frame_ref") <= F.col("cutoff"), F.lit("train")).otherwise(F.lit("rest")))


def split_key(seed: str):
    return F.md5(F.concat_ws(":", F.lit(seed), F.col("source_id").cast("string"),
                             F.col("frame_ref").cast("string")))


def _reached(counts: DataFrame, bucket: str, target: str) -> DataFrame:
    """Per source the bucket in which the running count reaches ``target``, and the count before it."""
    run = Window.partitionBy("source_id").orderBy(bucket)
    upto = F.sum("_c").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    c = counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col(target)) & (F.col("_upto") - F.col("_c") < F.col(target)))
    return c.withColumn("_before", F.col("_upto") - F.col("_c"))


def hash_cutoffs(keyed: DataFrame, fraction: float, key: str = "_h", digits: int = 3) -> DataFrame:
    """(source_id, cutoff): the ``floor(fraction * n)``-th smallest key of every source, by radix selection.

    Two rounds of counting by the next ``digits`` hex digits narrow a source to
    one of 16**(2 * digits) buckets; only that bucket's keys are sorted.  A
    source with nothing to select has no row.  Nothing is ranked or range
    partitioned, and counts are partial sums, so a hot source spreads over all tasks.
    """
    first, second = F.substring(key, 1, digits), F.substring(key, digits + 1, digits)
    n = keyed.groupBy("source_id").agg(F.count(F.lit(1)).alias("_n"))
    target = n.select("source_id", F.floor(F.lit(fraction) * F.col("_n")).cast("bigint").alias("_t")).where("_t > 0")
    one = keyed.groupBy("source_id", first.alias("_b1")).agg(F.count(F.lit(1)).alias("_c")).join(target, "source_id")
    one = _reached(one, "_b1", "_t").select("source_id", "_b1", (F.col("_t") - F.col("_before")).alias("_t"))
    near = keyed.withColumn("_b1", first).join(one, ["source_id", "_b1"])
    two = near.groupBy("source_id", "_b1", "_t", second.alias("_b2")).agg(F.count(F.lit(1)).alias("_c"))
    two = _reached(two, "_b2", "_t").select("source_id", "_b1", "_b2", (F.col("_t") - F.col("_before")).alias("_t"))
    rest = keyed.withColumns({"_b1": first, "_b2": second}).join(two, ["source_id", "_b1", "_b2"])
    return rest.groupBy("source_id", "_t").agg(F.array_sort(F.collect_list(key)).alias("_k")).select(
        "source_id", F.element_at("_k", F.col("_t").cast("int")).alias("cutoff"))


def split_validation_test(rest: DataFrame, fraction: float = VALIDATION_FRACTION,
                          seed: str = SPLIT_SEED) -> DataFrame:
    """L4: per source, the first ``floor(fraction * n)`` frames in md5 order
    are ``validation``, the others ``test`` (reproducible, no driver shuffle).

    The boundary of every source is found by radix selection (:func:`hash_cutoffs`);
    the counting passes and the split are one query over the same exchange of
    scored frames.  Rows that repeat a frame fall on the same side.
    """
    keyed = rest.withColumn("_h", split_key(seed))
    out = keyed.join(hash_cutoffs(keyed.select("source_id", "_h"), fraction), "source_id", "left")
    return out.withColumn("split", F.when(F.col("_h") <= F.col("cutoff"), F.lit("validation")).otherwise(F.lit("test"))).drop("_h", "cutoff")


def sample_frames(df: DataFrame, n: int = 20, seed: str = SAMPLE_SEED) -> DataFrame:
    """L3: reproducible sample of ``n`` rows (top-n by md5; per-partition top-n then merge)."""
    return df.withColumn("_h", split_key(seed)).orderBy("_h").limit(n).drop("_h")


def is_positive():
    return F.col("label") != F.lit(NORMAL_CODE)


def errors_at(df: DataFrame, t) -> DataFrame:
    """One-row error report at threshold ``t`` (offline rule ``>=``).

    Only scored frames count; frames without a score are reported apart, as
    ``unscored``, by this report and the sweep alike.  Percentages share the
    denominator ``n``; ``n = 0`` gives NULL.
    """
    has = F.col("score").isNotNull()
    pos, neg = is_positive() & has, ~is_positive() & has
    t = F.lit(float(t)) if not hasattr(t, "alias") else t
    fn = F.count_if(pos & (F.col("score") < t))
    fp = F.count_if(neg & (F.col("score") >= t))
    n = F.count("score")
    return df.agg(
        F.count_if(~has).alias("unscored"),
        n.alias("n"), F.count_if(pos).alias("pos"), F.count_if(neg).alias("neg"),
        F.max(t).alias("t"),
        F.try_divide(F.lit(100) * (fn + fp), n).alias("total_pct"),
        F.try_divide(F.lit(100) * fp, n).alias("fp_pct"),
        F.try_divide(F.lit(100) * fn, n).alias("fn_pct"))


def threshold_bucket(score_col: str = "score", step: float = SWEEP_STEP, steps: int = SWEEP_STEPS):
    """Largest ``b`` with ``b * step <= score`` (exact at ties), capped to [0, steps-1]."""
    s = F.col(score_col)
    c = F.floor(s / F.lit(step)).cast("bigint")
    c = F.when((c + 1) * F.lit(step) <= s, c + 1).otherwise(c)
    c = F.when(c * F.lit(step) > s, c - 1).otherwise(c)
    return F.least(F.greatest(c, F.lit(0).cast("bigint")), F.lit(steps - 1).cast("bigint"))


def threshold_sweep(df: DataFrame, step: float = SWEEP_STEP, steps: int = SWEEP_STEPS) -> DataFrame:
    """Error curve for thresholds ``t_i = i * step``, ``i < steps``.

    Frames are bucketed by the largest threshold they reach and counted per
    bucket (partial aggregation, <= steps+1 groups, one of them for the frames
    without a score, which are only reported as ``unscored``); FN(i) is the running
    count of positives below bucket i and FP(i) the negatives from bucket i
    up, over a <= ``steps``-row table.  Equal to the brute-force evaluation
    of every threshold.  Scores are absolute values, so no bucket lies below 0.
    """
    spark = df.sparkSession
    bucket = F.when(F.col("score").isNotNull(), threshold_bucket("score", step, steps)).otherwise(F.lit(-1))
    b = (df.withColumn("b", bucket)
         .groupBy("b").agg(F.count_if(is_positive()).alias("p"), F.count_if(~is_positive()).alias("q")))
    grid = spark.range(-1, steps).withColumnRenamed("id", "i")      # -1: frames without a score
    # grid is fixed-size (steps + 1 rows) and per-bucket counts are <= steps+1 rows
    g = grid.join(F.broadcast(b), grid["i"] == b["b"], "left").select(
        "i", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("q", F.lit(0)).alias("q"))
    whole = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    g = g.withColumn("unscored", F.sum(F.when(F.col("i") < 0, F.col("p") + F.col("q")).otherwise(0)).over(whole)).where("i >= 0")
    w_all = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w_before = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    w_from = Window.orderBy("i").rowsBetween(0, Window.unboundedFollowing)
    g = g.select(
        "i", "unscored",
        F.sum("p").over(w_all).alias("pos"),
        F.sum("q").over(w_all).alias("neg"),
        F.coalesce(F.sum("p").over(w_before), F.lit(0)).alias("fn"),
        F.sum("q").over(w_from).alias("fp"))
    n = F.col("pos") + F.col("neg")
    return g.select(
        F.col("i").alias("t_index"), (F.col("i") * F.lit(step)).alias("t"),
        "unscored", n.alias("n"), "pos", "neg", "fn", "fp",
        F.try_divide(F.lit(100) * (F.col("fn") + F.col("fp")), n).alias("total_pct"),
        F.try_divide(F.lit(100) * F.col("fp"), n).alias("fp_pct"),
        F.try_divide(F.lit(100) * F.col("fn"), n).alias("fn_pct"))


def best_threshold(curve: DataFrame) -> DataFrame:
    """A10: least total error, lowest threshold on ties (one row)."""
    return curve.where(F.col("total_pct").isNotNull()).orderBy("total_pct", "t_index").limit(1)


def frame_profile(coded: DataFrame) -> DataFrame:
    """Per-frame maxima of source, coded and loss, and max |loss|."""
    return coded.select(
        "source_id", "frame_ref",
        F.array_max("src").alias("max_src"), F.array_max("coded").alias("max_coded"),
        F.array_max("loss").alias("max_loss"), F.array_min("loss").alias("min_loss"),
        F.col("score").alias("max_abs_loss"))


def loss_histogram(coded: DataFrame, bins: int = 50) -> DataFrame:
    """Density histogram of each frame's loss, ``bins`` equal bins.

    Built inside the row (no shuffle): the sample's bins are sorted once and
    counted by their run ends; last bin closed; ``min = max`` uses
    ``[min - 0.5, max + 0.5]``.  Height = count / (n * width).  All bins are
    returned, empty ones with height 0; an empty loss gives none.
    """
    lo = F.array_min("loss")
    hi = F.array_max("loss")
    df = coded.select(
        "source_id", "frame_ref", "loss",
        F.when(lo == hi, lo - F.lit(0.5)).otherwise(lo).alias("_lo"),
        F.when(lo == hi, hi + F.lit(0.5)).otherwise(hi).alias("_hi"))
    df = df.withColumn("_wd", (F.col("_hi") - F.col("_lo")) / F.lit(bins))
    of = F.transform("loss", lambda x: F.least(F.floor((x - F.col("_lo")) / F.col("_wd")).cast("int"), F.lit(bins - 1)))
    df = df.where(F.size("loss") > 0).withColumn("_bins", F.array_sort(F.concat(of, F.sequence(F.lit(0), F.lit(bins - 1)))))
    # every bin stands once more in the sorted list, so its run ends where its last copy is
    ends = F.filter(F.transform("_bins", lambda b, j: F.when(
        F.get("_bins", j + 1).isNull() | (F.get("_bins", j + 1) != b), j + 1)), lambda e: e.isNotNull())
    df = df.withColumn("_ends", ends)
    counts = F.transform("_ends", lambda e, j: (e - F.coalesce(F.get("_ends", j - 1), F.lit(0)) - 1).cast("bigint"))
    df = df.select("source_id", "frame_ref", "_lo", "_wd", F.size("loss").alias("_n"),
                   F.posexplode(counts).alias("bin", "cnt"))
    return df.select(
        "source_id", "frame_ref", F.col("bin").cast("int").alias("bin"),
        (F.col("_lo") + F.col("bin") * F.col("_wd")).alias("bin_lo"),
        F.col("cnt").alias("cnt"),
        (F.col("cnt") / (F.col("_n") * F.col("_wd"))).alias("height"))


def decode_mismatches(decoded: DataFrame, expected: DataFrame) -> DataFrame:
    """Positions whose two channels differ from the reference samples or stand on one side only, with both values."""
    d = decoded.select("source_id", "i", F.col("s1").alias("decoded_s1"), F.col("s2").alias("decoded_s2"))
    e = expected.select("source_id", "i", F.col("s1").alias("expected_s1"), F.col("s2").alias("expected_s2"))
    same = F.col("decoded_s1").eqNullSafe(F.col("expected_s1")) & F.col("decoded_s2").eqNullSafe(F.col("expected_s2"))
    return e.join(d, ["source_id", "i"], "full_outer").where(~same)
