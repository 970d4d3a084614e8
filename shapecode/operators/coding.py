"""Dictionary coding of frames.

A frame row carries its windows as ``array<array<double>>``; windows,
statistics, features, the nearest code, the reconstruction and the residual
are all higher-order expressions inside that row.  The only data movement is
one join that attaches the packed dictionary of the frame's source (J2).

Modes: ``centered`` (variant A, online detector; the dictionary is trained on
these features) and ``tapered`` (variant B, batch coder).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapecode.functions import arrays as A

MODES = ("centered", "tapered")


def with_windows(frames: DataFrame, w: int, n: int) -> DataFrame:
    return frames.withColumn("wins", F.expr(A.windows_expr("frame", w, n)))


def with_features(frames: DataFrame, w: int, n: int, mode: str = "centered") -> DataFrame:
    """Adds ``wins, avgs, nrms, feats`` (and ``tnrms`` for the tapered mode)."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    taper = A.array_literal(A.taper_values(w))
    df = with_windows(frames, w, n)
    df = df.withColumn("avgs", F.expr(A.means_expr("wins", w)))
    df = df.withColumn("nrms", F.expr(A.norms_expr("wins")))
    if mode == "centered":
        return df.withColumn("feats", F.expr(A.centered_features_expr("wins", "avgs", "nrms", taper)))
    df = df.withColumn("_tw", F.expr(A.tapered_windows_expr("wins", taper)))
    df = df.withColumn("tnrms", F.expr(A.norms_expr("_tw")))
    return df.withColumn("feats", F.expr(A.tapered_features_expr("_tw", "tnrms"))).drop("_tw")


def window_rows(frames_with_feats: DataFrame) -> DataFrame:
    """One row per window: ``(source_id, frame_no, frame_ref, k, avg, nrm, feat)``."""
    z = F.arrays_zip(F.col("avgs").alias("avg"), F.col("nrms").alias("nrm"), F.col("feats").alias("feat"))
    return frames_with_feats.select(
        "source_id", "frame_no", "frame_ref", F.posexplode(z).alias("k", "z")
    ).select("source_id", "frame_no", "frame_ref", "k", "z.avg", "z.nrm", "z.feat")


def first_frame_codebook(frames: DataFrame, w: int, n: int, mode: str = "centered") -> DataFrame:
    """Dictionary = the features of each source's first frame (code = window k).

    Long form ``codebook(source_id, code, center)``; all-zero windows give no code.
    """
    f0 = A.fence(with_features(frames.where(F.col("frame_no") == 0), w, n, mode))
    return (f0.select("source_id", F.posexplode("feats").alias("code", "center"))
            .where(F.col("center").isNotNull())
            .select("source_id", F.col("code").cast("int").alias("code"), "center"))


def pack_codebook(codebook: DataFrame) -> DataFrame:
    """Long codebook -> one row per source ``book: array<struct<code, center>>``.

    The group is one dictionary (bounded by its size k), sorted by code.
    """
    return codebook.groupBy("source_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("code").cast("int").alias("code"),
                                             F.col("center")))).alias("book"))


def attach_codebook(frames: DataFrame, packed: DataFrame) -> DataFrame:
    """Stream-static or batch left join on the source.

    Frames without a dictionary are kept (``book`` NULL).  The planner picks
    the strategy from measured sizes (AQE): a broadcast when the dictionaries
    are small, a shuffled join with skew splitting of hot sources otherwise.
    """
    return frames.join(packed, "source_id", "left")


def encode(frames_with_book: DataFrame, w: int, n: int, mode: str = "centered") -> DataFrame:
    """J3 + W7/W8 + P6 + W9 + A5 on frames that carry ``book``.

    Adds ``best`` (per-window struct(d, code, center)), ``coded``, ``src``,
    ``loss``, ``score`` and ``status`` ('ok' | 'no_model' | 'single_window':
    a one-window frame has nothing to rebuild and no score).
    """
    df = with_features(frames_with_book, w, n, mode)
    df = df.withColumn("best", F.expr(A.nearest_expr("feats", "book")))
    df = df.withColumn("cents", F.expr(A.centers_expr("best", w)))
    if mode == "centered":
        coded = A.reconstruct_centered_expr("cents", "avgs", "nrms", w)
    else:
        coded = A.reconstruct_tapered_expr("cents", "tnrms", w)
    df = df.withColumn("coded", F.when(F.col("book").isNotNull(), F.expr(coded)))
    df = df.withColumn("src", F.slice("frame", F.lit(w // 2 + 1), F.lit(n * w - w) if n else F.size("frame") - F.lit(w)))
    df = df.withColumn("loss", F.expr(A.residual_expr("src", "coded")))
    df = df.withColumn("score", F.expr(A.max_abs_expr("loss")))
    df = df.withColumn("status", F.when(F.col("book").isNull(), F.lit("no_model"))
                       .when(F.size("coded") == 0, F.lit("single_window")).otherwise(F.lit("ok")))
    return A.fence(df.drop("book"))


def codes_string(best_col: str = "best"):
    """Chosen codes as text, ``-`` for a window without a code."""
    return F.array_join(F.transform(best_col, lambda b: F.coalesce(b["code"].cast("string"), F.lit("-"))), ",")


def score_frames(frames: DataFrame, packed: DataFrame, w: int, n: int, mode: str = "centered") -> DataFrame:
    """W10 batch form: frames x dictionary -> coded frames with score."""
    return encode(attach_codebook(frames, packed), w, n, mode)
