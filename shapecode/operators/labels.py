"""Annotations -> frame labels (S9 parsing lives in sources.text; A11, A17).

A frame's label is ``N`` followed by every non-``N`` code that falls in it,
in annotation order (so ``NV``, ``N+``).  The number of frames of a record
is ``ceil(last annotated sample / frame_len)`` where *last* is the sample of
the last annotation line.  A code at or past ``n_frames * frame_len`` lies
outside the labelled frames; it is reported by :func:`out_of_range_codes`
instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapecode.config import NORMAL_CODE


def distributed_range(df: DataFrame, n_col: str, out: str, chunk: int = 4096) -> DataFrame:
    """Rows ``0 .. n-1`` for every input row, generated in chunks.

    A one-step ``explode(sequence(0, n-1))`` makes one task emit all rows of
    a long record; exploding chunk ids first and repartitioning spreads the
    second explode over all tasks.
    """
    chunks = df.withColumn("_c", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col(n_col) - 1) / F.lit(chunk)).cast("bigint"))))
    keys = [c for c in df.columns if c != n_col]
    chunks = chunks.where(F.col(n_col) > 0).repartition(*keys, "_c")
    lo = F.col("_c") * F.lit(chunk)
    hi = F.least(lo + F.lit(chunk - 1), F.col(n_col) - 1)
    return chunks.withColumn(out, F.explode(F.sequence(lo, hi))).drop("_c")


def record_extent(annotations: DataFrame, frame_len: int) -> DataFrame:
    """A17 + frame count: ``(record_id, last_sample, n_frames)``."""
    last = annotations.groupBy("record_id").agg(F.max_by("sample", "line_no").alias("last_sample"))
    return last.withColumn("n_frames", F.ceil(F.col("last_sample") / F.lit(frame_len)).cast("bigint"))


def frame_labels(annotations: DataFrame, frame_len: int) -> DataFrame:
    """``(record_id, frame_ref, label)`` for every frame of every record.

    ``annotations(record_id, line_no, sample, code)``.  Codes are grouped per
    (record, frame) -- a bounded group -- and ordered by line number.
    """
    ext = record_extent(annotations, frame_len)
    frames = distributed_range(ext.select("record_id", "n_frames"), "n_frames", "frame_no")
    codes = (
        annotations.where(F.col("code") != F.lit(NORMAL_CODE))
        .withColumn("frame_no", F.floor(F.col("sample") / F.lit(frame_len)).cast("bigint"))
        .groupBy("record_id", "frame_no")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "code"))),
                                      lambda z: z["code"]), "").alias("extra"))
    )
    out = frames.join(codes, ["record_id", "frame_no"], "left")
    return out.select(
        "record_id", (F.col("frame_no") * F.lit(frame_len)).alias("frame_ref"),
        F.concat(F.lit(NORMAL_CODE), F.coalesce("extra", F.lit(""))).alias("label"))


def out_of_range_codes(annotations: DataFrame, frame_len: int) -> DataFrame:
    """Annotations whose frame lies past the labelled frames (the quarantine)."""
    ext = record_extent(annotations, frame_len)
    return (annotations.join(ext, "record_id")
            .where((F.col("code") != F.lit(NORMAL_CODE)) &
                   (F.floor(F.col("sample") / F.lit(frame_len)) >= F.col("n_frames")))
            .select("record_id", "line_no", "sample", "code", "n_frames"))
