"""Sinks (K1-K13).  All writes are executor-side DataFrame writes.

Text forms reproduce the reference layouts; Parquet forms are the ones to
use at scale (columnar, partition-pruned on ``patient_id`` / date / hour,
and ``score`` kept as a top-level column so evaluation reads no arrays).
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapecode.config import DATA_SLICE_CHARS
from shapecode.functions import arrays as A
from shapecode.sources.tables import table_name


def num_list(col: str | Column, sep: str = ",") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)


def payload(src="src", coded="coded", loss="loss") -> Column:
    """``;src;coded;loss;`` comma lists."""
    return F.concat(F.lit(";"), num_list(src), F.lit(";"), num_list(coded), F.lit(";"), num_list(loss), F.lit(";"))


def date_path(ts: Column) -> Column:
    """UTC ``yyyy/MM/dd/H/`` path of an event time, whatever the session's zone."""
    at = utc(ts)
    return F.concat(F.translate(F.to_date(at).cast("string"), "-", "/"), F.lit("/"), F.hour(at).cast("string"), F.lit("/"))


def utc(ts: Column) -> Column:
    """The instant's UTC wall clock as a timestamp without zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def time_of_day_key(ts: Column) -> Column:
    """Second of minute and millisecond of day, ``s-A`` (UTC), e.g. ``7-3607123``.

    Spark has no pattern letter for milli-of-day, so it is computed.
    """
    day_ms = F.pmod(F.unix_millis(ts), F.lit(86_400_000))
    second = F.floor(day_ms / F.lit(1000)).cast("long") % F.lit(60)
    return F.concat(second.cast("string"), F.lit("-"), day_ms.cast("string"))


def archive_lines(coded: DataFrame) -> DataFrame:
    """K1 text form: ``(srcId,srcTs,frameRef,maxErr,path,;src;coded;loss;)``."""
    return coded.select(F.concat(
        F.lit("("), F.col("srcId"), F.lit(","), F.col("srcTs").cast("string"), F.lit(","),
        F.col("frame_ref").cast("double").cast("string"), F.lit(","), F.col("score").cast("string"), F.lit(","),
        F.col("time_path"), F.lit(","), payload(), F.lit(")")).alias("value"))


def write_archive(coded: DataFrame, path: str, mode: str = "append") -> None:
    """K1 at scale: Parquet partitioned by UTC event date and hour, sorted by
    patient and frame inside the files (row-group statistics prune on patient).
    The partition follows from the row, so a replay writes to the same one."""
    at = utc(F.col("event_time"))
    (coded.withColumn("date", F.to_date(at)).withColumn("hour", F.hour(at))
     .sortWithinPartitions("patient_id", "frame_ref")
     .write.mode(mode).partitionBy("date", "hour").parquet(path))


def anomaly_records(coded: DataFrame) -> DataFrame:
    """P5/K2: the six-field anomaly record; ``dataSlice`` = first 60 characters."""
    return coded.select(
        F.col("srcId"), F.col("srcTs"), F.col("frame_ref").cast("double").alias("frameRef"),
        F.col("score").alias("maxLoss"), F.col("time_path").alias("timePathRef"),
        F.substring(payload(), 1, DATA_SLICE_CHARS).alias("dataSlice"))


def anomaly_json(coded: DataFrame) -> DataFrame:
    rec = anomaly_records(coded)
    return rec.select(F.to_json(F.struct(*rec.columns)).alias("value"))


def batch_coded_lines(coded: DataFrame) -> DataFrame:
    """K5: ``src;coded;loss``."""
    return coded.select(F.concat_ws(";", num_list("src"), num_list("coded"), num_list("loss")).alias("value"))


def frame_lines(frames: DataFrame, col: str = "frame") -> DataFrame:
    """One comma list per frame or window."""
    return frames.select(num_list(col).alias("value"))


def label_lines(labels: DataFrame) -> DataFrame:
    """K6: ``frameStart,label``."""
    return labels.select(F.concat_ws(",", F.col("frame_ref").cast("string"), F.col("label")).alias("value"))


def export_labels(labels: DataFrame, path: str, mode: str = "append") -> None:
    """K6 for many records: ``record,frameStart,label`` text in order of record and frame.

    A file holds the labels of many records, so files follow the size of the
    labels, not the number of records; a long record spans files.
    """
    (labels.repartitionByRange("record_id", "frame_ref").sortWithinPartitions("record_id", "frame_ref")
     .select(F.concat_ws(",", F.col("record_id").cast("string"), F.col("frame_ref").cast("string"), "label").alias("value"))
     .write.mode(mode).text(path))


def export_apnea(apnea: DataFrame, path: str, buckets: int = 64, mode: str = "append") -> None:
    """``record,line`` text, a folder for each bucket of records (not one a record)."""
    (apnea.select(F.concat(F.col("record_id").cast("string"), F.lit(","), F.col("line")).alias("value"),
                  F.pmod(F.xxhash64("record_id"), F.lit(buckets)).cast("int").alias("bucket"))
     .write.mode(mode).partitionBy("bucket").text(path))


def save_codebook(codebook: DataFrame, path: str, w: int, step: int) -> None:
    """K7: dictionaries named by patient, window size and step.

    Appends a new version below ``w_size=/step=`` and deletes nothing: other
    sizes, steps and patients stay, and ``load_codebook`` takes the newest
    version of each patient.  One folder per size and step, not per patient.
    """
    (codebook.withColumn("patient_id", F.col("source_id").cast("string"))
     .withColumn("version", F.lit(time.time_ns()))
     .withColumn("w_size", F.lit(w)).withColumn("step", F.lit(step))
     .sortWithinPartitions("patient_id", "code")
     .write.mode("append").partitionBy("w_size", "step").parquet(path))


def load_codebook(spark, path: str, w: int, step: int) -> DataFrame:
    """The newest dictionary of every patient for one window size and step."""
    df = spark.read.parquet(path).where((F.col("w_size") == w) & (F.col("step") == step))
    newest = df.groupBy("patient_id").agg(F.max("version").alias("version"))
    # a row a patient on one side, all their codes on the other: neither is broadcast
    return df.join(newest.hint("merge"), ["patient_id", "version"], "left_semi").select("patient_id", "source_id", "code", "center")


def write_table(df: DataFrame, path_or_table: str, fmt: str = "parquet", mode: str = "append",
                default_project: str | None = None) -> None:
    """K8: warehouse write, ``overwrite`` (truncate) or ``append``.

    Takes the ids that ``warehouse_table`` takes (``project:dataset.table``,
    ``:dataset.table``, ``dataset.table``) or a path, which holds a ``/``.
    """
    w = df.write.mode(mode).format(fmt)
    if "/" in path_or_table:
        w.save(path_or_table)
    else:
        w.saveAsTable(table_name(path_or_table, default_project))


def write_bucketed(df: DataFrame, table: str, cols: list[str], buckets: int, mode: str = "overwrite") -> None:
    """A catalog table bucketed and sorted by ``cols``: joins on them with a table of as many buckets need no shuffle.

    Rows are dealt by bucket first (``repartition`` hashes as ``bucketBy`` does), so a
    bucket is one file, not one for every task that had rows of it.
    """
    df.repartition(buckets, *cols).write.mode(mode).bucketBy(buckets, *cols).sortBy(*cols).saveAsTable(table)


def register_view(df: DataFrame, name: str) -> DataFrame:
    """K12."""
    df.createOrReplaceTempView(name)
    return df


def export_channel(samples: DataFrame, path: str, channel: int = 1, mode: str = "overwrite") -> None:
    """One channel of decoded recordings as its own table, sorted by source and
    sample inside the files (statistics prune on the source; no folder a source)."""
    (samples.where(F.col("channel") == F.lit(channel)).select("source_id", "i", "raw")
     .sortWithinPartitions("source_id", "i").write.mode(mode).parquet(path))


def normalised_windows(frames: DataFrame, w: int, n: int) -> DataFrame:
    """K13 rows: every half-overlapping window, centred and divided by its norm, not tapered
    (an all-zero window has none)."""
    f = frames.select("source_id", "frame_no", "frame_ref", F.posexplode(F.expr(A.windows_expr("frame", w, n))).alias("k", "x"))
    f = f.select("source_id", "frame_no", "frame_ref", "k", "x", F.expr(f"{A.sum_expr('x')} / {w}").alias("avg"),
                 F.expr(f"sqrt({A.sumsq_expr('x')})").alias("nrm")).where("nrm <> 0D")
    return f.select("source_id", "frame_no", "frame_ref", "k", F.expr("transform(x, v -> (v - avg) / nrm)").alias("window"))


def export_training_windows(windows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K4: the training windows (replaces the reference's CSV round trip)."""
    windows.write.mode(mode).parquet(path)
