"""Structured Streaming detector.

``readStream`` (any source with a ``value STRING`` column: Kafka when its
connector is on the classpath, files in tests) -> one ``foreachBatch`` that
runs :func:`detect` on the micro-batch (static join with the dictionaries,
vectorised block coder), persists the result once and writes:

* the archive of every scored frame (Parquet, partitioned by batch id and by
  the frames' own UTC event date and hour, sorted by patient and frame
  inside the files so Parquet statistics prune on patient without one
  small file per patient; nothing in the partition depends on the clock, so
  dynamic overwrite makes a replayed batch idempotent whenever it runs),
* the anomalies (``score > 0.9``) as JSON records,
* the quarantine (malformed, bad source, bad length, no dictionary).

Offsets and progress live in ``checkpointLocation``; after a restart the
query resumes where it stopped instead of skipping data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapecode.config import ANOMALY_THRESHOLD, STREAM_WINDOWS, SIGNAL_WINDOW
from shapecode.plans.detect import anomalies, detect, with_time_path
from shapecode.sinks.writers import anomaly_json, anomaly_records, utc
from shapecode.streaming.committed import CommittedTable


def kafka_frames(spark: SparkSession, servers: str, topics: str, starting: str = "latest") -> DataFrame:
    """Frame events from Kafka (needs the Kafka connector package)."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topics).option("startingOffsets", starting).load()
            .select(F.col("value").cast("string").alias("value")))


def file_frames(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Frame events as JSON lines in files (tests, replays; T7 pacing)."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def _write_archive(b: DataFrame, archive_path: str) -> None:
    """Scored frames, partitioned by batch id and event date/hour (UTC), sorted by patient.

    An hour's frames are brought together first (large hours split by size), so
    a batch leaves a few files an hour, not one an hour and task.
    """
    at = utc(F.col("event_time"))
    (b.where(F.col("status") == "ok").withColumn("date", F.to_date(at)).withColumn("hour", F.hour(at))
     .hint("rebalance", "date", "hour").sortWithinPartitions("patient_id", "frame_ref")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id", "date", "hour").parquet(archive_path))


def _write_alerts(b: DataFrame, anomaly_path: str, quarantine_path: str, batch_id: int, threshold: float) -> None:
    """Anomaly JSON records (strict ``>``) and the quarantine of the batch."""
    (anomaly_json(anomalies(b.where(F.col("status") == "ok"), threshold)).withColumn("batch_id", F.lit(batch_id))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").text(anomaly_path))
    (b.where(F.col("status") != "ok").select("srcId", "frameRef", "patient_id", "status", "batch_id")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(quarantine_path))


def _prepared(batch: DataFrame, batch_id: int, score) -> DataFrame:
    scored = score(batch) if score is not None else batch
    return with_time_path(scored).withColumn("batch_id", F.lit(batch_id))


def batch_counts(b: DataFrame, threshold: float) -> dict[str, int]:
    """Frames, scored frames, anomalies and quarantined rows of a scored batch."""
    ok = F.col("status") == "ok"
    return b.agg(F.count(F.lit(1)).alias("frames"), F.count_if(ok).alias("scored"),
                 F.count_if(ok & (F.col("score") > F.lit(threshold))).alias("anomalies"),
                 F.count_if(~ok).alias("quarantined")).first().asDict()


def batch_writer(archive_path: str | None, anomaly_path: str | None, quarantine_path: str | None,
                 threshold: float = ANOMALY_THRESHOLD, score=None, on_counts=None):
    """The ``foreachBatch`` body (T3): score the micro-batch (a static
    DataFrame, so the block coder may group it), persist once, write the
    archive and/or the anomalies and quarantine, unpersist.  The counts that
    fill the persisted batch also tell whether it is empty (P15) and go to
    ``on_counts(batch_id, counts)`` (T8)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        b = _prepared(batch, batch_id, score).persist()
        try:
            counts = batch_counts(b, threshold)
            if on_counts:
                on_counts(batch_id, counts)
            if counts["frames"] == 0:          # P15: skip empty batches
                return
            if archive_path:
                _write_archive(b, archive_path)
            if anomaly_path:
                _write_alerts(b, anomaly_path, quarantine_path, batch_id, threshold)
        finally:
            b.unpersist()
    return write


def start_detector(events: DataFrame, packed_books: DataFrame, archive_path: str, anomaly_path: str,
                   quarantine_path: str, checkpoint_location: str, trigger: str | None = "2 seconds",
                   available_now: bool = False, w: int = SIGNAL_WINDOW, n: int = STREAM_WINDOWS,
                   threshold: float = ANOMALY_THRESHOLD, on_counts=None):
    """Start the detector; returns the ``StreamingQuery``.

    ``packed_books`` is the packed dictionary table, or a function without
    arguments that reads it: it is called for every micro-batch, so a
    dictionary saved meanwhile is used without a restart.

    ``trigger`` is the micro-batch interval (T1); ``available_now`` drains
    what is there and stops (tests, catch-up runs).  Batch counts go to
    ``on_counts(batch_id, counts)`` (T8).
    """
    def score(batch: DataFrame) -> DataFrame:
        return detect(batch, packed_books() if callable(packed_books) else packed_books, w, n)

    q = (events.writeStream
         .foreachBatch(batch_writer(archive_path, anomaly_path, quarantine_path, threshold, score, on_counts))
         .option("checkpointLocation", checkpoint_location))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime=trigger)
    return q.start()


# Rows of the committed tables.
ANOMALIES = "srcId string, srcTs double, frameRef double, maxLoss double, timePathRef string, dataSlice string"
SCORED = ("srcId string, srcTs double, frameRef double, patient_id string, frame_ref bigint, event_time timestamp, frame array<double>, "
          "src array<double>, coded array<double>, loss array<double>, score double, codes string, status string, time_path string")
ARCHIVE = SCORED + ", date date, hour int"


def anomaly_table(spark: SparkSession, root: str) -> CommittedTable:
    return CommittedTable(spark, f"{root}/anomalies", ANOMALIES)


def archive_table(spark: SparkSession, root: str) -> CommittedTable:
    return CommittedTable(spark, f"{root}/archive", ARCHIVE, ("date", "hour"))


def scored_table(spark: SparkSession, root: str) -> CommittedTable:
    return CommittedTable(spark, f"{root}/scored", SCORED)


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def start_split_detector(events: DataFrame, packed_books, root: str, checkpoint_root: str, alert_trigger: str | None = "2 seconds",
                         archive_trigger: str | None = "8 seconds", w: int = SIGNAL_WINDOW, n: int = STREAM_WINDOWS,
                         threshold: float = ANOMALY_THRESHOLD, on_counts=None):
    """Alerts every 2 s and the archive in 8 s batches, every event scored once.

    The first query scores a micro-batch and appends its anomalies, its
    quarantine and its scored frames to committed tables below ``root``; the
    second reads the ledger of the scored frames as a stream and appends what
    was committed in the last 8 s to the archive, without scoring.  A batch
    that is replayed after a failure leaves each record once.  A trigger of
    ``None`` means ``availableNow``: the first query is drained before the
    second starts.  ``packed_books`` as in :func:`start_detector`.
    """
    spark = events.sparkSession
    scored, alerts, archive = scored_table(spark, root), anomaly_table(spark, root), archive_table(spark, root)

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        books = packed_books() if callable(packed_books) else packed_books
        b = _prepared(batch, batch_id, lambda x: detect(x, books, w, n)).persist()
        try:
            counts = batch_counts(b, threshold)
            if on_counts:
                on_counts(batch_id, counts)
            if counts["frames"] == 0:
                return
            alerts.append(anomaly_records(anomalies(b, threshold)), batch_id)
            (b.where(F.col("status") != "ok").select("srcId", "frameRef", "patient_id", "status", "batch_id")
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{root}/quarantine"))
            # last: a batch that is part of the scored table has left its other records
            scored.append(b.where(F.col("status") == "ok").select(*_columns(SCORED)), batch_id)
        finally:
            b.unpersist()

    def archive_batch(commits: DataFrame, batch_id: int) -> None:
        names = [r.segment for r in commits.where("replaces IS NULL AND rows > 0").select("segment").collect()]   # the commits of one interval
        if names:
            at = utc(F.col("event_time"))
            rows = scored.segments(sorted(names)).withColumn("date", F.to_date(at)).withColumn("hour", F.hour(at))
            archive.append(rows.sortWithinPartitions("date", "hour", "patient_id", "frame_ref"), batch_id)

    def start(stream: DataFrame, body, name: str, trigger: str | None):
        q = stream.writeStream.foreachBatch(body).option("checkpointLocation", f"{checkpoint_root}/{name}")
        q = (q.trigger(availableNow=True) if trigger is None else q.trigger(processingTime=trigger)).start()
        if trigger is None:
            q.awaitTermination()
        return q

    return start(events, score_batch, "alerts", alert_trigger), start(scored.stream_of_commits(), archive_batch, "archive", archive_trigger)
