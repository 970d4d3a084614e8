"""Registered queries over the file formats: data packed from the tables into
files below the shared checkpoint folder, then read back with the readers.

Binary files are written and read by the splittable ``fixed_records`` source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapecode.config import ANOMALY_THRESHOLD, EVENTS
from shapecode.functions import arrays as A
from shapecode.operators import evaluate as EV
from shapecode.operators import framing
from shapecode.operators import labels as LB
from shapecode.plans import queries as P
from shapecode.plans import sqlgen as Q
from shapecode.plans.queries import LI, register, scratch_dir
from shapecode.session import cut_lineage
from shapecode.sinks import writers as WR
from shapecode.sources import binary as BIN
from shapecode.sources import events as EVT
from shapecode.sources import records as REC
from shapecode.sources import tables as TB
from shapecode.sources import text as TXT


def _source_id():
    return F.regexp_extract("path", r"source_id=([^/]+)", 1).cast("bigint").alias("source_id")


def _through_files(spark, records: DataFrame, layout: str, name: str) -> DataFrame:
    """``(source_id, i, _hex)`` records written as binary files and read back in splits of whole records."""
    path = scratch_dir(spark, name)
    REC.write_records(BIN.pack_records(records, "_hex"), path, REC.LAYOUTS[layout][0])
    return REC.read_records(spark, path, layout)


@register("decode_212_files", P._DEC_SQL + " SELECT source_id, i, s1, s2 FROM samples")
def decode_212_files(spark, sf_dir):
    """S3 from files: format-212 recordings written, listed, split and decoded."""
    path = scratch_dir(spark, "f212")
    REC.write_records(BIN.pack_212(P._expected_212(spark, sf_dir)), path, 3)
    return REC.read_records(spark, path, "212").select(_source_id(), "i", "s1", "s2")


_DAMAGED = "i % 97 = 13"


@register("decode_mismatches", P._DEC_SQL + (
    f" SELECT source_id, i, s1 AS expected_s1, s2 AS expected_s2, xor(s1, 5) AS decoded_s1, s2 AS decoded_s2 FROM samples WHERE {_DAMAGED}"))
def decode_mismatches(spark, sf_dir):
    """J4 on files with damaged records: every decoded sample that differs from the reference sample, with both values."""
    expected = P._expected_212(spark, sf_dir)
    hurt = expected.withColumn("s1", F.when(F.expr(_DAMAGED), F.col("s1").bitwiseXOR(F.lit(5))).otherwise(F.col("s1")))
    path = scratch_dir(spark, "f212")
    REC.write_records(BIN.pack_212(hurt), path, 3)
    decoded = REC.read_records(spark, path, "212").select(_source_id(), "i", "s1", "s2")
    return EV.decode_mismatches(decoded, expected)


_LE16 = "CAST(l_quantity AS INT) - 25 * CAST(l_partkey % 7 AS INT)"


@register("decode_le16_files", (
    f"SELECT CAST(l_suppkey AS BIGINT) AS source_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(LI.order_cols)}) - 1 "
    f"AS BIGINT) AS i, {_LE16} AS raw FROM lineitem WHERE l_suppkey IS NOT NULL AND l_quantity IS NOT NULL"))
def decode_le16_files(spark, sf_dir):
    """S4 from files: signed 16-bit little-endian samples, negative ones included."""
    s = TB.signal_samples(spark, sf_dir, LI, extra={"v": _LE16})
    u = F.pmod("v", F.lit(65536))
    rec = F.concat(F.lpad(F.hex(u.bitwiseAND(0xFF)), 2, "0"), F.lpad(F.hex(F.shiftright(u, 8)), 2, "0"))
    return _through_files(spark, s.withColumn("_hex", rec), "le16", "le16").select(_source_id(), "i", "raw")


@register("apnea_files", P.REGISTRY["apnea_labels"][1])
def apnea_files(spark, sf_dir):
    """S10 -> K10 -> S10: annotation records read from files, their text lines written, one folder a bucket of records, and read back."""
    s = TB.signal_samples(spark, sf_dir, EVENTS, extra={"_b1": "CASE WHEN event_type = 'error' THEN '20' ELSE '10' END"})
    rec = s.withColumn("_hex", F.concat(F.lit("00"), F.col("_b1"), F.lit("000000000000")))
    d = BIN.apnea_rows(_through_files(spark, rec, "apnea", "apnea").withColumn("record_id", _source_id()), F.col("mark"))
    path = scratch_dir(spark, "apnea-lines")
    WR.export_apnea(d, path)
    return TXT.read_apnea(spark, path)


@register("channel_export", P._DEC_SQL + " SELECT source_id, i, s1 AS raw FROM samples")
def channel_export(spark, sf_dir):
    """P12 + K11: channel 1 of decoded two-channel recordings, written as its own table and read back."""
    path = scratch_dir(spark, "channel")
    long = BIN.decode_212_long(BIN.pack_212(P._expected_212(spark, sf_dir)))
    WR.export_channel(long, path, channel=1)
    return spark.read.schema("i bigint, raw int, source_id bigint").parquet(path).select("source_id", "i", "raw")


@register("reference_samples_diff", P._DEC_SQL + " SELECT source_id, i, s1, s2, s1 - s2 AS diff FROM samples")
def reference_samples_diff(spark, sf_dir):
    """Tab-separated reference samples written per recording and read back with their difference."""
    path = scratch_dir(spark, "tsv")
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("i", "s1", "s2")]
    REC.write_lines(P._expected_212(spark, sf_dir).select("source_id", "i", F.concat_ws("\t", *text).alias("line")), path)
    d = TXT.read_reference_samples(spark, path)
    return d.select(F.regexp_extract("_path", r"source_id=([^/]+)", 1).cast("bigint").alias("source_id"), "i", "s1", "s2", "diff")


@register("frames_csv", (
    f"WITH samples AS ({Q.samples_cte(LI)}), frames AS ({Q.frames_cte(LI)}) "
    f"SELECT frame[1] AS first_value, frame[{LI.frame_len}] AS last_value, {Q.lsum('frame')} AS total FROM frames"))
def frames_csv(spark, sf_dir):
    """K3 -> S5: one comma list per frame."""
    path = scratch_dir(spark, "frames")
    WR.frame_lines(P.frames_of(spark, sf_dir, LI)).write.text(path)
    f = TXT.read_frames_csv(spark, path)
    return f.select(F.col("frame")[0].alias("first_value"), F.col("frame")[LI.frame_len - 1].alias("last_value"),
                    F.aggregate("frame", F.lit(0.0), lambda a, v: a + v).alias("total"))


@register("batch_coded_roundtrip", Q.trained_prefix(LI, "tapered") + f", ca AS ({Q.coded_arrays_select(LI)}) " + (
    f"SELECT CAST(len(src) AS BIGINT) AS n_src, {Q.lsum('coded')} AS coded_sum, {Q.lsum('loss')} AS loss_sum, score AS max_loss FROM ca"))
def batch_coded_roundtrip(spark, sf_dir):
    """Batch coder as used: frames, a dictionary trained on variant A, W8, K5 lines, S7."""
    path = scratch_dir(spark, "coded")
    WR.batch_coded_lines(P.scored(spark, sf_dir, LI, "tapered")).write.text(path)
    c = TXT.parse_batch_coded(spark.read.text(path))
    total = lambda col: F.aggregate(col, F.lit(0.0), lambda a, v: a + v)
    return c.select(F.size("src").cast("bigint").alias("n_src"), total("coded").alias("coded_sum"),
                    total("loss").alias("loss_sum"), F.expr(A.max_abs_expr("loss")).alias("max_loss"))


def _write_labels(labels: DataFrame, path: str) -> None:
    """``frameStart,label`` lines, one folder a record and one file in it (more where a record spans tasks)."""
    lines = labels.select(F.col("record_id").alias("source_id"), F.floor(F.col("frame_ref") / LI.frame_len).cast("bigint").alias("i"),
                          F.concat_ws(",", F.col("frame_ref").cast("string"), "label").alias("line"))
    REC.write_lines(lines, path)


def _read_labels(spark, path: str) -> DataFrame:
    return TXT.read_labels(spark, path).select(
        F.regexp_extract("_path", r"source_id=([^/]+)", 1).cast("bigint").alias("record_id"), "frame_ref", "label")


@register("labels_csv", P._LAB_LI + " SELECT record_id, frame_ref, label FROM labels")
def labels_csv(spark, sf_dir):
    """K6 -> S8: ``frameStart,label`` files, one folder a record."""
    path = scratch_dir(spark, "labels")
    _write_labels(P.labels_of(spark, sf_dir, LI), path)
    return _read_labels(spark, path)


@register("annotation_text_labels", P._LAB_LI + " SELECT record_id, frame_ref, label FROM labels")
def annotation_text_labels(spark, sf_dir):
    """S9 -> A11 -> K6 -> S8: annotation listings parsed in line order, labels written and read back."""
    ann = TB.signal_annotations(spark, sf_dir, LI)
    line = F.format_string("    0:%02d.000  %d     %s", (F.col("sample") % 60).cast("int"), "sample", "code")
    path, out = scratch_dir(spark, "annotations"), scratch_dir(spark, "labels")
    REC.write_lines(ann.select(F.col("record_id").alias("source_id"), F.col("line_no").alias("i"), line.alias("line")), path, one_file=True)
    read = TXT.read_annotations(spark, path, r"source_id=([^/]+)").withColumn("record_id", F.col("record_id").cast("bigint"))
    _write_labels(LB.frame_labels(read, LI.frame_len), out)
    return _read_labels(spark, out)


def _archive_and_labels(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Scored frames and labels written as text and parsed back (K1, S6; K6, S8); no file or folder a record."""
    path, lab = scratch_dir(spark, "archive"), scratch_dir(spark, "labels")
    # indexed with the codes first: the dictionary, the labels and the cut-offs read the same table
    samples = TB.signal_samples(spark, sf_dir, LI, extra={"code": TB.ANNOTATION_CODES["lineitem"]})
    sc = P.scored(spark, sf_dir, LI, "centered", samples=samples)
    sc = sc.withColumns({"srcId": F.col("source_id").cast("string"), "srcTs": F.lit(0.0), "time_path": F.lit("batch/")})
    WR.archive_lines(sc).write.text(path)
    WR.export_labels(P.labels_of(spark, sf_dir, LI), lab)
    frames = TXT.parse_archive(spark.read.text(path)).select(
        F.col("srcId").cast("bigint").alias("source_id"), "frame_ref", F.col("max_err").alias("score"))
    return frames, TXT.read_labels(spark, lab, with_record=True).select("record_id", "frame_ref", "label")


def _test_error(spark, sf_dir, frames: DataFrame, labels: DataFrame) -> DataFrame:
    """The files are parsed and joined once: the split counts its rows several times, and both its sides are read."""
    lf = EV.with_region(EV.labelled_frames(frames, labels), P.cutoffs_of(TB.signal_samples(spark, sf_dir, LI)))
    rest = cut_lineage(lf.where(F.col("region") == "rest").select("source_id", "frame_ref", "label", "score"))
    sp = cut_lineage(EV.split_validation_test(rest))
    best = EV.best_threshold(EV.threshold_sweep(sp.where(F.col("split") == "validation")))
    return EV.errors_at(sp.where(F.col("split") == "test"), best.select("t").scalar())


@register("archive_test_error", P._EVAL_PRE + P._errors_sql("tst", "(SELECT t FROM best)"))
def archive_test_error(spark, sf_dir):
    """Evaluation from files: S6 archive + S8 labels -> J1 -> P4 -> L4 -> A9 -> A10 -> A8."""
    return _test_error(spark, sf_dir, *_archive_and_labels(spark, sf_dir))


BUCKETS = 8


def bucketed_archive(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The parsed archive and labels as catalog tables bucketed by (source, frame)."""
    frames, labels = _archive_and_labels(spark, sf_dir)
    path = scratch_dir(spark, "buckets")
    db = "shapecode_" + path.rpartition("-")[2]
    spark.sql(f"CREATE DATABASE {db} LOCATION '{path}'")
    WR.write_bucketed(frames, f"{db}.archive", ["source_id", "frame_ref"], BUCKETS)
    WR.write_bucketed(labels, f"{db}.labels", ["record_id", "frame_ref"], BUCKETS)
    return spark.table(f"{db}.archive"), spark.table(f"{db}.labels")


@register("archive_test_error_bucketed", P._EVAL_PRE + P._errors_sql("tst", "(SELECT t FROM best)"))
def archive_test_error_bucketed(spark, sf_dir):
    """J1 on co-partitioned tables: archive and labels bucketed alike meet without a shuffle of either."""
    return _test_error(spark, sf_dir, *bucketed_archive(spark, sf_dir))


@register("warehouse_roundtrip", f"WITH samples AS ({Q.samples_cte(EVENTS)}) SELECT source_id, i, value FROM samples")
def warehouse_roundtrip(spark, sf_dir):
    """K8 -> S12: a table overwritten, then appended to in halves, and read back."""
    path = scratch_dir(spark, "warehouse")
    s = TB.signal_samples(spark, sf_dir, EVENTS).select("source_id", "i", "value")
    WR.write_table(s, path, mode="overwrite")
    WR.write_table(s.where("i % 2 = 0"), path, mode="overwrite")
    WR.write_table(s.where("i % 2 = 1"), path, mode="append")
    return TB.warehouse_table(spark, "events", fmt="parquet", path=path)


def _replayed(spark, sf_dir) -> str:
    """The frame events replayed through the streaming detector; the folder with its outputs."""
    from shapecode.streaming.detector import file_frames, start_detector
    root = scratch_dir(spark, "stream")
    EVT.frame_events(P.raw_event_frames(spark, sf_dir)).write.text(f"{root}/in")
    P.stored_codebook(spark, sf_dir, EVENTS)
    q = start_detector(file_frames(spark, f"{root}/in"), lambda: P._event_books(spark, sf_dir), f"{root}/archive",
                       f"{root}/anomalies", f"{root}/quarantine", f"{root}/_chk", available_now=True, w=EVENTS.w, n=EVENTS.n)
    q.awaitTermination()
    return root


def _split_replayed(spark, sf_dir) -> str:
    """The frame events replayed through the split detector, twice (the second run finds nothing new); the folder with its tables."""
    from shapecode.streaming.detector import file_frames, start_split_detector
    root = scratch_dir(spark, "split")
    EVT.frame_events(P.raw_event_frames(spark, sf_dir)).repartition(3).write.text(f"{root}/in")
    P.stored_codebook(spark, sf_dir, EVENTS)
    for _ in range(2):
        start_split_detector(file_frames(spark, f"{root}/in", 1), lambda: P._event_books(spark, sf_dir), root, f"{root}/_chk", None, None,
                             EVENTS.w, EVENTS.n)
    return root


@register("stream_anomalies", Q.trained_prefix(EVENTS, "centered") + f", scores AS ({Q.scores_select(EVENTS)}), " + (
    f"ca AS ({Q.coded_arrays_select(EVENTS)}), " + Q.event_times_ctes(EVENTS) +
    "SELECT 'inj./data/' || CAST(s.source_id AS VARCHAR) || '.dat' AS srcId, t0 / 1000000 AS srcTs, CAST(s.frame_ref AS DOUBLE) AS frameRef, "
    f"s.score AS maxLoss, {Q.utc_path('t0')} AS timePathRef, {Q.data_slice('ca.src', 'ca.coded', 'ca.loss')} AS dataSlice "
    "FROM scores s JOIN t0 ON t0.source_id = s.source_id AND t0.frame_no = s.frame_no "
    "JOIN ca ON ca.source_id = s.source_id AND ca.frame_ref = s.frame_ref "
    f"WHERE s.score > {Q.dlit(ANOMALY_THRESHOLD)}"))
def stream_anomalies(spark, sf_dir):
    """P3 + P5 + K2 + K8: anomaly records of the stream in their table, appended once a batch, all six fields."""
    from shapecode.streaming.detector import anomaly_table
    return anomaly_table(spark, _split_replayed(spark, sf_dir)).read()


@register("stream_archive", P._STREAM_SQL)
def stream_archive(spark, sf_dir):
    """T2 + K1: the 8 s archive fed by the scoring query's committed frames, merged into few files."""
    from shapecode.streaming.detector import archive_table
    t = archive_table(spark, _split_replayed(spark, sf_dir))
    t.compact()
    t.vacuum()
    return t.read().select("patient_id", "frame_ref", "score", "codes", "status")


@register("stream_quarantine", "WITH " + Q.lloyd_ctes(EVENTS, 0) + (
    f", frames AS ({Q.frames_cte(EVENTS)}) SELECT CAST(source_id AS VARCHAR) AS patient_id, CAST(frame_ref AS DOUBLE) AS frameRef, "
    "'no_model' AS status FROM frames WHERE source_id NOT IN (SELECT source_id FROM c0)"))
def stream_quarantine(spark, sf_dir):
    """J2 misses of the stream: frames without a dictionary stand in the quarantine."""
    # a replay without such frames leaves no files, so the schema is given
    quarantine = spark.read.schema("srcId string, frameRef double, patient_id string, status string, batch_id int")
    return quarantine.parquet(f"{_replayed(spark, sf_dir)}/quarantine").select("patient_id", "frameRef", "status")


@register("stream_counts", "WITH " + Q.lloyd_ctes(EVENTS, 0) + f", frames AS ({Q.frames_cte(EVENTS)}) " + (
    "SELECT CAST(count(*) AS BIGINT) AS frames, CAST(count(*) FILTER (source_id IN (SELECT source_id FROM c0)) AS BIGINT) AS scored, "
    "CAST(count(*) FILTER (source_id NOT IN (SELECT source_id FROM c0)) AS BIGINT) AS quarantined FROM frames"))
def stream_counts(spark, sf_dir):
    """The counts that the detector reports for its batches, added up."""
    from shapecode.streaming.detector import file_frames, start_detector
    root, seen = scratch_dir(spark, "counts"), []
    EVT.frame_events(P.raw_event_frames(spark, sf_dir)).repartition(3).write.text(f"{root}/in")
    P.stored_codebook(spark, sf_dir, EVENTS)
    start_detector(file_frames(spark, f"{root}/in", 1), lambda: P._event_books(spark, sf_dir), f"{root}/archive", f"{root}/anomalies",
                   f"{root}/quarantine", f"{root}/_chk", available_now=True, w=EVENTS.w, n=EVENTS.n,
                   on_counts=lambda batch, c: seen.append((c["frames"], c["scored"], c["quarantined"]))).awaitTermination()
    return (spark.createDataFrame(seen, "frames bigint, scored bigint, quarantined bigint")      # a row a micro-batch
            .agg(*[F.sum(c).alias(c) for c in ("frames", "scored", "quarantined")]))


_LENGTHS = (EVENTS.frame_len, 3 * EVENTS.w, 2 * EVENTS.w + 4, EVENTS.w)


@register("mixed_frame_lengths", "WITH " + Q.lloyd_ctes(EVENTS, 0) + f", frames AS ({Q.frames_cte(EVENTS)}), " + (
    f"f AS (SELECT *, ([{', '.join(map(str, _LENGTHS))}])[CAST(frame_no % {len(_LENGTHS)} AS INTEGER) + 1] AS n FROM frames) "
    f"SELECT CAST(source_id AS VARCHAR) AS patient_id, frame_ref, CAST(n AS BIGINT) AS n_samples, CASE WHEN n % {EVENTS.w} <> 0 THEN 'bad_length' "
    f"WHEN source_id NOT IN (SELECT source_id FROM c0) THEN 'no_model' WHEN n = {EVENTS.w} THEN 'single_window' ELSE 'ok' END AS status FROM f"))
def mixed_frame_lengths(spark, sf_dir):
    """Frames of several lengths in one stream; whole numbers of windows are coded, others are named."""
    from shapecode.plans.detect import detect
    n = F.element_at(F.array(*[F.lit(x) for x in _LENGTHS]), (F.floor(F.col("frame_ref") / EVENTS.frame_len) % len(_LENGTHS)).cast("int") + 1)
    frames = P.raw_event_frames(spark, sf_dir).withColumn("frame", F.slice("frame", F.lit(1), n))
    d = detect(EVT.frame_events(frames), P._event_books(spark, sf_dir), EVENTS.w, EVENTS.n)
    return d.select("patient_id", "frame_ref", F.size("frame").cast("bigint").alias("n_samples"), "status")


@register("training_windows_export", "WITH " + ", ".join(Q.lloyd_train_ctes(LI)) + (
    f" SELECT source_id, CAST(j AS BIGINT) AS j, w[1] AS first_value, {Q.lsum('w')} AS total FROM tw"))
def training_windows_export(spark, sf_dir):
    """K4: the training windows written and read back."""
    samples = TB.signal_samples(spark, sf_dir, LI)
    path = scratch_dir(spark, "training")
    WR.export_training_windows(framing.sliding_windows(samples, LI.w, LI.step, framing.training_budget(samples, LI.w, LI.step)), path)
    return spark.read.parquet(path).select("source_id", "j", F.col("w")[0].alias("first_value"),
                                           F.aggregate("w", F.lit(0.0), lambda a, v: a + v).alias("total"))


@register("recording_inventory", P._DEC_SQL + (
    " SELECT source_id, CAST(count(*) AS BIGINT) AS n_records, CAST(CASE WHEN source_id % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS partial_files "
    "FROM samples GROUP BY 1"))
def recording_inventory(spark, sf_dir):
    """Whole records and files with a partial tail, from the listing alone."""
    blocks = BIN.pack_212(P._expected_212(spark, sf_dir))
    last = blocks.groupBy("source_id").agg(F.max("i0").alias("i0")).where("source_id % 5 = 0").withColumn("tail", F.unhex(F.lit("01")))
    blocks = blocks.join(last, ["source_id", "i0"], "left").withColumn("content", F.concat("content", F.coalesce("tail", F.unhex(F.lit("")))))
    path = scratch_dir(spark, "inventory")
    REC.write_records(blocks, path, 3)
    inv = BIN.inventory(spark, path, "part-*", 3).withColumn("id", F.regexp_extract("path", r"source_id=([^/]+)", 1).cast("bigint"))
    return inv.groupBy(F.col("id").alias("source_id")).agg(F.sum("n_records").alias("n_records"), F.count_if(F.col("remainder") > 0).alias("partial_files"))


@register("warehouse_by_id", f"WITH samples AS ({Q.samples_cte(EVENTS)}) SELECT source_id, i, value FROM samples")
def warehouse_by_id(spark, sf_dir):
    """K8 -> S12 by table id: a catalog table overwritten, appended to in halves, and read back under both forms of its id."""
    path = scratch_dir(spark, "catalog")
    db = "shapecode_" + path.rpartition("-")[2]
    spark.sql(f"CREATE DATABASE {db} LOCATION '{path}'")
    s = TB.signal_samples(spark, sf_dir, EVENTS).select("source_id", "i", "value")
    WR.write_table(s, f"spark_catalog:{db}.samples", mode="overwrite")
    WR.write_table(s.where("i % 2 = 0"), f"{db}.samples", mode="overwrite")
    WR.write_table(s.where("i % 2 = 1"), f":{db}.samples", mode="append", default_project="spark_catalog")
    full = TB.warehouse_table(spark, f"spark_catalog:{db}.samples")
    relative = TB.warehouse_table(spark, f":{db}.samples", default_project="spark_catalog")
    return full.where("source_id % 2 = 0").unionByName(relative.where("source_id % 2 <> 0"))


@register("view_totals", f"WITH samples AS ({Q.samples_cte(EVENTS)}) SELECT source_id, CAST(count(*) AS BIGINT) AS n, max(value) AS most FROM samples GROUP BY 1")
def view_totals(spark, sf_dir):
    """Samples registered as a view and queried by SQL."""
    name = "samples_" + scratch_dir(spark, "view").rpartition("-")[2]
    WR.register_view(TB.signal_samples(spark, sf_dir, EVENTS), name)
    return spark.sql(f"SELECT source_id, count(*) AS n, max(value) AS most FROM {name} GROUP BY source_id")


@register("time_of_day_keys", "SELECT event_id, CAST((epoch_us(ts) // 1000000) % 60 AS VARCHAR) || '-' || CAST((epoch_us(ts) // 1000) % 86400000 AS VARCHAR) AS key "
          "FROM events WHERE ts IS NOT NULL")
def time_of_day_keys(spark, sf_dir):
    """Second of the minute and millisecond of the day of every event."""
    e = TB.read_table(spark, sf_dir, "events").where("ts IS NOT NULL")
    return e.select("event_id", WR.time_of_day_key(F.to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))).alias("key"))


@register("stream_recordings", f"WITH samples AS ({Q.samples_cte(LI)}), frames AS ({Q.frames_cte(LI)}) "
          f"SELECT source_id, frame_no, CAST({Q.lsum('list_transform(frame, lambda v: round(v / ' + Q.dlit(LI.scale) + '))')} AS BIGINT) AS total FROM frames")
def stream_recordings(spark, sf_dir):
    """Recordings followed as a stream of frames, in two runs of one query: the second continues where the first ended."""
    samples = TB.signal_samples(spark, sf_dir, LI, extra={"v": "CAST(l_quantity AS INT)"})
    rec = samples.withColumn("_hex", F.concat(F.lpad(F.hex(F.col("v").bitwiseAND(0xFF)), 2, "0"), F.lpad(F.hex(F.shiftright("v", 8)), 2, "0")))
    path, out = scratch_dir(spark, "growing"), scratch_dir(spark, "frames")
    # a recording's blocks lie in one file: files follow their source
    blocks = BIN.pack_records(rec, "_hex")
    for half in (0, 1):
        part = blocks.where(F.col("source_id") % 2 == half)
        REC.write_records(part, path, 2, one_file=True)
        q = (REC.stream_frames(spark, path, "le16", LI.frame_len).select(_source_id(), F.col("i").alias("frame_no"),
                                                                        F.aggregate("frame", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"))
             .writeStream.format("parquet").option("checkpointLocation", f"{out}/_chk").option("path", f"{out}/rows").trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.parquet(f"{out}/rows")
