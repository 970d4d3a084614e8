import os

import pytest
from pyspark.sql import functions as F

from shapecode.operators import coding, framing
from shapecode.plans.detect import detect
from shapecode.sources import events as EVT
from shapecode.streaming.committed import CommittedTable
from shapecode.streaming.detector import file_frames, start_detector


def test_stream_equals_batch(spark, tmpdir_path):
    import numpy as np
    rng = np.random.default_rng(11)
    w, n = 8, 4
    rows = [(s, i, float(v)) for s in (1, 2, 3) for i, v in enumerate(rng.integers(0, 400, 100))]
    samples = spark.createDataFrame(rows, "source_id bigint, i bigint, raw double")
    frames = framing.tumbling_frames(samples, w * n, value_col="raw").withColumn("src_ts", F.col("frame_ref") / 360.0)
    ev = EVT.frame_events(frames.where("source_id <> 3 OR frame_no > 0"))
    nan_frame = '{"srcId": "i./d/1.dat", "frameRef": 3200.0, "data": [' + ", ".join(["1.0"] * 31 + ["NaN"]) + ']}'
    bad = spark.createDataFrame([("{broken",), ('{"srcId": "x", "data": [1]}',), ('{"srcId": "i./d/9.dat", "data": [1, 2]}',),
                                 (nan_frame,)], "value string")
    ev.unionByName(bad).write.mode("overwrite").text(tmpdir_path + "/in")
    scaled = frames.withColumn("frame", F.transform("frame", lambda x: x * (1 / 200.0)))
    cb = coding.first_frame_codebook(scaled.where("source_id <> 3"), w, n).withColumn("source_id", F.col("source_id").cast("string"))
    books = coding.pack_codebook(cb)
    counts = []
    q = start_detector(file_frames(spark, tmpdir_path + "/in"), books, tmpdir_path + "/arch", tmpdir_path + "/anom",
                       tmpdir_path + "/quar", tmpdir_path + "/chk", available_now=True, w=w, n=n, threshold=0.3,
                       on_counts=lambda batch, c: counts.append(c))
    q.awaitTermination()
    arch = spark.read.parquet(tmpdir_path + "/arch").select("patient_id", "frame_ref", "score", "status")
    batch = detect(spark.read.text(tmpdir_path + "/in"), books, w, n).where("status = 'ok'") \
        .select("patient_id", "frame_ref", "score", "status")
    assert sorted(arch.collect()) == sorted(batch.collect())
    assert arch.count() == 6
    quar = {r.status for r in spark.read.parquet(tmpdir_path + "/quar").collect()}
    assert quar == {"malformed", "bad_source", "bad_length", "bad_sample", "no_model"}
    anom = spark.read.json(tmpdir_path + "/anom")
    assert anom.count() == arch.where("score > 0.3").count()
    total = {k: sum(c[k] for c in counts) for k in counts[0]}       # T8
    assert total == {"frames": spark.read.text(tmpdir_path + "/in").count(), "scored": 6, "anomalies": anom.count(),
                     "quarantined": spark.read.parquet(tmpdir_path + "/quar").count()}


def test_replay_of_a_batch_with_another_clock_writes_the_same_partitions(spark, tmpdir_path):
    from shapecode.streaming.detector import batch_writer
    rows = [("i./d/1.dat", 1, 0, 1709600407.0 + 3600 * h, h) for h in range(3)]
    b = spark.createDataFrame(rows, "srcId string, patient_id string, frame_ref bigint, srcTs double, h int").select(
        "srcId", "srcTs", "patient_id", "frame_ref", F.lit(0.0).alias("frameRef"), F.timestamp_seconds("srcTs").alias("event_time"),
        F.array(F.lit(1.0)).alias("src"), F.array(F.lit(1.0)).alias("coded"), F.array(F.lit(0.0)).alias("loss"),
        F.lit(0.0).alias("score"), F.lit("0").alias("codes"), F.lit("ok").alias("status"))
    write = batch_writer(tmpdir_path + "/arch", None, None)
    import time
    write(b, 7)
    time.sleep(1.1)
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")        # a replay on another day and clock
        write(b, 7)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    arch = spark.read.parquet(tmpdir_path + "/arch")
    assert arch.count() == 3 and arch.select("date", "hour").distinct().count() == 3


def test_frames_of_any_whole_number_of_windows_and_repeated_refs(spark):
    import numpy as np
    from shapecode.operators import vectorized as V
    rng = np.random.default_rng(5)
    w, n = 8, 4
    data = {k: [float(x) for x in rng.integers(0, 400, k)] for k in (32, 64, 24, 8, 30, 4)}
    ev = spark.createDataFrame([(f'{{"srcId": "i./d/1.dat", "frameRef": 0.0, "data": {d}}}',) for d in data.values()], "value string")
    f0 = spark.createDataFrame([(1, 0, 0, [x / 200 for x in data[32]])], "source_id bigint, frame_no bigint, frame_ref bigint, frame array<double>")
    books = coding.pack_codebook(coding.first_frame_codebook(f0, w, n).withColumn("source_id", F.lit("1")))
    for method in ("vectorized", "sql"):
        got = {len(r.frame): (r.status, None if r.coded is None else len(r.coded)) for r in detect(ev, books, w, n, method=method).collect()}
        assert got == {32: ("ok", 24), 64: ("ok", 56), 24: ("ok", 16), 8: ("single_window", 0), 30: ("bad_length", None), 4: ("bad_length", None)}
    same = spark.range(5000).select(F.lit("1").alias("source_id"), F.lit(0).cast("bigint").alias("frame_ref"),
                                    F.array(F.lit(1.0)).alias("frame"), F.lit("ok").alias("status"), "id")
    assert V.frame_blocks(same, ["id"], 64).agg(F.max(F.size("items"))).first()[0] <= 64


def test_detect_methods_agree(spark):
    import numpy as np
    rng = np.random.default_rng(2)
    w, n = 8, 4
    rows = [(s, i, float(v)) for s in (1, 2) for i, v in enumerate(rng.integers(0, 400, 96))]
    samples = spark.createDataFrame(rows, "source_id bigint, i bigint, raw double")
    frames = framing.tumbling_frames(samples, w * n, value_col="raw").withColumn("src_ts", F.col("frame_ref") / 360.0)
    ev = EVT.frame_events(frames)
    scaled = frames.withColumn("frame", F.transform("frame", lambda x: x * (1 / 200.0)))
    cb = coding.first_frame_codebook(scaled.where("source_id = 1"), w, n).withColumn("source_id", F.col("source_id").cast("string"))
    books = coding.pack_codebook(cb)
    cols = ["srcId", "frame_ref", "score", "codes", "status", "event_time"]
    a = detect(ev, books, w, n, method="sql").select(*cols).collect()
    b = detect(ev, books, w, n, method="vectorized").select(*cols).collect()
    assert sorted(a) == sorted(b) and len(a) == 6


def test_codebook_ml_single_source(spark):
    """A13(a): pyspark.ml KMeans on one source's training windows."""
    from shapecode.operators import kmeans as KM
    import numpy as np
    rng = np.random.default_rng(8)
    rows = [(1, i, float(v)) for i, v in enumerate(np.sin(np.arange(2000) / 7.0) + rng.normal(0, 0.05, 2000))]
    s = spark.createDataFrame(rows, "source_id bigint, i bigint, value double")
    train, budget = KM.training_set(s, 20, 2)
    k = budget.first().k
    cb = KM.fit_ml_codebook(train, k, max_iter=5)
    assert cb.count() == k == 20 and len(cb.first().center) == 20


def test_split_detector_alerts_and_archive(spark, tmpdir_path):
    """Alerts and archive as two queries over the same source."""
    import numpy as np
    from shapecode.streaming.detector import anomaly_table, archive_table, start_split_detector
    rng = np.random.default_rng(3)
    w, n = 8, 4
    rows = [(s, i, float(v)) for s in (1, 2) for i, v in enumerate(rng.integers(0, 400, 64))]
    samples = spark.createDataFrame(rows, "source_id bigint, i bigint, raw double")
    frames = framing.tumbling_frames(samples, w * n, value_col="raw").withColumn("src_ts", F.col("frame_ref") / 360.0)
    EVT.frame_events(frames).write.mode("overwrite").text(tmpdir_path + "/in")
    scaled = frames.withColumn("frame", F.transform("frame", lambda x: x * (1 / 200.0)))
    books = coding.pack_codebook(coding.first_frame_codebook(scaled, w, n).withColumn("source_id", F.col("source_id").cast("string")))
    counts = []
    for _ in range(2):                       # the second run restarts from the checkpoints
        start_split_detector(file_frames(spark, tmpdir_path + "/in"), lambda: books, tmpdir_path, tmpdir_path + "/chk",
                             alert_trigger=None, archive_trigger=None, w=w, n=n, threshold=0.0, on_counts=lambda i, c: counts.append(c["frames"]))
    archive = archive_table(spark, tmpdir_path)
    assert archive.read().count() == 4 == sum(counts)                # every event scored once
    assert anomaly_table(spark, tmpdir_path).read().count() == 4     # threshold 0: every scored frame
    assert {(r.date.isoformat(), r.hour) for r in archive.read().collect()} == {("1970-01-01", 0)}


def test_replayed_and_failed_batches_leave_each_record_once(spark, tmpdir_path):
    t = CommittedTable(spark, tmpdir_path + "/t", "id bigint, part int", ("part",))
    rows = lambda a, b: spark.range(a, b).select("id", (F.col("id") % 2).cast("int").alias("part"))
    assert t.read().count() == 0 and t.entries() == []
    assert t.append(rows(0, 10), 0)
    with pytest.raises(Exception):
        t.append(rows(10, 20).withColumn("id", F.when(F.col("id") == 17, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("id"))), 1)
    t._write(rows(10, 20))                                            # an attempt that died before its commit
    assert t.read().count() == 10
    assert t.append(rows(10, 20), 1) and not t.append(rows(10, 20), 1) and not t.append(rows(0, 10), 0)
    assert sorted(r.id for r in t.read().collect()) == list(range(20))
    assert t.append(rows(0, 0), 2) and not t.append(rows(0, 5), 2)    # an empty batch is part of the table too
    assert t.vacuum() >= 1
    assert sorted(map(tuple, t.read().select("id", "part").collect())) == [(i, i % 2) for i in range(20)]


def test_compaction_bounds_files_and_readers_see_old_or_new(spark, tmpdir_path):
    t = CommittedTable(spark, tmpdir_path + "/t", "id bigint, part int", ("part",))
    for k in range(6):
        t.append(spark.range(10 * k, 10 * k + 10).select("id", (F.col("id") % 2).cast("int").alias("part")).repartition(4), k)
    before = t.read()                                                 # planned before the merge, run after it
    files = sum(e["files"] for e in t.entries())
    assert t.compact() and len(t.entries()) == 1 and t.entries()[0]["files"] <= 2 < files
    assert sorted(r.id for r in before.collect()) == sorted(r.id for r in t.read().collect()) == list(range(60))
    assert not t.append(spark.range(3).select("id", F.lit(0).alias("part")), 5)     # merged batches stay committed
    assert t.append(spark.range(60, 61).select("id", F.lit(0).alias("part")), 6)
    assert t.vacuum() == 6 and t.read().count() == 61
    assert len(os.listdir(tmpdir_path + "/t/ledger")) <= 4            # two entries (and their checksums)
    assert t.compact() and t.read().count() == 61 and not t.compact()


def test_multi_batch_and_restart_are_exactly_once(spark, tmpdir_path):
    import numpy as np
    rng = np.random.default_rng(9)
    w, n = 8, 4
    rows = [(s, i, float(v)) for s in (1, 2) for i, v in enumerate(rng.integers(0, 400, 96))]
    samples = spark.createDataFrame(rows, "source_id bigint, i bigint, raw double")
    frames = framing.tumbling_frames(samples, w * n, value_col="raw").withColumn("src_ts", F.col("frame_ref") / 360.0)
    ev = EVT.frame_events(frames).coalesce(1)
    for part in range(3):   # three files -> three micro-batches
        ev.where(F.get_json_object("value", "$.frameRef").cast("double") == part * 32.0) \
          .write.mode("overwrite").text(f"{tmpdir_path}/stage{part}")
        import glob
        import shutil
        os.makedirs(f"{tmpdir_path}/in", exist_ok=True)
        for f in glob.glob(f"{tmpdir_path}/stage{part}/part-*"):
            shutil.copy(f, f"{tmpdir_path}/in/batch{part}.txt")
    scaled = frames.withColumn("frame", F.transform("frame", lambda x: x * (1 / 200.0)))
    books = coding.pack_codebook(coding.first_frame_codebook(scaled, w, n).withColumn("source_id", F.col("source_id").cast("string")))
    paths = [f"{tmpdir_path}/{p}" for p in ("arch", "anom", "quar", "chk")]
    for _ in range(2):      # second run restarts from the checkpoint: nothing new to do
        q = start_detector(file_frames(spark, f"{tmpdir_path}/in", max_files_per_trigger=1), books, *paths,
                           available_now=True, w=w, n=n)
        q.awaitTermination()
    arch = spark.read.parquet(paths[0])
    assert arch.count() == 6
    assert arch.select("batch_id").distinct().count() == 3
    assert arch.select("patient_id", "frame_ref").distinct().count() == 6
