"""Files, tasks, rows held and broadcasts grow with the data only as far as they must."""

import os

from pyspark.sql import functions as F

from shapecode.plans import file_queries as FQ
from shapecode.sources import records as REC
from shapecode.sources import text as TXT


def data_files(root):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(root) for f in names
                  if not f.startswith((".", "_")) and f.endswith((".dat", ".txt", ".csv", ".parquet")))


def test_labels_are_one_file_a_record(spark, tmpdir_path):
    n = FQ.LI.frame_len
    labels = spark.range(0, 400).selectExpr("id % 10 as record_id", f"id div 10 * {n} as frame_ref", "IF(id % 7 = 0, 'NA', 'N') as label").repartition(8)
    FQ._write_labels(labels, f"{tmpdir_path}/labels")
    # keys are ranged over tasks: a record's lines lie in one file, or in two where a range ends inside it
    assert 10 <= len(data_files(f"{tmpdir_path}/labels")) <= 18
    back = FQ._read_labels(spark, f"{tmpdir_path}/labels")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, labels.collect()))


def test_lines_of_a_file_are_in_order(spark, tmpdir_path):
    lines = (spark.range(0, 300).where("id % 5 <> 0").selectExpr("id % 2 as source_id", "id as i", "IF(id = 7, NULL, CAST(id AS STRING)) as line")
             .repartition(8))
    REC.write_lines(lines, f"{tmpdir_path}/x", block=16, one_file=True)      # blocks with gaps still continue one file
    assert len(data_files(f"{tmpdir_path}/x")) == 2
    odd = next(f for f in data_files(f"{tmpdir_path}/x") if "source_id=1/" in f)
    assert open(odd).read().split("\n") == ["" if k == 7 else str(k) for k in range(1, 300, 2) if k % 5] + [""]


def test_annotations_with_gaps_keep_their_order(spark, tmpdir_path):
    rows = [(5, i, f"    0:01.000  {i}     {'NAV'[i % 3]}") for i in range(0, 9000, 3000)] + [(6, 1, "    0:01.000  1     N")]
    REC.write_lines(spark.createDataFrame(rows, "source_id bigint, i bigint, line string"), f"{tmpdir_path}/a", one_file=True)
    read = TXT.read_annotations(spark, f"{tmpdir_path}/a", r"source_id=([^/]+)").where("record_id = '5'").orderBy("line_no")
    assert [r.sample for r in read.collect()] == [0, 3000, 6000]


def test_a_stream_batch_reads_many_files_in_a_task(tmpdir_path):
    for k in range(600):
        os.makedirs(f"{tmpdir_path}/source_id={k}")
        with open(f"{tmpdir_path}/source_id={k}/part-0-x.dat", "wb") as f:
            f.write(bytes(2 * (k % 3 + 1)))
    r = REC.RecordStreamReader({"path": tmpdir_path, "layout": "le16"})
    parts = r.partitions(r.initialOffset(), r.latestOffset())
    assert [len(p.parts) for p in parts] == [REC.RANGE_FILES, 600 - REC.RANGE_FILES]
    assert sum(b.num_rows for p in parts for b in r.read(p)) == sum(k % 3 + 1 for k in range(600))


def test_reference_samples_are_one_file_a_recording(spark, monkeypatch, tmpdir_path):
    rows = spark.range(0, 400).selectExpr("id % 10 as source_id", "id div 10 as i", "CAST(id AS INT) as s1", "IF(id % 9 = 0, NULL, 5) as s2").repartition(8)
    monkeypatch.setattr(FQ.P, "_expected_212", lambda *_: rows)
    monkeypatch.setattr(FQ, "scratch_dir", lambda _spark, name: f"{tmpdir_path}/{name}")
    got = FQ.reference_samples_diff(spark, "").collect()
    assert sorted(map(str, got)) == sorted(map(str, rows.withColumn("diff", F.col("s1") - F.col("s2")).collect()))
    assert 10 <= len(data_files(f"{tmpdir_path}/tsv")) <= 18


def test_a_channel_is_exported_in_files_of_tasks_not_of_sources(spark, tmpdir_path):
    from shapecode.sinks import writers as WR
    rows = spark.range(0, 300).selectExpr("id % 50 as source_id", "CAST(id % 2 + 1 AS INT) as channel", "id div 50 as i", "CAST(id AS INT) as raw").repartition(3)
    WR.export_channel(rows, f"{tmpdir_path}/c", channel=1)
    assert len(data_files(f"{tmpdir_path}/c")) <= 3
    back = spark.read.schema("i bigint, raw int, source_id bigint").parquet(f"{tmpdir_path}/c").select("source_id", "i", "raw")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.where("channel = 1").select("source_id", "i", "raw").collect()))


def test_archive_files_follow_hours_not_tasks(spark, tmpdir_path):
    from shapecode.streaming.detector import _write_archive
    rows = (spark.range(0, 400).selectExpr("'ok' as status", "timestamp_seconds((id % 5) * 3600) as event_time", "CAST(id % 7 AS STRING) as patient_id",
                                           "id as frame_ref", "0 as batch_id").repartition(8))
    _write_archive(rows, f"{tmpdir_path}/arch")
    assert len(data_files(f"{tmpdir_path}/arch")) == 5
    assert spark.read.parquet(f"{tmpdir_path}/arch").count() == 400


def test_coders_hold_few_block_rows_at_once(spark):
    from shapecode.operators import vectorized as V
    rows = spark.range(0, 500, 1, 2).selectExpr("id", "CAST(IF(id % 3 = 0, NULL, id) AS DOUBLE) as x", "array(named_struct('code', 1, 'center', array(1D, 2D))) as book")

    def run(batches):
        for pdf in batches:
            pdf["seen"] = len(pdf)
            pdf["book"] = [[{"code": e["code"], "center": e["center"]} for e in b] for b in pdf["book"]]
            yield pdf

    out = V.map_in_slices(rows, run, "id bigint, x double, book array<struct<code:int,center:array<double>>>, seen bigint")
    assert out.agg(F.max("seen")).first()[0] == V.SLICE_ROWS
    assert sorted(map(str, out.drop("seen").collect())) == sorted(map(str, rows.collect()))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scored_frames_and_labels_are_not_broadcast(spark):
    from shapecode.operators import evaluate as EV
    scores = spark.sql("SELECT * FROM VALUES (1L, 0L, 0.5D), (1L, 8L, 0.1D), (2L, 0L, NULL) t(source_id, frame_ref, score)")
    labels = spark.sql("SELECT * FROM VALUES (1L, 0L, 'N'), (2L, 0L, 'NA'), (3L, 0L, 'N') t(record_id, frame_ref, label)")
    joined = EV.labelled_frames(scores, labels)
    assert "Broadcast" not in plan_of(joined)
    assert sorted(map(str, joined.select("source_id", "frame_ref", "label").collect())) == sorted(
        ["Row(source_id=1, frame_ref=0, label='N')", "Row(source_id=2, frame_ref=0, label='NA')"])


def test_large_dictionaries_are_not_broadcast(spark, monkeypatch, tmpdir_path):
    from shapecode.operators import chunked as CH
    from shapecode.sinks import writers as WR
    book = spark.createDataFrame([(1, 0, [0.5, 0.25]), (1, 1, [0.25, 0.5]), (2, 0, [1.0, 0.0])], "source_id bigint, code int, center array<double>")
    WR.save_codebook(book, f"{tmpdir_path}/books", 2, 1)
    stored = WR.load_codebook(spark, f"{tmpdir_path}/books", 2, 1)
    assert "Broadcast" not in plan_of(stored) and stored.count() == 3
    samples = spark.range(0, 16).selectExpr("id % 3 as source_id", "id div 3 as i", "CAST(id * id % 7 AS DOUBLE) as value")
    small = CH.score_samples(samples, stored, 2, 2)
    monkeypatch.setattr(CH, "BROADCAST_BYTES", 16)
    large = CH.score_samples(samples, stored, 2, 2)
    assert "Broadcast" not in plan_of(large)
    assert sorted(map(str, large.collect())) == sorted(map(str, small.collect()))


def test_assignment_in_blocks_equals_the_expression(spark):
    from shapecode.operators import kmeans as KM
    rows = [(s, j, [float((s * 31 + j * 7 + p * p) % 11) / 8 for p in range(4)]) for s in (1, 2, 3, 4) for j in range(300)]
    rows[5] = (1, 5, None)
    rows[310] = (2, 10, [0.5, float("nan"), 0.5, 0.5])
    rows[610] = (3, 10, [0.5, None, 0.5, 0.5])
    train = spark.createDataFrame(rows, "source_id bigint, j bigint, feat array<double>")
    book = spark.createDataFrame([(s, c, [float((c * 5 + p) % 7) / 4 for p in range(4)]) for s in (1, 2, 3) for c in range(9)],
                                 "source_id bigint, code int, center array<double>")
    got, want = KM.assign(train, book), KM._assign_sql(train, book)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.count() == 900
