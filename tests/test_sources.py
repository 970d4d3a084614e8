import json
import os

import numpy as np
from pyspark.sql import functions as F

from shapecode.sources import binary as BIN
from shapecode.sources import events as EVT
from shapecode.sources import text as TXT
from shapecode.sinks import writers as WR


def write(path, data: bytes):
    with open(path, "wb") as f:
        f.write(data)


def pack212(s1, s2):
    out = bytearray()
    for a, b in zip(s1, s2):
        out += bytes([a & 0xFF, ((b >> 8) << 4) | (a >> 8), b & 0xFF])
    return bytes(out)


def test_decode_212_with_partial_record(spark, tmpdir_path):
    s1 = [0, 2047, 2048, 4095, 17]
    s2 = [4095, 0, 2048, 1, 300]
    write(os.path.join(tmpdir_path, "105.dat"), pack212(s1, s2) + b"\x01\x02")   # 2 trailing bytes
    rows = BIN.decode_212(BIN.read_binary(spark, tmpdir_path)).orderBy("i").collect()
    assert [r.s1 for r in rows] == s1 and [r.s2 for r in rows] == s2
    assert rows[0].source_id == "105"
    signed = BIN.decode_212(BIN.read_binary(spark, tmpdir_path), signed=True).orderBy("i").collect()
    assert [r.s1 for r in signed] == [0, 2047, -2048, -1, 17]
    inv = BIN.inventory(spark, tmpdir_path).first()
    assert (inv.n_records, inv.remainder) == (5, 2)
    long = BIN.decode_212_long(BIN.read_binary(spark, tmpdir_path))
    assert long.where("channel = 1").count() == 5


def test_decode_le16(spark, tmpdir_path):
    vals = np.array([0, 1, -1, 32767, -32768, 1234], dtype="<i2")
    write(os.path.join(tmpdir_path, "rec.dat"), vals.tobytes() + b"\x07")
    rows = BIN.decode_le16(BIN.read_binary(spark, tmpdir_path)).orderBy("i").collect()
    assert [r.raw for r in rows] == vals.tolist()


def test_decode_apnea(spark, tmpdir_path):
    recs = b"".join(bytes([0, 0x20 if k % 3 == 0 else 0x10, 0, 0, 0, 0, 0, 0]) for k in range(62))
    write(os.path.join(tmpdir_path, "a01.apn"), recs)
    rows = BIN.decode_apnea(BIN.read_binary(spark, tmpdir_path, "*.apn")).orderBy("n").collect()
    assert len(rows) == 62 and rows[0].code == "A" and rows[1].code == "N"
    assert rows[61].line == "0061, 0366000, 01:01, N"


def test_frame_event_decode_edge_cases(spark):
    good = json.dumps({"srcTs": 1.5, "srcId": "inj./data/105.dat", "frameRef": 1800.0, "data": [200, 400], "scale": 9})
    missing = json.dumps({"srcId": "inj./data/7.dat"})
    short = json.dumps({"srcId": "abc", "data": [1]})
    df = spark.createDataFrame([(good,), (missing,), (short,), ("{not json",)], "value string")
    rows = EVT.decode_frame_events(df).collect()
    assert rows[0].patient_id == "105" and rows[0].frame == [1.0, 2.0] and rows[0].frame_ref == 1800
    assert rows[1].srcTs == 0.0 and rows[1].frame == [] and rows[1].status == "ok"
    assert rows[2].status == "bad_source"
    assert rows[3].status == "malformed"


def test_text_scans(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "ann.txt")
    with open(p, "w") as f:
        f.write("    0:00.050       18     +    0    0    0\t(N\n")
        f.write("    0:00.500      180     V    0    0    0\n")
        f.write("[00:11:30.628 09/11/1989]\n")
        f.write("    0:01.000      360     N    0    0    0\n")
    ann = TXT.read_annotations(spark, p).orderBy("line_no").collect()
    assert [(a.t, a.sample, a.code) for a in ann] == [("0:00.050", 18, "+"), ("0:00.500", 180, "V"), ("0:01.000", 360, "N")]
    lines = spark.createDataFrame([("(inj./data/1.dat,0.5,100.0,0.25,2024/01/01/3/,;1.0,2.0;0.5,1.5;0.5,0.5;)",)], "value string")
    a = TXT.parse_archive(lines).first()
    assert a.frame_ref == 100 and a.max_err == 0.25 and a.loss == [0.5, 0.5]
    b = TXT.parse_batch_coded(spark.createDataFrame([("1.0,2.0;0.5,1.5;0.5,0.5",)], "value string")).first()
    assert b.loss == [0.5, 0.5]      # the last digit is kept
    fr = spark.createDataFrame([([1.0, 2.5],)], "frame array<double>")
    out = os.path.join(tmpdir_path, "frames")
    WR.frame_lines(fr).write.text(out)
    assert TXT.read_frames_csv(spark, out).first().frame == [1.0, 2.5]
    tsv = os.path.join(tmpdir_path, "ref.tsv")
    with open(tsv, "w") as f:
        f.write("0\t995\t1011\n1\t995\t1011\n")
    assert TXT.read_reference_samples(spark, tsv).first().diff == -16


def test_codebook_save_load(spark, tmpdir_path):
    cb = spark.createDataFrame([(1, 0, [0.1, 0.2]), (2, 0, [0.3, 0.4])], "source_id bigint, code int, center array<double>")
    WR.save_codebook(cb, tmpdir_path + "/cb", 2, 1)
    WR.save_codebook(cb.where("source_id = 2").withColumn("center", F.array(F.lit(9.0), F.lit(9.0))), tmpdir_path + "/cb", 2, 1)
    WR.save_codebook(cb.where("source_id = 1").withColumn("center", F.array(*[F.lit(7.0)] * 4)), tmpdir_path + "/cb", 4, 1)
    WR.save_codebook(cb.where("source_id = 1").withColumn("center", F.array(F.lit(5.0), F.lit(5.0))), tmpdir_path + "/cb", 2, 2)
    load = lambda w, step: {r.source_id: r.center for r in WR.load_codebook(spark, tmpdir_path + "/cb", w, step).collect()}
    assert load(2, 1) == {1: [0.1, 0.2], 2: [9.0, 9.0]}     # the new version replaced patient 2 only
    assert load(4, 1) == {1: [7.0] * 4} and load(2, 2) == {1: [5.0, 5.0]}


def test_table_ids_and_missing_checkpoint_folder(spark):
    from shapecode.sources.tables import table_name
    assert table_name(":d.t") == "d.t" and table_name("d.t") == "d.t" and table_name("p:d.t") == "p.d.t"
    assert table_name(":d.t", "q") == "q.d.t" and table_name("p:d.t", "q") == "p.d.t"
    df = spark.createDataFrame([(1,)], "a int")
    WR.write_table(df, ":default.anoms_test", mode="overwrite")
    WR.write_table(df, ":default.anoms_test")
    from shapecode.sources.tables import warehouse_table
    assert warehouse_table(spark, ":default.anoms_test").count() == 2
    spark.sql("DROP TABLE default.anoms_test")


def test_time_path_parts(spark):
    df = spark.sql("SELECT TIMESTAMP'2024-03-05 01:00:07.123' AS t")
    r = df.select(WR.date_path(F.col("t")).alias("p"), WR.time_of_day_key(F.col("t")).alias("k")).first()
    assert r.p == "2024/03/05/1/" and r.k == "7-3607123"
    df = spark.sql("SELECT timestamp_millis(1709600407123) AS t")
    try:      # the same instant, whatever the session's zone
        for zone in ("America/New_York", "Asia/Kolkata", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            r = df.select(WR.date_path(F.col("t")).alias("p"), WR.time_of_day_key(F.col("t")).alias("k")).first()
            assert r.p == "2024/03/05/1/" and r.k == "7-3607123"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_text_sinks_round_trip(spark, tmpdir_path):
    coded = spark.createDataFrame([([1.0, 2.5], [0.5, 2.0], [0.5, 0.5])], "src array<double>, coded array<double>, loss array<double>")
    WR.batch_coded_lines(coded).write.text(tmpdir_path + "/coded")
    back = TXT.parse_batch_coded(spark.read.text(tmpdir_path + "/coded")).first()
    assert (back.src, back.coded, back.loss) == ([1.0, 2.5], [0.5, 2.0], [0.5, 0.5])
    labels = spark.createDataFrame([(0, "N"), (1800, "NV")], "frame_ref bigint, label string")
    WR.label_lines(labels).write.text(tmpdir_path + "/labels")
    assert sorted(TXT.read_labels(spark, tmpdir_path + "/labels").drop("_path").collect()) == sorted(labels.collect())


def test_warehouse_read_write(spark, tmpdir_path):
    from shapecode.sources.tables import warehouse_table
    df = spark.createDataFrame([("The", 3), ("cat", 2)], "word string, word_count bigint")
    WR.write_table(df, tmpdir_path + "/wc", mode="overwrite")
    WR.write_table(df, tmpdir_path + "/wc", mode="append")
    assert warehouse_table(spark, "proj:ds.wc", fmt="parquet", path=tmpdir_path + "/wc").count() == 4
    WR.register_view(df, "shapecode_wc")
    assert warehouse_table(spark, ":shapecode_wc").count() == 2
    assert warehouse_table(spark, "shapecode_wc").count() == 2
