"""Splittable fixed-length records: ranges, decoding, tails, commits."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapecode.sources import binary as BIN
from shapecode.sources import records as REC


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_ranges_cover_whole_records_once():
    rng = np.random.default_rng(1)
    for record in (2, 3, 8):
        files = [(f"f{k}", int(n)) for k, n in enumerate(rng.integers(0, 500, 40))]
        for split in (1, 10, 64, 1000, 10**6):
            parts = REC.ranges(files, record, split)
            seen = {}
            for p in parts:
                assert sum(n for *_, n in p) <= max(record, split // record * record)
                for path, at, n in p:
                    assert at % record == 0 and n % record == 0 and n > 0
                    seen.setdefault(path, []).append((at, n))
            for path, length in files:
                at = 0
                for a, n in sorted(seen.get(path, [])):
                    assert a == at
                    at += n
                assert at == length // record * record


def test_one_file_is_decoded_by_many_tasks(spark, tmpdir_path):
    data = np.random.default_rng(2).integers(0, 256, 3 * 5000 + 2, dtype=np.uint8).tobytes()
    put(f"{tmpdir_path}/a/rec.dat", data)
    put(f"{tmpdir_path}/a/empty.dat", b"")
    put(f"{tmpdir_path}/a/short.dat", b"ab")
    put(f"{tmpdir_path}/a/_hidden/rec.dat", data)
    df = REC.read_records(spark, f"{tmpdir_path}/a", "212", split_bytes=3000)
    assert df.rdd.getNumPartitions() == 5
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() == 5
    whole = BIN.decode_212(BIN.read_binary(spark, f"{tmpdir_path}/a")).select("i", "s1", "s2")
    assert sorted(map(tuple, df.select("i", "s1", "s2").collect())) == sorted(map(tuple, whole.collect()))
    tails = REC.partial_tails(spark, f"{tmpdir_path}/a", 3).collect()
    assert sorted((os.path.basename(r.path), r.n_records, r.remainder) for r in tails) == [("rec.dat", 5000, 2), ("short.dat", 0, 2)]
    with pytest.raises(Exception, match="partial record"):
        REC.read_records(spark, f"{tmpdir_path}/a", "212", tail="error").count()
    one = REC.read_records(spark, f"{tmpdir_path}/a/rec.dat", "raw", record_bytes=3, split_bytes=100)
    assert b"".join(bytes(r.record) for r in one.orderBy("i").collect()) == data[:-2]
    assert REC.read_records(spark, f"{tmpdir_path}/a/*t.dat", "le16").count() == 1


def test_little_endian_and_apnea_layouts(spark, tmpdir_path):
    put(f"{tmpdir_path}/le/x.dat", np.array([0, -1, 32767, -32768], dtype="<i2").tobytes())
    assert [r.raw for r in REC.read_records(spark, f"{tmpdir_path}/le", "le16").orderBy("i").collect()] == [0, -1, 32767, -32768]
    put(f"{tmpdir_path}/ap/x.dat", bytes([0, 0x20, 0, 0, 0, 0, 0, 0, 0, 0x10, 0, 0, 0, 0, 0, 0, 1]))
    assert [(r.i, r.mark) for r in REC.read_records(spark, f"{tmpdir_path}/ap", "apnea").orderBy("i").collect()] == [(0, 32), (1, 16)]


def test_written_blocks_come_back_and_share_files(spark, tmpdir_path):
    s = spark.range(0, 20000).select((F.col("id") % 3).alias("source_id"), F.floor(F.col("id") / 3).alias("i"),
                                     (F.col("id") % 4096).cast("int").alias("s1"), (F.col("id") % 17).cast("int").alias("s2"))
    path = f"{tmpdir_path}/w"
    REC.write_records(BIN.pack_212(s, block=100), path, 3)
    files = REC.list_files(path)
    assert len(files) < 30 and all("/source_id=" in p for p, _ in files)
    read = lambda: sorted(map(tuple, REC.read_records(spark, path, "212", split_bytes=999).select(
        F.regexp_extract("path", "source_id=([0-9]+)", 1).cast("bigint"), "i", "s1", "s2").collect()))
    want = sorted(map(tuple, s.collect()))
    assert read() == want
    REC.write_records(BIN.pack_212(s, block=5000), path, 3, mode="overwrite")
    assert read() == want
    leftover = [f for _, _, names in os.walk(path) for f in names if f.startswith(".") and f.endswith(".dat")]
    assert leftover == []


def test_failed_write_leaves_nothing_visible(spark, tmpdir_path):
    path = f"{tmpdir_path}/bad"
    blocks = spark.range(50).select(F.lit(1).alias("source_id"), (F.col("id") * 2).alias("i0"),
                                    F.when(F.col("id") < 49, F.unhex(F.lit("0102"))).alias("content")).repartition(4)
    with pytest.raises(Exception):
        REC.write_records(blocks.withColumn("content", F.when(F.col("i0") == 98, F.raise_error(F.lit("broken"))).otherwise(F.col("content"))), path, 1)
    assert not os.path.exists(path) or REC.list_files(path) == []


def follow(spark, folder, out, **options):
    q = (REC.stream_frames(spark, folder, "le16", 4, **options).writeStream.format("parquet").option("checkpointLocation", f"{out}/chk")
         .option("path", f"{out}/rows").trigger(availableNow=True).start())
    q.awaitTermination()
    return sorted((os.path.basename(r.path), r.i, list(r.frame)) for r in spark.read.schema("path string, i bigint, frame array<int>").parquet(f"{out}/rows").collect())


def test_growing_recordings_are_followed_over_restarts(spark, tmpdir_path):
    folder, out = f"{tmpdir_path}/g", f"{tmpdir_path}/o"
    frames = lambda n: np.arange(n, dtype="<i2").tobytes()
    put(f"{folder}/a.dat", frames(10))                                   # two frames and a half
    want = [("a.dat", k, [4 * k + j for j in range(4)]) for k in range(6)]
    assert follow(spark, folder, out) == want[:2]
    assert follow(spark, folder, out) == want[:2]                        # nothing new: no doubles
    put(f"{folder}/a.dat", frames(25))                                   # it grows, and another one begins
    put(f"{folder}/b.dat", frames(4))
    assert follow(spark, folder, out) == want + [("b.dat", 0, [0, 1, 2, 3])]
    assert follow(spark, folder, f"{tmpdir_path}/late", starting="latest") == []
    put(f"{folder}/b.dat", frames(9))
    assert follow(spark, folder, f"{tmpdir_path}/late", starting="latest") == [("b.dat", 1, [4, 5, 6, 7])]


def test_batches_of_a_stream_are_limited(tmpdir_path):
    put(f"{tmpdir_path}/x/a.dat", bytes(2 * 10))
    put(f"{tmpdir_path}/x/b.dat", bytes(2 * 5 + 1))
    r = REC.RecordStreamReader({"path": f"{tmpdir_path}/x", "layout": "le16", "max_records": "6", "split_bytes": "4"})
    at, seen = r.initialOffset(), []
    for _ in range(5):
        end = r.latestOffset()
        parts = [x for p in r.partitions(at, end) for x in p.parts]
        assert sum(n for *_, n in parts) <= 12 and all(n <= 4 for *_, n in parts)
        seen += parts
        at = end
    assert sum(n for *_, n in seen) == 30 and len(set(seen)) == len(seen)
    assert r.latestOffset() == at
