import numpy as np
import pytest
from pyspark.sql import functions as F

from shapecode.operators import evaluate as EV
from shapecode.operators import labels as LB
from shapecode.operators import words as WD


def labelled(spark, rows):
    return spark.createDataFrame(rows, "source_id bigint, frame_ref bigint, label string, score double")


def brute(rows, t):
    fn = sum(1 for r in rows if r[2] != "N" and r[3] < t)
    fp = sum(1 for r in rows if r[2] == "N" and r[3] >= t)
    return fn, fp


def test_sweep_equals_brute_force_with_exact_ties(spark):
    rows = [(1, i, "N" if i % 3 else "NV", s) for i, s in enumerate(
        [0.0, 0.0025, 0.005, 3 * 0.0025, 0.0074999, 0.5, 1.2475, 1.25, 2.0, 0.1, 0.1 + 1e-12, 0.0125])]
    curve = {r.t_index: r for r in EV.threshold_sweep(labelled(spark, rows)).collect()}
    assert len(curve) == 500
    for i in range(500):
        fn, fp = brute(rows, i * 0.0025)
        assert (curve[i].fn, curve[i].fp) == (fn, fp), i
    best = EV.best_threshold(EV.threshold_sweep(labelled(spark, rows))).first()
    assert best.total_pct == min(r.total_pct for r in curve.values())


def test_errors_at_threshold_and_empty_set(spark):
    rows = [(1, 0, "N", 0.9), (1, 1, "NV", 0.5), (1, 2, "N", 0.1), (1, 3, "N+", 0.95)]
    r = EV.errors_at(labelled(spark, rows), 0.9).first()
    assert (r.n, r.pos, r.neg) == (4, 2, 2)
    assert r.fp_pct == 25.0 and r.fn_pct == 25.0 and r.total_pct == 50.0   # score == t counts as anomaly
    e = EV.errors_at(labelled(spark, []), 0.9).first()
    assert e.n == 0 and e.total_pct is None


def test_frame_labels(spark):
    ann = spark.createDataFrame(
        [(1, 0, 5, "N"), (1, 1, 20, "V"), (1, 2, 25, "+"), (1, 3, 70, "N"), (1, 4, 90, "A"), (1, 5, 95, "N")],
        "record_id bigint, line_no bigint, sample bigint, code string")
    labs = {r.frame_ref: r.label for r in LB.frame_labels(ann, 30).collect()}
    # ceil(95 / 30) = 4 frames; '+' counts as abnormal; the code at 90 lies in frame 3
    assert labs == {0: "NV+", 30: "N", 60: "N", 90: "NA"}


def test_out_of_range_code(spark):
    ann = spark.createDataFrame([(1, 0, 10, "N"), (1, 1, 60, "V")], "record_id bigint, line_no bigint, sample bigint, code string")
    assert LB.out_of_range_codes(ann, 30).count() == 1          # 60 // 30 = 2 = n_frames
    assert {r.frame_ref for r in LB.frame_labels(ann, 30).collect()} == {0, 30}


def test_split_is_reproducible_and_exact(spark):
    rows = [(s, f * 100, "N", 0.1) for s in (1, 2) for f in range(10)]
    sp = EV.split_validation_test(labelled(spark, rows))
    c = {r.source_id: r["count"] for r in sp.where("split = 'validation'").groupBy("source_id").count().collect()}
    assert c == {1: 4, 2: 4}
    assert sorted(sp.collect()) == sorted(EV.split_validation_test(labelled(spark, rows)).collect())


def test_histogram_constant_loss(spark):
    df = spark.createDataFrame([(1, 0, [0.5, 0.5, 0.5])], "source_id bigint, frame_ref bigint, loss array<double>")
    h = EV.loss_histogram(df).collect()
    assert [r.bin for r in sorted(h)] == list(range(50)) and {r.bin: r.cnt for r in h if r.cnt} == {25: 3}
    assert all(r.height == 0.0 for r in h if not r.cnt)


def test_histogram_counts_every_sample(spark):
    rng = np.random.default_rng(4)
    loss = [float(x) for x in rng.normal(0, 1, 700)]
    df = spark.createDataFrame([(1, 0, loss), (1, 1, [])], "source_id bigint, frame_ref bigint, loss array<double>")
    h = {(r.frame_ref, r.bin): r.cnt for r in EV.loss_histogram(df).collect()}
    lo, wd = min(loss), (max(loss) - min(loss)) / 50
    want = np.bincount([min(int((x - lo) // wd), 49) for x in loss], minlength=50)
    assert sum(h.values()) == 700 and len(h) == 50
    assert sum(abs(h[0, b] - want[b]) for b in range(50)) <= 2      # floor(x / w) against x // w at bin edges


def test_unscored_frames_are_reported_apart(spark):
    """Both error reports count the same frames."""
    rows = [(1, 0, "N", 0.9), (1, 1, "NV", None), (1, 2, "NV", 0.2)]
    r = EV.errors_at(labelled(spark, rows), 0.5).first()
    assert (r.unscored, r.n, r.pos, r.neg, r.fp_pct, r.fn_pct) == (1, 2, 1, 1, 50.0, 50.0)
    curve = EV.threshold_sweep(labelled(spark, rows)).collect()
    assert len(curve) == 500 and {(c.unscored, c.n, c.pos, c.neg) for c in curve} == {(1, 2, 1, 1)}


def test_words(spark):
    docs = spark.createDataFrame([("The cat, the HAT; the end",), ("cat 42 cat",)], "text string")
    t = {r.word: r.word_count for r in WD.word_totals(WD.word_rows(docs)).collect()}
    assert t == {"the": 3, "cat": 3, "hat": 1, "end": 1}
    assert [r.word for r in WD.top_words(WD.word_totals(WD.word_rows(docs)), 2).collect()] == ["cat", "the"]


def test_distributed_range_chunk_boundaries(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 4), (4, 5), (5, 9)], "record_id bigint, n_frames bigint")
    out = LB.distributed_range(df, "n_frames", "f", chunk=4).collect()
    got = sorted((r.record_id, r.f) for r in out)
    assert got == sorted((r, f) for r, n in [(1, 0), (2, 1), (3, 4), (4, 5), (5, 9)] for f in range(n))


def test_radix_selection_equals_ranking(spark):
    import random
    from shapecode.operators import evaluate as EV
    rng = random.Random(2)
    rows = [(s, 20 * f, rng.choice(["N", "NA"]), rng.random()) for s, n in ((1, 1000), (2, 1), (3, 2), (4, 37), (5, 3)) for f in range(n)]
    df = spark.createDataFrame(rows, "source_id bigint, frame_ref bigint, label string, score double")
    want = {}
    for s in {r[0] for r in rows}:
        import hashlib
        order = sorted((hashlib.md5(f"{EV.SPLIT_SEED}:{s}:{r[1]}".encode()).hexdigest(), r[1]) for r in rows if r[0] == s)
        want |= {(s, f): "validation" if k < int(0.4 * len(order)) else "test" for k, (_, f) in enumerate(order)}
    assert {(r.source_id, r.frame_ref): r.split for r in EV.split_validation_test(df).collect()} == want
    for digits in (1, 2):                                  # short buckets: the boundary bucket holds several keys
        keyed = df.withColumn("_h", EV.split_key(EV.SPLIT_SEED))
        cut = {r.source_id: r.cutoff for r in EV.hash_cutoffs(keyed, 0.4, digits=digits).collect()}
        got = {(r.source_id, r.frame_ref): "validation" if r.source_id in cut and r._h <= cut[r.source_id] else "test" for r in keyed.collect()}
        assert got == want
    assert EV.split_validation_test(df.limit(0)).collect() == []


def test_split_ranks_and_checkpoints_nothing(spark):
    from shapecode.operators import evaluate as EV
    df = spark.range(1000).select((F.col("id") % 3).alias("source_id"), "id", F.col("id").alias("frame_ref"), F.lit("N").alias("label"), F.lit(0.1).alias("score"))
    out = EV.split_validation_test(df)
    plan = out._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "ExistingRDD" not in plan.replace("Range", "")


def test_bucketed_tables_meet_without_a_shuffle(spark):
    from shapecode.operators import evaluate as EV
    from shapecode.plans import file_queries as FQ
    frames, labels = FQ.bucketed_archive(spark, "/root/testdata/sf0.001")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = EV.labelled_frames(frames, labels)
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
