import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapecode.functions.arrays import taper_values
from shapecode.operators import coding, framing
from shapecode.operators.indexing import index_within
from tests.numpy_ref import encode_frame


def frames_df(spark, rows):
    return spark.createDataFrame(
        [(s, f, f * len(x), [float(v) for v in x]) for s, f, x in rows],
        "source_id bigint, frame_no bigint, frame_ref bigint, frame array<double>")


def test_taper_overlap_bounds():
    """For W=120 the half-shifted taper sums to 0.9868..0.9999, not 1."""
    t = taper_values(120)
    s = [t[i] + t[i + 60] for i in range(60)]
    assert 0.9868 < min(s) < 0.9869 and 0.9998 < max(s) < 1.0


@pytest.mark.parametrize("mode", ["centered", "tapered"])
def test_encode_matches_numpy(spark, mode):
    rng = np.random.default_rng(7)
    w, n = 8, 4
    rows = [(1, f, rng.normal(size=w * n)) for f in range(3)] + [(2, 0, np.sin(np.arange(w * n) / 3.0))]
    fr = frames_df(spark, rows)
    book_long = coding.first_frame_codebook(fr, w, n, mode)
    out = coding.score_frames(fr, coding.pack_codebook(book_long), w, n, mode).collect()
    books = {}
    for r in book_long.collect():
        books.setdefault(r.source_id, {})[r.code] = r.center
    for r in out:
        b = books[r.source_id]
        centers = np.array([b[c] for c in sorted(b)])
        codes, coded, loss, score = encode_frame(r.frame, centers, w, mode)
        assert [x.code if x is not None else None for x in r.best] == codes
        assert np.allclose(r.coded, coded, atol=1e-12)
        assert len(r.src) == len(r.coded) == (n - 1) * w
        assert math.isclose(r.score, score, abs_tol=1e-12)


def test_own_dictionary_small_nonzero_loss(spark):
    """A frame coded with its own windows is still lossy (taper overlap, one norm per segment)."""
    x = np.sin(np.arange(360) / 15.0) + 2.0
    fr = frames_df(spark, [(1, 0, x)])
    r = coding.score_frames(fr, coding.pack_codebook(coding.first_frame_codebook(fr, 120, 3)), 120, 3).first()
    assert [b.code for b in r.best] == list(range(5))
    centers = np.array([b.center for b in r.best])
    ref = encode_frame(x, centers, 120)[3]
    assert 0 < r.score < 1.0 and math.isclose(r.score, ref, abs_tol=1e-12)


def test_ties_go_to_lowest_code_and_zero_window(spark):
    w, n = 4, 2
    fr = frames_df(spark, [(1, 0, [0, 0, 0, 0, 1, 2, 3, 4]), (2, 0, [1, 2, 3, 4, 1, 2, 3, 4])])
    feat = coding.with_features(fr, w, n).where("source_id = 2").select("feats").first()[0][0]
    book = spark.createDataFrame([(1, 0, feat), (1, 1, feat), (2, 0, feat), (2, 1, feat)],
                                 "source_id bigint, code int, center array<double>")
    out = {r.source_id: r for r in coding.score_frames(fr, coding.pack_codebook(book), w, n).collect()}
    assert out[1].best[0] is None                     # all-zero window: no code
    assert out[1].best[2].code == 0
    assert [b.code for b in out[2].best] == [0, 0, 0]  # exact tie -> lowest code


def test_no_model_kept(spark):
    fr = frames_df(spark, [(5, 0, list(range(1, 33)))])
    empty = spark.createDataFrame([], "source_id bigint, book array<struct<code:int,center:array<double>>>")
    r = coding.score_frames(fr, empty, 8, 4).first()
    assert r.status == "no_model" and r.score is None


def test_index_range_equals_window(spark):
    rng = np.random.default_rng(3)
    rows = [(int(s), float(t), float(v)) for s, t, v in zip(rng.integers(0, 4, 500), rng.permutation(500), rng.normal(size=500))]
    rows += [(9, float(t), 1.0) for t in range(700)]   # a hot source spanning partitions
    df = spark.createDataFrame(rows, "source_id bigint, t double, v double")
    a = index_within(df, "source_id", ["t"], method="range", num_partitions=7).select("source_id", "t", "i")
    b = index_within(df, "source_id", ["t"], method="window").select("source_id", "t", "i")
    assert sorted(a.collect()) == sorted(b.collect())


def test_windows_and_frames(spark):
    s = spark.createDataFrame([(1, i, float(i)) for i in range(107)], "source_id bigint, i bigint, value double")
    fr = framing.tumbling_frames(s, 20).orderBy("frame_no").collect()
    assert len(fr) == 5 and fr[1].frame_ref == 20 and fr[1].frame[0] == 20.0   # tail of 7 dropped
    sw = framing.sliding_windows(s, 10, 3).orderBy("j").collect()
    assert len(sw) == (107 - 10) // 3 + 1
    assert all(r.w == [float(r.start + k) for k in range(10)] for r in sw)
    hw = framing.half_overlap_windows(spark.createDataFrame([(1, 0, 0, [float(i) for i in range(12)])],
                                      "source_id bigint, frame_no bigint, frame_ref bigint, frame array<double>"), 4, 3).collect()
    assert [r.w[0] for r in hw] == [0.0, 2.0, 4.0, 6.0, 8.0]
    b = framing.training_budget(s, 10, 1).first()
    assert (b.max_w, b.tr, b.k, b.samples_used) == (107, 21, 2, 30)


@pytest.mark.parametrize("mode", ["centered", "tapered"])
def test_vectorized_equals_sql_coder(spark, mode):
    """Large dictionary with exact duplicate codes (ties) and all-zero windows."""
    from shapecode.operators import vectorized as V
    rng = np.random.default_rng(5)
    w, n = 10, 3
    L = w * n
    rows = []
    for s_ in range(3):
        vals = rng.normal(size=L * 7)
        vals[L:L + w] = 0.0                      # zero windows in frame 1
        rows += [(s_, i, float(v)) for i, v in enumerate(vals)]
    samples = spark.createDataFrame(rows, "source_id bigint, i bigint, value double")
    frames = framing.tumbling_frames(samples, L)
    feats = coding.window_rows(coding.with_features(frames, w, n, mode)).where("feat IS NOT NULL")
    book = feats.select("source_id", (F.col("frame_no") * 10 + F.col("k")).cast("int").alias("code"), F.col("feat").alias("center"))
    dup = book.withColumn("code", F.col("code") + 1000)     # every centre twice -> ties to the lower code
    packed = coding.pack_codebook(book.unionByName(dup).where("source_id <> 2"))
    a = coding.score_frames(frames, packed, w, n, mode)
    b = V.score_samples(samples, packed, w, n, mode, block=3)

    def key(r):
        return (r.source_id, r.frame_no, r.status, r.score, tuple(r.coded or []),
                tuple((x.code, x.d) if x else None for x in r.best))
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))
    assert b.where("status = 'no_model'").count() == 7


def test_sliding_window_methods_agree(spark):
    import random
    r = random.Random(4)
    rows = [(s, i, r.random()) for s in (1, 2) for i in range(s * 523)]
    s = spark.createDataFrame(rows, "source_id bigint, i bigint, value double")
    for w, step, bw in [(20, 2, 7), (8, 1, 5), (12, 12, 3), (10, 3, 4)]:
        budget = framing.training_budget(s, w, step)
        for bud in (None, budget):
            a = framing.sliding_windows(s, w, step, bud, method="explode").collect()
            b = framing.sliding_windows(s, w, step, bud, method="blocks", block_windows=bw).collect()
            assert sorted(a) == sorted(b) and len(a) > 0, (w, step, bw, bud is None)


def test_lloyd_equals_numpy_whatever_the_sizes(spark):
    """One path for every size; centres equal a plain loop exactly and do not depend on partitioning."""
    from shapecode.operators import kmeans as KM
    rng = np.random.default_rng(12)
    rows = [(s, i, float(v)) for s in (1, 2, 3) for i, v in enumerate(np.sin(np.arange(900) / (5.0 + s)) + rng.normal(0, 0.2, 900))]
    s = spark.createDataFrame(rows, "source_id bigint, i bigint, value double")
    train, budget = KM.training_set(s, 12, 2)
    got = {(r.source_id, r.code): r.center for r in KM.lloyd(train, budget, 12).collect()}
    again = {(r.source_id, r.code): r.center for r in KM.lloyd(train.repartition(7), budget, 12).collect()}
    assert got == again and len(got) == 3 * 9      # k = int(0.1 * int(0.2 * 900 div 2))
    feats = {}
    for r in train.collect():
        feats.setdefault(r.source_id, {})[r.j] = np.array(r.feat)
    for s_, by in feats.items():
        x = np.stack([by[j] for j in sorted(by)])
        c = np.stack([x[i * len(x) // 9] for i in range(9)])
        for _ in range(20):
            code = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.stack([np.rint(x[code == i] * KM.GRID).sum(axis=0) / (code == i).sum() / KM.GRID if (code == i).any() else c[i]
                          for i in range(9)])
        assert all(np.allclose(got[s_, i], c[i], atol=1e-12) for i in range(9))


def test_zero_seed_window_keeps_k_codes(spark):
    from shapecode.operators import kmeans as KM
    rows = [(1, i, 0.0 if i < 60 else float(np.sin(i / 3.0))) for i in range(900)]
    s = spark.createDataFrame(rows, "source_id bigint, i bigint, value double")
    train, budget = KM.training_set(s, 12, 2)
    assert train.where("feat is null").count() > 0
    cb = KM.lloyd(train, budget, 12, max_iter=2)
    assert sorted(r.code for r in cb.collect()) == list(range(9))


def test_frame_cap_is_per_source(spark):
    """A cap limits frames of every source separately (no carry-over)."""
    rows = [(s, i, float(i)) for s, n in ((1, 95), (2, 41)) for i in range(n)]
    s = spark.createDataFrame(rows, "source_id bigint, i bigint, value double")
    got = {(r.source_id, r.frame_no) for r in framing.tumbling_frames(s, 20, cap=3).collect()}
    assert got == {(1, 0), (1, 1), (1, 2), (2, 0), (2, 1)}
    b = {r.source_id: (r.n_frames, r.remainder) for r in framing.frame_budget(s, 20, cap=3).collect()}
    assert b == {1: (3, 15), 2: (2, 1)}


def test_single_window_frames_have_no_score(spark):
    from shapecode.operators import vectorized as V
    s = spark.createDataFrame([(1, i, float(i % 5)) for i in range(24)], "source_id bigint, i bigint, value double")
    frames = framing.tumbling_frames(s, 8)
    book = coding.pack_codebook(coding.first_frame_codebook(frames, 8, 1))
    for df in (coding.score_frames(frames, book, 8, 1), V.score_samples(s, book, 8, 1)):
        rows = df.select("status", "score").collect()
        assert len(rows) == 3 and all(r.status == "single_window" and r.score is None for r in rows)
