"""Property tests with small generated inputs."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shapecode.operators import coding, evaluate as EV, framing
from shapecode.operators import vectorized as V

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def _samples(spark, sig):
    rows = [(s, i, float(v)) for s, vals in sig.items() for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "source_id bigint, i bigint, value double")


@SETTINGS
@given(st.integers(0, 10_000), st.integers(1, 5))
def test_partitioning_does_not_change_scores(spark, seed, parts):
    rng = np.random.default_rng(seed)
    sig = {s: rng.integers(0, 50, 64 * 3) * 0.005 for s in (1, 2, 3)}
    s = _samples(spark, sig)
    w, n = 8, 4
    frames = framing.tumbling_frames(s, w * n)
    book = coding.pack_codebook(coding.first_frame_codebook(frames, w, n))
    a = V.score_samples(s, book, w, n).select("source_id", "frame_no", "score").collect()
    b = V.score_samples(s.repartition(parts).orderBy(F.rand(seed)), book, w, n) \
        .select("source_id", "frame_no", "score").collect()
    assert sorted(a) == sorted(b)


@SETTINGS
@given(st.integers(0, 10_000))
def test_adding_a_source_does_not_change_others(spark, seed):
    rng = np.random.default_rng(seed)
    sig = {s: rng.normal(size=96) for s in (1, 2)}
    w, n = 8, 4

    def scores(sg):
        s = _samples(spark, sg)
        frames = framing.tumbling_frames(s, w * n)
        book = coding.pack_codebook(coding.first_frame_codebook(frames, w, n))
        return {(r.source_id, r.frame_no): r.score for r in V.score_samples(s, book, w, n).collect()}

    base = scores(sig)
    more = scores({**sig, 7: rng.normal(size=96)})
    assert all(more[k] == v for k, v in base.items())


@SETTINGS
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 600)), min_size=0, max_size=40))
def test_sweep_matches_brute_force(spark, items):
    # scores on the threshold grid (exact ties) and between grid points
    rows = [(1, k, "NV" if pos else "N", q * 0.0025 if q % 2 == 0 else q * 0.00125) for k, (pos, q) in enumerate(items)]
    df = spark.createDataFrame(rows, "source_id bigint, frame_ref bigint, label string, score double")
    curve = {r.t_index: (r.fn, r.fp, r.n) for r in EV.threshold_sweep(df).collect()}
    for i in (0, 1, 2, 7, 100, 239, 240, 241, 499):
        t = i * 0.0025
        fn = sum(1 for r in rows if r[2] != "N" and r[3] < t)
        fp = sum(1 for r in rows if r[2] == "N" and r[3] >= t)
        assert curve[i] == (fn, fp, len(rows))
