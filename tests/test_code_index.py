"""Exact pruned search and dictionaries in chunks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapecode.functions.arrays import taper_values
from shapecode.operators import chunked as CH
from shapecode.operators import coding
from shapecode.operators import vectorized as V
from shapecode.operators.code_index import CodeIndex


def brute(feats, centers, codes):
    d = np.zeros((len(feats), len(centers)))
    for p in range(feats.shape[1]):
        diff = feats[:, p][:, None] - centers[:, p][None, :]
        d = d + diff * diff
    order = np.lexsort((np.broadcast_to(codes, d.shape), d), axis=1)[:, 0]
    return order, d[np.arange(len(feats)), order]


def shapes(n, w, seed):
    """Windows of a beating signal with noise, centred, normalised and tapered."""
    rng = np.random.default_rng(seed)
    t = np.arange(n * 12 + w)
    x = np.sin(t / 9.0) + 2.5 * np.exp(-0.5 * ((t % 173 - 60) / 3.0) ** 2) - 0.6 * np.exp(-0.5 * ((t % 173 - 70) / 5.0) ** 2) + rng.normal(0, 0.02, len(t))
    win = np.stack([x[12 * j : 12 * j + w] for j in range(n)])
    return (win - win.mean(axis=1, keepdims=True)) / np.linalg.norm(win, axis=1, keepdims=True) * np.array(taper_values(w))


def test_index_equals_brute_force():
    rng = np.random.default_rng(3)
    for k, w in ((1, 5), (127, 6), (128, 6), (700, 10), (1083, 24)):
        for centers in (rng.normal(size=(k, w)), shapes(k, w, k) if w > 8 else rng.integers(0, 3, (k, w)).astype(float)):
            centers[k // 2] = centers[0]                                     # ties
            codes = rng.permutation(5 * k)[:k]
            feats = np.concatenate([centers[rng.integers(0, k, 40)], centers[rng.integers(0, k, 60)] + rng.normal(0, 0.05, (60, w)),
                                    rng.normal(size=(50, w)), np.zeros((1, w)), 1e6 * rng.normal(size=(3, w))])
            got_c, got_d = CodeIndex(centers, codes).nearest(feats)
            want_c, want_d = brute(feats, centers, codes)
            assert (codes[got_c] == codes[want_c]).all() and (got_d == want_d).all()
    empty = CodeIndex(np.zeros((0, 4)), np.zeros(0, dtype=int)).nearest(np.ones((2, 4)))
    assert empty[0].tolist() == [-1, -1]


def test_bounds_skip_most_distances_at_the_usual_size():
    """k = 1,083 codes of 120 samples, trained windows of a beating signal: under 30 % of the distances are computed."""
    windows = shapes(10833, 120, 1)
    index = CodeIndex(np.ascontiguousarray(windows[::10][:1083]), np.arange(1083))
    feats = shapes(4000, 120, 2)
    got_c, got_d = index.nearest(feats)
    want_c, want_d = brute(feats[:300], index.centers, index.codes)
    assert (got_c[:300] == want_c).all() and (got_d[:300] == want_d).all()
    assert index.evaluated < 0.3 * index.possible


def samples_df(spark, w, n, sources=3, frames=7):
    rng = np.random.default_rng(9)
    rows = []
    for s in range(sources):
        x = np.sin(np.arange(w * n * frames + 5) / (4.0 + s)) + rng.normal(0, 0.3, w * n * frames + 5)
        x[w * n : w * n + w] = 0.0
        rows += [(s, i, float(v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "source_id bigint, i bigint, value double")


def key(r):
    return (r.source_id, r.frame_no, r.frame_ref, r.status, r.score, tuple(r.coded or []), tuple((x.code, x.d) if x else None for x in r.best))


@pytest.mark.parametrize("mode", ["centered", "tapered"])
def test_chunks_equal_one_row_a_dictionary(spark, mode):
    w, n = 10, 3
    samples = samples_df(spark, w, n)
    rng = np.random.default_rng(4)
    book = [(s, c, rng.normal(size=w).tolist()) for s in range(2) for c in range(25 + 10 * s)]
    book += [(s, c + 100, x) for s, c, x in book]                             # every centre twice, in other chunks: the lower code wins
    codebook = spark.createDataFrame(book, "source_id bigint, code int, center array<double>")
    a = V.score_samples(samples, coding.pack_codebook(codebook), w, n, mode, block=3).collect()
    b = CH.score_blocks(V.sample_blocks(samples, w * n, 3), codebook, w, n, mode, 3, chunk=7).collect()
    assert sorted(map(key, a)) == sorted(map(key, b))
    assert CH.code_chunks(codebook, 7).agg(F.max(F.size("book"))).first()[0] == 7


def test_ten_thousand_codes(spark):
    w, n, k = 8, 4, 10_000
    samples = samples_df(spark, w, n, sources=1, frames=5)
    rng = np.random.default_rng(6)
    codebook = spark.createDataFrame([(0, c, x) for c, x in enumerate(rng.normal(size=(k, w)).tolist())], "source_id bigint, code int, center array<double>")
    a = V.score_samples(samples, coding.pack_codebook(codebook), w, n).collect()
    b = CH.score_samples(samples, codebook, w, n).collect()
    assert sorted(map(key, a)) == sorted(map(key, b))
    assert CH.code_chunks(codebook).agg(F.max(F.size("book"))).first()[0] <= CH.CHUNK


def test_training_in_chunks_gives_the_same_centres(spark):
    from shapecode.operators import kmeans as KM
    s = spark.createDataFrame([(k, i, float(np.sin(i / (5.0 + k)) + ((i * 7919) % 13) / 40)) for k in (1, 2) for i in range(900)],
                              "source_id bigint, i bigint, value double")
    train, budget = KM.training_set(s, 12, 2)
    centers = KM.init_centers(train, budget, 12)
    blocks = KM.window_blocks(train, 16)
    total = lambda p: {(r.source_id, r.code): r.center for r in KM.update_from_partials(p, centers, 12).collect()}
    assert total(KM.block_partials(blocks, centers)) == total(CH.chunked_partials(blocks, centers, KM.GRID, chunk=2))


def test_training_sums_leave_as_arrays(spark, monkeypatch):
    """Sums of every block and code, whatever a task hands on at once, equal a plain count; vectors are no Python objects."""
    from shapecode.operators import kmeans as KM
    rng = np.random.default_rng(6)
    books = {s: np.rint(rng.normal(size=(k, w)) * 64) / 64 for s, k, w in ((1, 5, 4), (2, 1, 4), (3, 140, 3))}
    feats = {s: np.rint(rng.normal(size=(50, b.shape[1])) * 64) / 64 for s, b in books.items()}
    feats[3][7] = books[3][9]
    train = spark.createDataFrame([(s, j, x.tolist()) for s, f in feats.items() for j, x in enumerate(f)], "source_id bigint, j bigint, feat array<double>")
    centers = spark.createDataFrame([(s, c, x.tolist()) for s, b in books.items() for c, x in enumerate(b)], "source_id bigint, code int, center array<double>")
    want = {}
    for s, f in feats.items():
        for j, x in enumerate(f):
            code = int(((x - books[s]) ** 2).sum(axis=1).argmin())
            key = (s, j // 16, code)
            want[key] = want.get(key, 0) + np.append((x * KM.GRID).astype(np.int64), 1)
    want = sorted((s, c, v.tolist()) for (s, _, c), v in want.items())
    for held in (KM.PARTIAL_BYTES, 1):
        monkeypatch.setattr(KM, "PARTIAL_BYTES", held)
        out = KM.block_partials(KM.window_blocks(train, 16), centers)
        assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.source_id, r.code, list(r.vec)) for r in out.collect()) == want
    uneven = train.where("source_id = 1").withColumn("feat", F.expr("IF(j = 3, slice(feat, 1, 2), feat)"))
    with pytest.raises(Exception, match="several lengths"):
        KM.block_partials(KM.window_blocks(uneven), centers).collect()
