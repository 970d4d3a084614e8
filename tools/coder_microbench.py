"""Coder throughput at the reference's dictionary size (W=120, n=15, k=1083).

Synthetic frames (not a registered query): compares the SQL coder
(higher-order functions) with the vectorised block coder on the same rows
and checks they agree.  Usage: python tools/coder_microbench.py [frames]
"""

from __future__ import annotations

import os
import sys
import time

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from shapecode.operators import coding, framing  # noqa: E402
from shapecode.operators import vectorized as V  # noqa: E402
from shapecode.session import get_session  # noqa: E402


def vectorized_rate(spark, n_frames=512, w=120, n=15, k=1083):
    """Frames coded per second by the block coder on a beating signal, k codes taken from its own windows."""
    L = w * n
    rng = np.random.default_rng(1)
    t = np.arange(n_frames * L)
    x = np.sin(t / 90.0) + 2.5 * np.exp(-0.5 * ((t % 290 - 60) / 4.0) ** 2) + rng.normal(0, 0.02, len(t))
    from shapecode.functions.arrays import taper_values
    win = np.stack([x[12 * j : 12 * j + w] for j in range(k)])
    centers = (win - win.mean(axis=1, keepdims=True)) / np.linalg.norm(win, axis=1, keepdims=True) * np.array(taper_values(w))
    blocks = [(1, b, x[b * 64 * L : (b + 1) * 64 * L].tolist()) for b in range(n_frames // 64)]
    book = coding.pack_codebook(spark.createDataFrame([(1, c, v) for c, v in enumerate(centers.tolist())],
                                                      "source_id bigint, code int, center array<double>"))
    df = spark.createDataFrame(blocks, "source_id bigint, block_no bigint, vals array<double>").repartition(len(blocks)).join(book, "source_id").cache()
    df.count()
    coded = V.encode_blocks(df, w, n).select("source_id", "frame_no", "score")
    coded.write.format("noop").mode("overwrite").save()    # warm
    t = time.time()
    coded.write.format("noop").mode("overwrite").save()
    return n_frames / (time.time() - t)


def main():
    n_frames = int(sys.argv[1]) if len(sys.argv) > 1 else 64
    w, n, k = 120, 15, 1083
    L = w * n
    spark = get_session()
    rng = np.random.default_rng(0)
    sig = np.sin(np.arange(n_frames * L) / 25.0) + rng.normal(0, 0.1, n_frames * L)
    samples = spark.createDataFrame(
        [(1, i, float(v)) for i, v in enumerate(sig)], "source_id bigint, i bigint, value double").cache()
    samples.count()
    centers = rng.normal(size=(k, w))
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    book = coding.pack_codebook(spark.createDataFrame(
        [(1, c, [float(x) for x in centers[c]]) for c in range(k)], "source_id bigint, code int, center array<double>")).cache()
    book.count()
    frames = framing.tumbling_frames(samples, L).cache()
    frames.count()
    out = {}
    for name, df in [("vectorized", V.score_samples(samples, book, w, n)),
                     ("sql", coding.score_frames(frames, book, w, n))]:
        df.select("score").write.format("noop").mode("overwrite").save()   # warm
        t = time.time()
        df.select("source_id", "frame_no", "score").write.format("noop").mode("overwrite").save()
        out[name] = time.time() - t
    a = sorted((r.frame_no, r.score) for r in V.score_samples(samples, book, w, n).select("frame_no", "score").collect())
    b = sorted((r.frame_no, r.score) for r in coding.score_frames(frames, book, w, n).select("frame_no", "score").collect())
    print({"frames": n_frames, "k": k, "w": w, "windows_per_frame": 2 * n - 1,
           "vectorized_frames_per_sec": round(n_frames / out["vectorized"], 1),
           "sql_frames_per_sec": round(n_frames / out["sql"], 2), "equal": a == b})


if __name__ == "__main__":
    main()
