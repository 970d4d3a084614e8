"""Shared helpers: input tables, written cut points, sizes and word hashing.

Intermediate tables go to a fresh folder below ``spark.checkpoint.dir`` (the
folder that driver and executors share), written as Parquet and read back, so
a lost executor only costs the tasks it was running.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapecode.session import ensure_checkpoint_dir

_MADE: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder path below the shared checkpoint folder."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back (a reliable cut of the lineage)."""
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made(spark: SparkSession) -> list[str]:
    """The folders this application's operators wrote and did not release, oldest first."""
    return list(_MADE.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, keep: list[str] | tuple[str, ...] = ()) -> int:
    """Delete the folders this application's operators wrote, but for ``keep``; call it once their results are stored."""
    kept = set(keep)
    gone = [p for p in made(spark) if p not in kept]
    for p in gone:
        delete(spark, p)
    _MADE[spark.sparkContext.applicationId] = [p for p in made(spark) if p in kept]
    return len(gone)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that this module handed out."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_size(df: DataFrame, text_col: str) -> tuple[int, int]:
    """(rows, characters) of a text column; one column scan, one row to the driver."""
    r = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.col(text_col))), F.lit(0))).first()
    return int(r[0]), int(r[1])


# ---------------------------------------------------------------- word hashing (numpy, inside Arrow tasks)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_GOLD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=4)
def _letters(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(1 << max(16, (n - 1).bit_length()), np.uint64(base), dtype=np.uint64)
        out[0] = 1
        _POWERS[base] = np.cumprod(out, dtype=np.uint64)
    return _POWERS[base][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _poly(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int, base: int, inverse: int) -> np.ndarray:
    pre = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_letters(seed)[buf] * _powers(base, len(buf)), dtype=np.uint64, out=pre[1:])
    h = (pre[ends] - pre[starts]) * _powers(inverse, len(buf))[starts]
    return mix64(h ^ ((ends - starts).astype(np.uint64) * _GOLD))


_BASES = tuple((seed, base, pow(base, -1, 2**64)) for seed, base in ((11, 0xD6E8FEB86659FD93), (23, 0xA0761D6478BD642F)))


def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null is an empty text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks)
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    if len(off) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    return buf[off[0] : off[-1]], off - off[0]


def hash_words(buf: np.ndarray, off: np.ndarray, hashes: int = 1, piece: int = 1 << 20):
    """Words (runs without ASCII white space) of texts laid end to end.

    Returns ``(first, h)``: ``first[i]`` is the number of words before text i
    (one more entry than texts) and ``h`` one uint64 array per wanted hash.
    Works through at most ``piece`` bytes at a time (more only for one word
    that is longer).
    """
    n = len(buf)
    if n == 0:
        return np.zeros(len(off), dtype=np.int64), [np.zeros(0, dtype=np.uint64) for _ in range(hashes)]
    space = _SPACE[buf]
    word = ~space
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    begin = word.copy()
    begin[1:] &= space[:-1] | edge[1:n]
    starts = np.flatnonzero(begin)
    last = word.copy()
    last[:-1] &= space[1:] | edge[1:n]
    ends = np.flatnonzero(last) + 1
    first = np.searchsorted(starts, off).astype(np.int64)
    out = [np.empty(len(starts), dtype=np.uint64) for _ in range(hashes)]
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + piece, side="right")))
        lo, hi = starts[a], ends[b - 1]
        for k in range(hashes):
            out[k][a:b] = _poly(buf[lo:hi], starts[a:b] - lo, ends[a:b] - lo, *_BASES[k])
        a = b
    return first, out


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: int = 1, piece: int = 1 << 20) -> list[np.ndarray]:
    """One uint64 array per wanted hash of the byte spans, given in order; at most ``piece`` bytes at a time (or one span)."""
    out = [np.empty(len(starts), dtype=np.uint64) for _ in range(hashes)]
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + piece, side="right")))
        lo, hi = starts[a], ends[b - 1]
        for k in range(hashes):
            out[k][a:b] = _poly(buf[lo:hi], starts[a:b] - lo, ends[a:b] - lo, *_BASES[k])
        a = b
    return out


def window_hash(h: np.ndarray, k: int, factor: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words (runs over text ends included; mask them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    acc = h[:n].copy()
    c = np.uint64(factor)
    for j in range(1, k):
        acc *= c
        acc += h[j : j + n]
    return mix64(acc)


def whole_windows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, word position) of every run of k words that lies inside one text."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    total = int(count.sum())
    before = np.cumsum(count) - count
    return text, np.arange(total) - before[text] + first[:-1][text]
