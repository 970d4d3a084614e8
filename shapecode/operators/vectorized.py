"""Vectorised frame coder: the J3 hot path on Arrow batches.

The SQL form (``coding.encode``) evaluates the nearest-code search with
interpreted higher-order functions: fine for small dictionaries, but with
k = 1083 codes of 120 samples it costs ~130k lambda calls per window.  Here
frames travel in blocks of up to ``block`` frames per source (built by the
same single shuffle that cuts frames), each block is joined once with its
source's packed dictionary (so the dictionary is copied once per block, not
per frame), and ``mapInPandas`` codes a whole block with numpy:

* distances are screened with matrix products (``code_index`` skips groups of
  codes that cannot hold the nearest one), then every code within a
  safe margin of the best is re-measured exactly, summing squared
  differences left to right like the SQL form -- codes, distances and
  reconstructions are identical to ``coding.encode``;
* means, norms, features and the reconstruction use the same operation
  order as the SQL expressions.

Output: one row per frame with the columns of ``coding.encode`` that
consumers use (``best`` holds ``struct(d, code)``).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from shapecode.functions.arrays import taper_values
from shapecode.operators.code_index import CodeIndex, IndexCache
from shapecode.session import ship_package

OUT_SCHEMA = ("source_id {sid}, frame_no bigint, frame_ref bigint, frame array<double>, "
              "best array<struct<d:double,code:int>>, src array<double>, coded array<double>, "
              "loss array<double>, score double, status string")


SLICE_ROWS = 16            # block rows that a task holds as Python objects


def map_in_slices(df: DataFrame, run, schema: str, rows: int = SLICE_ROWS) -> DataFrame:
    """``df.mapInPandas(run, schema)``, but ``run`` gets (and its result is made from) at most ``rows`` rows at once.

    A block row holds thousands of numbers and a dictionary, so a whole Arrow
    batch of them as Python objects would fill a worker's memory.
    """
    arrow = to_arrow_schema(DataType.fromDDL(schema))

    def body(batches):
        slices = (b.slice(at, rows).to_pandas() for b in batches for at in range(0, b.num_rows, rows))
        for pdf in run(slices):
            yield pa.RecordBatch.from_pandas(pdf, schema=arrow, preserve_index=False)

    return df.mapInArrow(body, schema)


def list_matrices(column: pa.ListArray):
    """Row number -> matrix of that row's vectors, out of an Arrow column of lists of vectors (nulls are NaN).

    Nothing is made a Python object; vectors of several lengths in one row are an error.
    """
    rows, ends = column.offsets.to_numpy(), column.values.offsets.to_numpy()
    flat = column.values.values.to_numpy(zero_copy_only=False)

    def matrix(r: int) -> np.ndarray:
        at = ends[rows[r]:rows[r + 1] + 1]
        size = np.diff(at)
        width = size[0] if len(size) else 0
        if (size != width).any():
            raise ValueError("vectors of one source have several lengths")
        return flat[at[0]:at[-1]].reshape(len(size), width)

    return matrix


def sample_blocks(samples: DataFrame, frame_len: int, block: int = 64) -> DataFrame:
    """Samples -> ``(source_id, block_no, vals)``: ``block`` consecutive frames
    per row, in one shuffle keyed by (source, block) -- a bounded group."""
    size = frame_len * block
    return samples.groupBy("source_id", F.floor(F.col("i") / F.lit(size)).cast("bigint").alias("block_no")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda z: z["value"]).alias("vals"))


def _seq_sum(a: np.ndarray) -> np.ndarray:
    """Left-to-right sum over the last axis (same rounding as ``aggregate``)."""
    s = np.zeros(a.shape[:-1])
    for p in range(a.shape[-1]):
        s = s + a[..., p]
    return s


def _nearest(feats: np.ndarray, centers: np.ndarray, codes: np.ndarray):
    """Exact arg-min (ties -> lowest code) of sum_p (f_p - c_p)^2."""
    return CodeIndex(centers, codes).nearest(feats)


class Features(NamedTuple):
    """The windows of frames: means, norms, features, which windows have one, and (tapered mode) tapered norms."""
    avg: np.ndarray
    nrm: np.ndarray
    feats: np.ndarray
    valid: np.ndarray
    scale: np.ndarray | None


def window_features(frames: np.ndarray, w: int, n: int, mode: str, taper: np.ndarray) -> Features:
    idx = (np.arange(2 * n - 1)[:, None] * (w // 2) + np.arange(w)[None, :])
    X = frames[:, idx]                                   # (frames, windows, w)
    avg = _seq_sum(X) / w
    nrm = np.sqrt(_seq_sum(X * X))
    with np.errstate(divide="ignore", invalid="ignore"):
        if mode == "centered":
            return Features(avg, nrm, (X - avg[..., None]) / nrm[..., None] * taper, nrm != 0, None)
        tw = X * taper
        tn = np.sqrt(_seq_sum(tw * tw))
        return Features(avg, nrm, tw / tn[..., None], tn != 0, tn)


def rebuild(frames: np.ndarray, s: Features, chosen: np.ndarray, w: int, n: int, mode: str):
    """(src, coded, loss, score) of frames from the chosen centre of every window (zeros where it has none)."""
    h, nw = w // 2, 2 * n - 1
    C = chosen.reshape(len(frames), nw, w)
    a, b = C[:, :-1, h:], C[:, 1:, :h]
    if mode == "centered":
        seg = (a + b) * s.nrm[:, 1:, None] + s.avg[:, 1:, None]
    else:
        seg = a * s.scale[:, :-1, None] + b * s.scale[:, 1:, None]
    coded = seg.reshape(len(frames), (nw - 1) * h)
    src = frames[:, h:frames.shape[1] - h]
    loss = src - coded
    score = np.abs(loss).max(axis=1) if loss.shape[1] else np.full(len(frames), np.nan)
    return src, coded, loss, score


def _encode_block(frames: np.ndarray, index: CodeIndex | None, w: int, n: int, mode: str, taper: np.ndarray):
    nf, nw = len(frames), 2 * n - 1
    s = window_features(frames, w, n, mode, taper)
    code = np.full(nf * nw, -1)
    dist = np.full(nf * nw, np.nan)
    chosen = np.zeros((nf * nw, w))
    if index is not None:
        ok = s.valid.reshape(-1)
        ci, dist[ok] = index.nearest(s.feats.reshape(nf * nw, w)[ok])
        code[ok] = index.codes[ci]
        chosen[ok] = index.centers[ci]
    return code.reshape(nf, nw), dist.reshape(nf, nw), *rebuild(frames, s, chosen, w, n, mode)


def _book_arrays(book):
    if book is None or len(book) == 0:
        return None, None
    codes = np.array([e["code"] for e in book], dtype=np.int64)
    centers = np.array([np.asarray(e["center"], dtype=float) for e in book])
    return centers, codes


def frame_rows(cv, dv, src, coded, loss, score, n: int, has_model: bool) -> list[tuple]:
    """Per-frame output tuples ``(best, src, coded, loss, score, status)``."""
    out = []
    for f in range(len(src)):
        if not has_model:
            out.append(([None] * (2 * n - 1), src[f], None, None, None, "no_model"))
            continue
        best = [None if c < 0 else {"d": float(d), "code": int(c)} for c, d in zip(cv[f], dv[f], strict=True)]
        if coded.shape[1] == 0:        # one window: nothing between two halves to rebuild
            out.append((best, src[f], coded[f], loss[f], None, "single_window"))
        else:
            out.append((best, src[f], coded[f], loss[f], float(score[f]), "ok"))
    return out


def _frame_outputs(frames, index, w, n, mode, taper):
    return frame_rows(*_encode_block(frames, index, w, n, mode, taper), n, index is not None)


def _index(held: IndexCache, source_id, book) -> CodeIndex | None:
    """The index of a source's dictionary row, built once a task."""
    if book is None or len(book) == 0:
        return None
    if source_id not in held.held:
        return held.of(source_id, *_book_arrays(book))
    return held.held[source_id]


def flat_index(held: IndexCache, source_id, codes, centers) -> CodeIndex | None:
    """:func:`_index` of a dictionary given as its codes and its centres one after the other."""
    if codes is None or len(codes) == 0:
        return None
    if source_id not in held.held:
        return held.of(source_id, np.asarray(centers, dtype=float).reshape(len(codes), -1), np.asarray(codes, dtype=np.int64))
    return held.held[source_id]


def encode_blocks(blocks_with_book: DataFrame, w: int, n: int, mode: str = "centered",
                  block: int = 64) -> DataFrame:
    """``(source_id, block_no, vals, book)`` -> one coded row per whole frame.

    Block ``b`` holds frames ``b*block ..``; only whole frames are coded.  A
    dictionary enters the task as two flat arrays, not as an object a code, and
    results leave it every ``SLICE_ROWS`` blocks.
    """
    L = w * n
    taper = np.array(taper_values(w))
    sid_type = dict(blocks_with_book.dtypes)["source_id"]
    cols = ["source_id", "frame_no", "frame_ref", "frame", "best", "src", "coded", "loss", "score", "status"]

    def run(batches):
        held = IndexCache()
        for pdf in batches:
            out = []
            for k, r in enumerate(pdf.itertuples(index=False)):
                if out and k % SLICE_ROWS == 0:
                    yield pd.DataFrame(out, columns=cols)
                    out = []
                vals = np.asarray(r.vals, dtype=float)
                nf = vals.shape[0] // L
                if nf == 0:
                    continue
                frames = vals[:nf * L].reshape(nf, L)
                index = flat_index(held, r.source_id, r.codes, r.centers)
                base = r.block_no * block
                for f, res in enumerate(_frame_outputs(frames, index, w, n, mode, taper)):
                    fno = int(base + f)
                    out.append((r.source_id, fno, fno * L, frames[f], *res))
            if out:
                yield pd.DataFrame(out, columns=cols)

    ship_package(blocks_with_book.sparkSession)
    flat = blocks_with_book.select("source_id", "block_no", "vals", F.col("book.code").alias("codes"), F.flatten("book.center").alias("centers"))
    return flat.mapInPandas(run, OUT_SCHEMA.format(sid=sid_type))


def frame_blocks(frames: DataFrame, meta_cols: list[str], span: int = 1024) -> DataFrame:
    """Frame rows -> ``(source_id, block_no, items)``: the frames of one source
    among ``span`` rows that stand together in the input, so a block never
    holds more than ``span`` frames, whatever their ``frame_ref`` says."""
    key = F.floor(F.monotonically_increasing_id() / F.lit(span)).cast("bigint")
    item = F.struct("frame_ref", "frame", "status", F.struct(*meta_cols).alias("meta"))
    return (frames.withColumn("block_no", key).groupBy("source_id", "block_no")
            .agg(F.collect_list(item).alias("items")))


def encode_frame_rows(frames: DataFrame, packed: DataFrame, w: int, mode: str = "centered",
                      meta_cols: list[str] | None = None, span: int = 1024) -> DataFrame:
    """Vectorised coding of arbitrary frame rows (e.g. a streaming micro-batch).

    ``frames(source_id, frame_ref, frame, status, *meta_cols)``; a frame of
    status ``ok`` holds a whole number of windows, any other row passes
    through uncoded.  Returns the meta columns plus ``best, src, coded, loss,
    score, status``.
    """
    meta_cols = meta_cols or []
    taper = np.array(taper_values(w))
    blocks = frame_blocks(frames, meta_cols, span).join(packed, "source_id", "left")
    sid_type = dict(blocks.dtypes)["source_id"]
    meta_type = frames.select(F.struct(*meta_cols).alias("m")).schema["m"].dataType.simpleString()
    schema = (f"source_id {sid_type}, frame_ref bigint, frame array<double>, meta {meta_type}, "
              "best array<struct<d:double,code:int>>, src array<double>, coded array<double>, "
              "loss array<double>, score double, status string")
    cols = ["source_id", "frame_ref", "frame", "meta", "best", "src", "coded", "loss", "score", "status"]

    def run(batches):
        held = IndexCache()
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                index = _index(held, r.source_id, r.book)
                by_length: dict[int, list] = {}
                for it in r.items:
                    if it["status"] == "ok":
                        by_length.setdefault(len(it["frame"]), []).append(it)
                    else:
                        out.append((r.source_id, int(it["frame_ref"]), it["frame"], it["meta"],
                                    None, None, None, None, None, it["status"]))
                for length, items in by_length.items():
                    frames_ = np.array([np.asarray(it["frame"], dtype=float) for it in items])
                    res_ = _frame_outputs(frames_, index, w, length // w, mode, taper)
                    for it, fr, res in zip(items, frames_, res_):
                        out.append((r.source_id, int(it["frame_ref"]), fr, it["meta"], *res))
            if out:
                yield pd.DataFrame(out, columns=cols)

    ship_package(blocks.sparkSession)
    coded = blocks.mapInPandas(run, schema)
    return coded.select("source_id", "frame_ref", "frame", *[F.col("meta")[c].alias(c) for c in meta_cols],
                        "best", "src", "coded", "loss", "score", "status")


def score_samples(samples: DataFrame, packed: DataFrame, w: int, n: int, mode: str = "centered",
                  block: int = 64) -> DataFrame:
    """W10 batch form on the vectorised path: samples -> blocks -> join the
    dictionary once per block -> code every frame."""
    blocks = sample_blocks(samples, w * n, block)
    return encode_blocks(blocks.join(packed, "source_id", "left"), w, n, mode, block)
