"""Dictionaries of any size (J2, J3, S13): chunks of codes with a mergeable arg-min.

A dictionary travels as rows of at most ``chunk`` codes.  A block of frames
meets every chunk of its source; each pair gives the nearest code within the
chunk, and Spark's ``min(struct(d, code))`` merges the chunks (map-side first;
ties go to the lowest code).  The chosen centres are joined back by
``(source, code)`` and the frames rebuilt.  Codes, distances and scores equal
those of one row a dictionary bit for bit.

Training assigns windows the same way, so no step holds a source's whole
dictionary in one row, task or group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapecode.functions.arrays import taper_values
from shapecode.operators import vectorized as V
from shapecode.operators.code_index import IndexCache
from shapecode.session import cut_lineage, ship_package

CHUNK = 2048
BROADCAST_BYTES = 10 << 20          # dictionaries of all sources beyond this meet their blocks in a shuffled join


def code_chunks(codebook: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(source_id, chunk, book)``: at most ``chunk`` codes a row, codes in order."""
    item = F.struct(F.col("code").cast("int").alias("code"), F.col("center"))
    return codebook.groupBy("source_id", F.floor(F.col("code") / F.lit(chunk)).cast("int").alias("chunk")).agg(
        F.array_sort(F.collect_list(item)).alias("book"))


def fits_one_chunk(codebook: DataFrame, chunk: int = CHUNK) -> bool:
    """Whether no source has a code beyond the first chunk (one number reaches the driver)."""
    return _fits(codebook.agg(F.max("code")).first()[0], chunk)


def _fits(top, chunk: int) -> bool:
    return top is None or int(top) < chunk


def nearest_in_chunks(blocks: DataFrame, chunks: DataFrame, key: str, features) -> DataFrame:
    """``(source_id, <key>, pos, d, code)``: the nearest code of every feature of every block.

    ``features(row)`` gives the feature matrix of a block row and the
    positions of its rows.
    """
    joined = blocks.join(chunks, "source_id")
    sid = dict(joined.dtypes)["source_id"]

    def run(batches):
        held = IndexCache()
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                feats, pos = features(r)
                if not len(pos):
                    continue
                index = V._index(held, (r.source_id, r.chunk), r.book)
                ci, d = index.nearest(feats)
                out.append((r.source_id, getattr(r, key), pos.astype(np.int32), d, index.codes[ci].astype(np.int32)))
            if out:
                yield pd.DataFrame(out, columns=["source_id", key, "pos", "d", "code"])

    ship_package(joined.sparkSession)
    part = V.map_in_slices(joined, run, f"source_id {sid}, {key} bigint, pos array<int>, d array<double>, code array<int>")
    rows = part.select("source_id", key, F.inline(F.arrays_zip("pos", "d", "code")))
    best = rows.groupBy("source_id", key, "pos").agg(F.min(F.struct("d", "code")).alias("b"))
    return best.select("source_id", key, "pos", "b.d", "b.code")


def score_blocks(blocks: DataFrame, codebook: DataFrame, w: int, n: int, mode: str = "centered", block: int = 64,
                 chunk: int = CHUNK) -> DataFrame:
    """``(source_id, block_no, vals)`` -> one coded row per whole frame, with dictionaries of any size."""
    taper, length = np.array(taper_values(w)), w * n

    def frames_of(r):
        vals = np.asarray(r.vals, dtype=float)
        nf = len(vals) // length
        return vals[: nf * length].reshape(nf, length)

    def features(r):
        f = frames_of(r)
        if not len(f):
            return np.zeros((0, w)), np.zeros(0, dtype=np.int64)
        s = V.window_features(f, w, n, mode, taper)
        pos = np.flatnonzero(s.valid.reshape(-1))
        return s.feats.reshape(-1, w)[pos], pos

    best = nearest_in_chunks(blocks, code_chunks(codebook, chunk), "block_no", features)
    chosen = (best.join(codebook.select("source_id", F.col("code").cast("int").alias("code"), "center"), ["source_id", "code"])
              .groupBy("source_id", "block_no").agg(F.array_sort(F.collect_list(F.struct("pos", "d", "code", "center"))).alias("chosen")))
    known = codebook.select("source_id").distinct().withColumn("has_model", F.lit(True))
    ready = blocks.join(known, "source_id", "left").join(chosen, ["source_id", "block_no"], "left")
    sid = dict(blocks.dtypes)["source_id"]
    cols = ["source_id", "frame_no", "frame_ref", "frame", "best", "src", "coded", "loss", "score", "status"]

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                frames = frames_of(r)
                nf, nw = len(frames), 2 * n - 1
                if not nf:
                    continue
                code, dist, centers = np.full(nf * nw, -1), np.full(nf * nw, np.nan), np.zeros((nf * nw, w))
                for c in r.chosen if r.chosen is not None else ():
                    code[c["pos"]], dist[c["pos"]] = c["code"], c["d"]
                    centers[c["pos"]] = c["center"]
                coded = V.rebuild(frames, V.window_features(frames, w, n, mode, taper), centers, w, n, mode)
                model = r.has_model is True
                for f, res in enumerate(V.frame_rows(code.reshape(nf, nw), dist.reshape(nf, nw), *coded, n, model)):
                    fno = int(r.block_no * block + f)
                    out.append((r.source_id, fno, fno * length, frames[f], *res))
            if out:
                yield pd.DataFrame(out, columns=cols)

    ship_package(blocks.sparkSession)
    return V.map_in_slices(ready, run, V.OUT_SCHEMA.format(sid=sid))


def score_samples(samples: DataFrame, codebook: DataFrame, w: int, n: int, mode: str = "centered", block: int = 64,
                  chunk: int = CHUNK) -> DataFrame:
    """W10 batch form from the long codebook: one pass where every dictionary fits a chunk, chunks merged beyond.

    Dictionaries are broadcast only where their own count says that they are
    small: the planner would go by the size of compressed files.
    """
    from shapecode.operators.coding import pack_codebook
    top, codes = codebook.agg(F.max("code"), F.count("code")).first()
    if _fits(top, chunk):
        packed = pack_codebook(codebook)
        return V.score_samples(samples, packed.hint("merge") if codes * w * 8 > BROADCAST_BYTES else packed, w, n, mode, block)
    return score_blocks(cut_lineage(V.sample_blocks(samples, w * n, block)), codebook, w, n, mode, block, chunk)


def chunked_partials(blocks: DataFrame, centers: DataFrame, grid: int, chunk: int = CHUNK) -> DataFrame:
    """Training with dictionaries of any size: the sums of ``kmeans.block_partials``."""
    sid = dict(blocks.dtypes)["source_id"]

    def features(r):
        return np.array([np.asarray(it["feat"], dtype=float) for it in r.items]), np.arange(len(r.items))

    best = nearest_in_chunks(blocks, code_chunks(centers, chunk), "blk", features)
    codes = best.groupBy("source_id", "blk").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]).alias("codes"))

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                whole = np.rint(features(r)[0] * grid).astype(np.int64)
                codes = np.asarray(r.codes)
                for c in np.unique(codes):
                    m = codes == c
                    out.append((r.source_id, int(c), np.append(whole[m].sum(axis=0), m.sum())))
            if out:
                yield pd.DataFrame(out, columns=["source_id", "code", "vec"])

    return V.map_in_slices(blocks.join(codes, ["source_id", "blk"]), run, f"source_id {sid}, code int, vec array<bigint>")
