"""Text quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are shapes: hashed triples of byte classes (small and capital
letters, digits, white space, single punctuation marks), with the shares of
repeated words and repeated five-word runs.  Logarithmic term counts of a
bounded, documented sample of labelled rows (``per_label`` a label, chosen by a
hash of the id) give the latent space by a truncated singular value
decomposition.  The sample's vectors (per_label x labels x rank numbers, a
proven bound) go to every task, which computes the exact cosines of each
document with all of them in blocks; the nearest neighbours vote with their
label, weighted by similarity and by how many labelled rows each stands for.

Defined cases: null and empty texts have no terms and score the share of good
rows among all labelled ones (a half if there are none); labels that are null
or belong to no document are ignored; rows that repeat an id are scored one
by one; a null id counts as the empty text in the held-out rule; an empty
table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapecode.llm.common import hash_words, text_buffer, whole_windows, window_hash, written
from shapecode.session import ship_package

TERMS = 2048               # hashed shape terms
EXTRA = 2                  # repeated words, repeated five-word runs
PER_LABEL = 2048           # labelled rows of each label that the model may use
RANK = 48
NEIGHBOURS = 25
SHARPNESS = 8.0            # similarity weights are cosines to this power
THRESHOLD = 0.3
FOLDS = 5
EXTRA_WEIGHT = 4.0
ROWS_AT_ONCE = 256


def _byte_classes() -> np.ndarray:
    c = np.zeros(256, dtype=np.int32)
    c[ord("a") : ord("z") + 1] = 1
    c[ord("A") : ord("Z") + 1] = 2
    c[ord("0") : ord("9") + 1] = 3
    c[0x80:] = 1                                   # bytes of other letters
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    c[marks] = np.arange(5, 5 + len(marks))
    c[[0x20, 0x09]] = 4
    c[[0x0A, 0x0D]] = 5 + len(marks)
    return c


_CLASS = _byte_classes()
_KINDS = int(_CLASS.max()) + 1
_TERM = np.random.default_rng(5).integers(0, TERMS, _KINDS**3, dtype=np.int32)


def _shares(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: share of words equal to the word before, share of five-word runs seen before in the text."""
    n = len(first) - 1
    words = np.diff(first)
    owner = np.repeat(np.arange(n), words)
    same = np.zeros(n)
    if len(h) > 1:
        hit = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        same = np.bincount(owner[1:][hit], minlength=n).astype(float)
    text, at = whole_windows(first, 5)
    again = np.zeros(n)
    if len(at):
        g = window_hash(h, 5)[at]
        order = np.lexsort((g, text))
        g, t = g[order], text[order]
        dup = (g[1:] == g[:-1]) & (t[1:] == t[:-1])
        again = np.bincount(t[1:][dup], minlength=n).astype(float)
    return np.stack([same / np.maximum(words - 1, 1), again / np.maximum(words - 4, 1)], axis=1)


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, TERMS + EXTRA) rows of unit length; a text without bytes has zeros."""
    n = len(off) - 1
    out = np.zeros((n, TERMS + EXTRA), dtype=np.float32)
    if len(buf) == 0:
        return out
    cls = np.concatenate([_CLASS[buf], [4, 4]])
    term = _TERM[(cls[:-2] * _KINDS + cls[1:-1]) * _KINDS + cls[2:]]
    size = np.diff(off)
    owner = np.repeat(np.arange(n, dtype=np.int64), size)
    counts = np.bincount(owner * TERMS + term, minlength=n * TERMS).reshape(n, TERMS)
    share = np.log1p(100.0 * counts / np.maximum(size, 1)[:, None])
    norm = np.linalg.norm(share, axis=1, keepdims=True)
    out[:, :TERMS] = share / np.maximum(norm, 1e-12)
    first, (h,) = hash_words(buf, off)
    out[:, TERMS:] = EXTRA_WEIGHT * _shares(h, first)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return out


def _pieces(buf, off, limit=1 << 22):
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, min(a + ROWS_AT_ONCE, int(np.searchsorted(off, off[a] + limit, side="right")) - 1))
        yield buf[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo the number of folds; fold 0 is held out."""
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")) % F.lit(FOLDS)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        per_label: int = PER_LABEL, rank: int = RANK) -> dict:
    """The voting model: projection, sample vectors, votes and weights; at most 2 * per_label rows reach the driver."""
    known = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != 0))
             .groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min(label_col).cast("int").alias("_y"), F.max(label_col).cast("int").alias("_z"))
             .where("_y = _z").drop("_z")
             .join(docs.select(F.col(id_col).cast("long").alias("_id")), "_id", "left_semi"))
    known = written(known, "quality-labels")
    total = {int(r["_y"]): int(r["n"]) for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = total.get(1, 0) / sum(total.values()) if total else 0.5
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * per_label ids
    rows = (docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
            .join(F.broadcast(chosen), "_id").select("_id", "_y", "text"))

    def vectors(batches):
        import pyarrow as pa

        for b in batches:
            buf, off = text_buffer(b.column("text"))
            x = [features(*p) for p in _pieces(buf, off)]
            rows = [r.astype(np.float16).tobytes() for m in x for r in m]     # half precision: the driver holds them all
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_y"), pa.array(rows, pa.binary())],
                                             names=["_id", "_y", "x"])

    # repeated ids could multiply the join: keep the bound
    got = rows.mapInArrow(vectors, "_id long, _y int, x binary").orderBy(F.xxhash64("_id", "x")).limit(2 * per_label).collect()
    model = {"prior": prior, "neighbours": NEIGHBOURS, "projection": None}
    if not got:
        return model
    got.sort(key=lambda r: (r["_id"], r["_y"], bytes(r["x"])))
    y = np.array([r["_y"] for r in got])
    x = np.empty((len(got), TERMS + EXTRA), dtype=np.float32)
    for i, r in enumerate(got):
        x[i] = np.frombuffer(r["x"], dtype=np.float16)
    del got
    mean = x.mean(axis=0)
    x -= mean
    rng = np.random.default_rng(3)
    # randomised truncated decomposition of the centred sample
    q, _ = np.linalg.qr(x @ rng.standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32))
    for _ in range(3):
        z, _ = np.linalg.qr(x.T @ q)
        q, _ = np.linalg.qr(x @ z)
    _, _, vt = np.linalg.svd(q.T @ x, full_matrices=False)
    projection = np.ascontiguousarray(vt[:rank].T, dtype=np.float32)
    latent = x @ projection
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    seen = np.bincount(y, minlength=2)
    weight = np.array([total.get(c, 0) / max(seen[c], 1) for c in (0, 1)])[y]
    return model | {"projection": projection, "mean": mean.astype(np.float32), "latent": latent.astype(np.float32),
                    "votes": y.astype(np.float64), "weight": weight}


def vote(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores of feature rows: the similarity-weighted share of good neighbours."""
    if model["projection"] is None:
        return np.full(len(x), model["prior"])
    z = (x - model["mean"]) @ model["projection"]
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    cosine = z @ model["latent"].T
    k = min(model["neighbours"], cosine.shape[1])
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    w = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** SHARPNESS * model["weight"][near]
    total = w.sum(axis=1)
    score = np.where(total > 0, (w * model["votes"][near]).sum(axis=1) / np.maximum(total, 1e-300), model["prior"])
    return np.where(x.any(axis=1), np.clip(score, 0.0, 1.0), model["prior"])


def score(docs: DataFrame, model: dict, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score column; no shuffle."""
    spark = docs.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(model)       # per_label x 2 x rank numbers

    def run(batches):
        import pyarrow as pa

        for b in batches:
            buf, off = text_buffer(b.column(at))
            s = [vote(held.value, features(*p)) for p in _pieces(buf, off)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(s) if s else np.zeros(0), pa.float64())],
                                             names=[*names, out])

    at, names = docs.columns.index(text_col), docs.columns
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))
