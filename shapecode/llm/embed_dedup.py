"""Near-duplicate vectors by collision-counting one-dimensional projections.

Vectors are compared within one label (and one length) only.  Equal vectors
become one class; class representatives are dealt into blocks of bounded size
and every pair of blocks of a label is one task.  A task projects its unit
vectors on many random directions, sorts each projection, and lays a window
around every query's own value; a pair's collisions are the windows that hold
its partner.  Pairs with at least the calibrated number of collisions are
verified by their cosine in double precision.

For a pair at the threshold the collisions are binomial, so the number of
collisions asked for is the largest that keeps the wanted recall; pairs of
higher cosine pass more easily.  Counting looks at every window, so work in a
label grows with the square of its distinct vectors, in blocks spread over
the cluster; tasks return one row a vector, never a row a pair.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null label or id, link with nothing; repeated rows
are one class; vectors of unequal length never link; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapecode.llm.common import written
from shapecode.llm.graph import components
from shapecode.session import ship_package

COSINE = 0.93
PROJECTIONS = 48
WINDOW = 1.0               # half width, in standard deviations of a projected difference at the threshold
RECALL = 0.9995
BLOCK = 2048               # vectors of one block
STEP = 1024                # queries and partners counted at a time
PAIRS = 1 << 16            # candidate pairs verified at a time


def calibrated_count(projections: int = PROJECTIONS, window: float = WINDOW, recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches with at least the wanted probability."""
    p = 2 * NormalDist().cdf(window) - 1
    tail, count = 0.0, projections + 1
    while tail < recall and count > 0:
        count -= 1
        tail += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
    return count


def _directions(dim: int, projections: int) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim, projections))


def _collisions(a: np.ndarray, b: np.ndarray, half: float) -> np.ndarray:
    """counts[i, j]: projections in which j lies in the window around query i."""
    count = np.zeros((len(a), len(b)), dtype=np.uint8)
    for k in range(a.shape[1]):
        order = np.argsort(b[:, k], kind="stable")
        ranked = b[order, k]
        rank = np.empty(len(b), dtype=np.uint16)
        rank[order] = np.arange(len(b), dtype=np.uint16)
        lo = np.searchsorted(ranked, a[:, k] - half, side="left").astype(np.uint16)
        hi = np.searchsorted(ranked, a[:, k] + half, side="right").astype(np.uint16)
        count += (rank[None, :] - lo[:, None]) < (hi - lo)[:, None]     # unsigned: ranks below lo wrap around
    return count


def _verify(cosine: float, projections: int, window: float, recall: float):
    wanted = calibrated_count(projections, window, recall)
    half = window * math.sqrt(2 - 2 * cosine)

    def verify(key, rows):
        import pyarrow as pa

        s, t = key[2].as_py(), key[3].as_py()
        ids, members = rows.column("class_id").to_numpy(), rows.column("members").to_numpy()
        salt = rows.column("salt").to_numpy()
        vec = rows.column("embedding").combine_chunks()
        x = np.asarray(vec.flatten(), dtype=np.float64).reshape(len(ids), -1)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        proj = x @ _directions(x.shape[1], projections)
        left, right = np.flatnonzero(salt == s), np.flatnonzero(salt == t)
        links = np.zeros(len(ids), dtype=np.int64)
        pairs = []
        for i in range(0, len(left), STEP):
            a = left[i : i + STEP]
            for j in range(0, len(right), STEP):
                b = right[j : j + STEP]
                if s == t and j < i:
                    continue
                p, q = np.nonzero(_collisions(proj[a], proj[b], half) >= wanted)
                p, q = a[p], b[q]
                if s == t and i == j:
                    p, q = p[p < q], q[p < q]
                for c in range(0, len(p), PAIRS):
                    u, v = p[c : c + PAIRS], q[c : c + PAIRS]
                    ok = np.einsum("ij,ij->i", x[u], x[v]) >= cosine
                    np.add.at(links, u[ok], members[v[ok]])
                    np.add.at(links, v[ok], members[u[ok]])
                    pairs.append(np.stack([u[ok], v[ok]]).astype(np.int32))
        root = ids.copy()
        u, v = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), dtype=np.int32)
        while True:                      # smallest id that each vector reaches within the task
            before = root.copy()
            np.minimum.at(root, u, before[v])
            np.minimum.at(root, v, before[u])
            if (root == before).all():
                break
        has = links > 0
        return pa.table({"class_id": ids[has], "links": links[has], "root": root[has]})
    return verify


def link_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 cosine: float = COSINE, projections: int = PROJECTIONS, window: float = WINDOW, recall: float = RECALL,
                 block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    ship_package(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
                     F.col(vector_col).cast("array<double>").alias("embedding"))
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    nonzero = F.exists("embedding", lambda v: v != 0.0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound & nonzero, F.lit(False))
    rows = rows.withColumn("vector_key", F.when(usable, F.sha2(F.concat_ws(
        "|", F.col("label").cast("string"), F.concat_ws(",", F.transform("embedding", lambda v: (v + F.lit(0.0)).cast("string")))), 256)))
    good = rows.where("vector_key is not null")
    classes = written(good.groupBy("vector_key").agg(
        F.first("label").alias("label"), F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("members"),
        F.first("embedding").alias("embedding")).withColumn("dim", F.size("embedding")), "vector-classes")
    salts = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("salts"))
    tasks = (classes.join(salts, ["label", "dim"])
             .withColumn("salt", F.pmod(F.xxhash64("vector_key"), F.col("salts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
             .select("label", "dim", F.least("salt", "other").alias("s"), F.greatest("salt", "other").alias("t"),
                     "class_id", "members", "salt", "embedding"))
    found = written(tasks.groupBy("label", "dim", "s", "t").applyInArrow(
        _verify(cosine, projections, window, recall), "class_id long, links long, root long"), "vector-links")
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    known = (classes.join(links, "class_id", "left").join(parts.withColumnRenamed("node", "class_id"), "class_id", "left")
             .select("vector_key", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "class_id").alias("component_id")))
    return (rows.select("vec_id", "vector_key").join(known, "vector_key", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
