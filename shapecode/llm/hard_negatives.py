"""Hard negatives by anchor-clustered shared lists.

Scores are exact integer inner products of quantised vectors.  Anchors are
dealt into groups of bounded size and clustered by direction within a group;
all other rows are dealt into blocks of one label and bounded size, and a task
is a group with a block.  For each anchor cluster the task sorts its block once
by the angular upper bound

    |x| cos(max(0, angle(x, centre) - radius))

which no member's product with the row x, divided by the member's own length,
exceeds.  Every member walks that shared list, a stretch at a time, until the
bound times its length is below what it still looks for: then no later row can
matter, so each block's answer is certified.  Answers of the blocks (at most
``take`` rows for each anchor or positive and block) are merged by a limited
ranking.  The first round finds the positives in the blocks of the anchor's
label, the second the negatives of every positive in the other blocks; there
the band of allowed scores also ends a walk.

Order: higher score, then smaller id, then the row's digest.  Work grows as
anchors times rows at worst (angles prune little where vectors point
everywhere), in tasks of bounded size.

Defined cases: rows with a null id, a null label, a null vector or a null or
non-finite component take no part; exactly repeated rows (id, label, vector)
count as one row, rows that share an id only are rows of their own; vectors of
unequal length do not meet; zero vectors score 0; a score beyond 64 bits is
kept at the limit; anchors without positives, and positives without negatives
in the band, give no rows; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapecode.llm.common import shuffle_width, written
from shapecode.session import ship_package

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
BAND = (80, 100)           # percent of the positive's score that a negative may have
ANCHORS = 4096             # anchors of one group, on average
CLUSTER = 64               # anchors of one cluster, on average
BLOCK = 1 << 16            # rows of one block, on average, and fewer where the cluster would idle
STEP = 512                 # list entries walked at a time
SPREAD = 32                # copies of the table of labels where it meets the anchors
ROUNDS = 4                 # of the clustering of a group

_LIMIT = 2**63 - 1


def _matrix(column) -> np.ndarray:
    arr = column.combine_chunks()
    flat = np.asarray(arr.flatten(), dtype=np.float64)
    return flat.reshape(len(arr), len(flat) // max(1, len(arr)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of integral rows, as int64 (kept at its limits)."""
    largest = float(np.abs(a).max(initial=0.0)) * float(np.abs(b).max(initial=0.0)) * max(1, a.shape[1])
    if largest < 2**53:
        return (a @ b.T).astype(np.int64)
    if largest < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda x: np.array([[int(v) for v in r] for r in x.tolist()], dtype=object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, -_LIMIT - 1, _LIMIT).astype(np.int64)


def _lengths(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, initial=0.0, keepdims=True)
    top[top == 0] = 1
    return np.linalg.norm(x / top, axis=1) * top[:, 0]


def _units(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    return x / np.where(length > 0, length, 1)[:, None]


def cluster_directions(x: np.ndarray, size: int = CLUSTER, rounds: int = ROUNDS) -> np.ndarray:
    """Cluster number of each row by direction (spherical k-means from evenly spaced rows; zero rows with the first)."""
    n = len(x)
    k = max(1, n // size)
    unit = _units(x, _lengths(x))
    centre = unit[np.linspace(0, n - 1, k).astype(np.int64)] if n else unit
    of = np.zeros(n, dtype=np.int64)
    for _ in range(rounds if k > 1 else 0):
        of = np.argmax(unit @ centre.T, axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, of, unit)
        length = _lengths(total)
        centre = np.where((length > 0)[:, None], _units(total, length), centre)
    return of


def bounds(members: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Per row of x: an upper bound of its product with every member, divided by the member's length."""
    length = _lengths(members)
    unit = _units(members, length)[length > 0]
    norm = _lengths(x)
    if not len(unit):
        return norm
    centre = unit.sum(axis=0)
    if np.linalg.norm(centre) < 1e-9:
        centre = unit[0]
    centre = centre / np.linalg.norm(centre)
    radius = float(np.arccos(np.clip(unit @ centre, -1, 1)).max()) + 1e-6
    angle = np.arccos(np.clip(_units(x, norm) @ centre, -1, 1))
    return norm * np.cos(np.maximum(0.0, angle - radius))


class Wanted:
    """What one member still looks for: the first ``take`` rows with a score in [low, high]."""

    def __init__(self, low: int, high: int, take: int):
        self.low, self.high, self.take = low, high, take
        self.rows: list[tuple] = []                     # (-score, id, digest, row), in order

    def least(self) -> int:
        return max(self.low, -self.rows[-1][0]) if len(self.rows) == self.take else self.low

    def offer(self, score: np.ndarray, ids: np.ndarray, digests: list, at: np.ndarray) -> None:
        near = np.flatnonzero((score >= self.least()) & (score <= self.high))
        if len(near) > 4 * self.take:                   # ties of the last place stay in
            cut = np.partition(score[near], len(near) - self.take)[len(near) - self.take]
            near = near[score[near] >= cut]
        if len(near):
            more = [(-int(score[j]), int(ids[j]), digests[at[j]], int(at[j])) for j in near.tolist()]
            self.rows = sorted(self.rows + more)[: self.take]


def walk(members: np.ndarray, wanted: list[list[Wanted]], x: np.ndarray, ids: np.ndarray, digests: list, own: list) -> int:
    """Every member walks the cluster's shared list until nothing that it wants can follow; returns products computed.

    ``own[i]`` is the digest of member i's own row, which it skips.
    """
    bound = bounds(members, x)
    order = np.argsort(-bound, kind="stable")
    length = _lengths(members)
    active = [i for i in range(len(members)) if wanted[i]]
    done = 0
    for a in range(0, len(order), STEP):
        # no score of a later row is above this
        top = bound[order[a]] * length
        top = np.maximum(np.where(np.isnan(top), np.inf, top + np.abs(top) * 1e-9 + 1e-6), -float(_LIMIT))
        active = [i for i in active if any(w.least() <= top[i] for w in wanted[i])]
        if not active:
            break
        at = order[a : a + STEP]
        score = products(members[active], x[at])
        done += score.size
        for i, s in zip(active, score, strict=True):
            least = min(w.least() for w in wanted[i])
            hot = np.flatnonzero((s >= least) & (s <= max(w.high for w in wanted[i])))
            if own[i] is not None and len(hot):
                hot = hot[[digests[j] != own[i] for j in at[hot].tolist()]]
            for w in wanted[i] if len(hot) else ():
                w.offer(s[hot], ids[at[hot]], digests, at[hot])
    return done


def _divide(a: int, b: int) -> int:
    return -((-a) // b)                                  # rounded up


def _task(look_for: Callable, schema: dict):
    """The applyInArrow function of one round: anchors of a group with the rows of a block."""
    import pyarrow as pa

    def run(key, left, right):
        kinds = {"string": pa.string(), "long": pa.int64()}
        out: list[list] = [[] for _ in schema]
        if left.num_rows and right.num_rows:
            x, ids = _matrix(right.column("embedding")), right.column("vec_id").to_numpy()
            digests = right.column("digest").to_pylist()
            members, own = _matrix(left.column("embedding")), left.column("digest").to_pylist()
            label, cluster = right.column("label")[0].as_py(), left.column("cluster").to_numpy()
            wanted = look_for(left, label)
            for c in np.unique(cluster).tolist():
                of = np.flatnonzero((cluster == c) & np.array([bool(w) for w in wanted]))
                if len(of):
                    walk(members[of], [wanted[i] for i in of.tolist()], x, ids, digests, [own[i] for i in of.tolist()])
            for i, list_of in enumerate(wanted):
                for place, w in enumerate(list_of):
                    for s, vec_id, digest, _row in w.rows:
                        for cell, v in zip(out, (own[i], place, vec_id, digest, -s), strict=True):
                            cell.append(v)
        return pa.table([pa.array(c, kinds[t]) for c, t in zip(out, schema.values(), strict=True)], names=list(schema))
    return run


def _round(anchors: DataFrame, rows: DataFrame, labels: DataFrame, groups: DataFrame, same_label: bool, look_for: Callable, take: int) -> DataFrame:
    """(anchor, place, vec_id, digest, score): the ``take`` best rows for each anchor and place."""
    schema = {"anchor": "string", "place": "long", "vec_id": "long", "digest": "string", "score": "long"}
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    right = rows.join(groups, "dim").withColumn("group", every("groups")).drop("groups")
    meets = F.col("label") == F.col("own_label") if same_label else F.col("label") != F.col("own_label")
    # a row a label, which Spark broadcasts if it measures small; else the shared length alone would gather all anchors in one task
    spread = F.pmod(F.xxhash64("digest"), F.lit(SPREAD)).cast("int")
    left = (anchors.withColumnRenamed("label", "own_label").withColumn("spread", spread)
            .join(labels.withColumn("spread", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))), ["dim", "spread"]).where(meets)
            .withColumn("salt", every("salts")).drop("salts", "spread"))
    key = ["dim", "group", "label", "salt"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_task(look_for, schema), ", ".join(f"{n} {t}" for n, t in schema.items()))
    first = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id", "digest")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= take)


def quantised(df: DataFrame, id_col: str, vector_col: str, label_col: str, relabel: Column | None, scale: int) -> DataFrame:
    """(vec_id, label, embedding, digest, dim): the rows that take part, repeated rows once."""
    x = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), x.alias("embedding"))
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = rows.where(F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound, F.lit(False)))
    if relabel is not None:
        rows = rows.withColumn("label", relabel)
    rows = rows.withColumn("embedding", F.transform("embedding", lambda v: _floor(v * F.lit(float(scale)))))
    rows = rows.withColumn("digest", F.md5(F.concat_ws("|", F.col("vec_id").cast("string"), F.col("label").cast("string"),
                                                      F.concat_ws(",", F.transform("embedding", lambda v: v.cast("string"))))))
    return rows.dropDuplicates(["digest"]).withColumn("dim", F.size("embedding"))


def _floor(v: Column) -> Column:
    """Floor as a double (doubles of 2**52 and more are whole; beyond the range of doubles the largest double)."""
    big = F.abs(v) >= F.lit(2.0**52)
    return F.when(big, F.greatest(F.least(v, F.lit(1.7976931348623157e308)), F.lit(-1.7976931348623157e308))).otherwise(
        F.floor(F.when(big, F.lit(0.0)).otherwise(v)).cast("double") + F.lit(0.0))


def mine(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", is_anchor: Column | None = None,
         relabel: Column | None = None, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES,
         band: tuple[int, int] = BAND, anchors_in_group: int = ANCHORS, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` and ``relabel`` are expressions over vec_id and label.
    """
    spark = df.sparkSession
    ship_package(spark)
    rows = written(quantised(df, id_col, vector_col, label_col, relabel, scale), "vectors")
    chosen = rows.where(is_anchor) if is_anchor is not None else rows
    # groups and blocks of bounded size
    total = rows.count()
    size = max(1, min(block, -(-total // (4 * shuffle_width(spark)))))
    labels = written(rows.groupBy("dim", "label").agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("salts")), "vector-labels")
    groups = written(chosen.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / anchors_in_group).cast("long").alias("groups")), "anchor-groups")
    dealt = rows.join(labels, ["dim", "label"]).withColumn("salt", F.pmod(F.xxhash64("digest"), F.col("salts"))).drop("salts")
    grouped = chosen.join(groups, "dim").withColumn("group", F.pmod(F.xxhash64("digest", F.lit(7)), F.col("groups"))).drop("groups")

    def clusters(rows):
        import pyarrow as pa
        rows = rows.sort_by("digest")
        return rows.append_column("cluster", pa.array(cluster_directions(_matrix(rows.column("embedding")))))

    grouped = written(grouped.groupBy("dim", "group").applyInArrow(
        clusters, "vec_id long, label long, embedding array<double>, digest string, dim int, group long, cluster long"), "anchors")

    best_positives = _round(grouped, dealt, labels, groups, True,
                            lambda left, _label: [[Wanted(-_LIMIT - 1, _LIMIT, positives)] for _ in range(left.num_rows)], positives)
    found = best_positives.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct(
        F.col("rank").cast("long").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("positives"))
    ready = written(grouped.join(found.withColumnRenamed("anchor", "digest"), "digest"), "anchors-with-positives")

    def bands(left, _label):
        return [[Wanted(_divide(band[0] * p["positive_score"], band[1]), p["positive_score"], negatives) for p in list_of]
                for list_of in left.column("positives").to_pylist()]

    best_negatives = _round(ready, dealt, labels, groups, False, bands, negatives)
    who = ready.select(F.col("digest").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.posexplode("positives").alias("place", "p"))
    return (best_negatives.join(who.withColumn("place", F.col("place").cast("long")), ["anchor", "place"])
            .select("anchor_id", F.col("p")["positive_id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                    F.col("vec_id").alias("negative_id"), F.col("p")["positive_score"].alias("positive_score"), F.col("score").alias("negative_score")))
