"""Similarity join of texts on word n-gram sets, by MinHash banding.

1. Every text gets the hashes of its n-grams (a set), a 128-bit digest of the
   set and ``bands`` band hashes of ``rows`` MinHash values each.  Texts with
   equal sets form one class; only class representatives go on.
2. Representatives are counted per (band, hash).  Buckets of one are dropped,
   and so are buckets all of whose members already share an earlier band.
3. The members of a bucket are dealt into blocks of bounded size; every pair of
   blocks is one task that holds the full n-gram sets of both and verifies its
   pairs exactly (sizes of intersections from 0/1 matrices).  A pair is counted
   in the first band it shares, so in one task only.  Tasks return one row a
   member (links found, smallest linked id), never a row a pair.
4. Links are summed per class, and components come from star contractions.

Bands and rows follow from the wanted recall at the threshold: with r rows, a
pair of similarity s shares a band with probability 1 - (1 - s**r)**b.

Defined cases: a text of fewer than n words is one n-gram of all its words;
null and empty texts have an empty set and link with nothing; rows with a null
id link with nothing; repeated rows are members of one class; different texts
under one id count as one node of the link graph; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapecode.llm.common import hash_words, mix64, text_buffer, whole_windows, window_hash, written
from shapecode.llm.graph import components
from shapecode.session import ship_package

N = 5
THRESHOLD = 0.8
RECALL = 0.9995
ROWS = 5
BLOCK_MEMBERS = 512         # members of a bucket in one block; a task verifies a pair of blocks
BLOCK_GRAMS = 1 << 22       # and n-grams of those members
MATRIX_CELLS = 1 << 24      # members x n-grams per step of a verification


def banding(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The fewest bands that find a pair at the threshold with the wanted probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def _grams(buf, off, n):
    """Per text, its distinct n-gram hashes: (text of each, hash of each), sorted by text and hash."""
    first, (h,) = hash_words(buf, off)
    text, at = whole_windows(first, n)
    g = window_hash(h, n)
    g = g[at] if len(at) else g[:0]
    words = np.diff(first)
    for i in np.flatnonzero((words > 0) & (words < n)):      # short texts: all words are one n-gram
        part = h[first[i] : first[i + 1]]
        g = np.append(g, window_hash(part, len(part), 0xD1B54A32D192ED03))
        text = np.append(text, i)
    order = np.lexsort((g, text))
    g, text = g[order], text[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1])
    return text[new], g[new]


def _signature(text, g, texts, bands, rows):
    """(count, digest a, digest b, band hashes) for every text."""
    count = np.bincount(text, minlength=texts)
    begin = np.cumsum(count) - count
    full = np.flatnonzero(count)
    at = begin[full]
    da, db = np.zeros(texts, dtype=np.uint64), np.zeros(texts, dtype=np.uint64)
    out = np.zeros((texts, bands), dtype=np.int32)
    if len(full):
        da[full] = np.add.reduceat(mix64(g ^ np.uint64(0x5851F42D4C957F2D)), at)
        db[full] = np.add.reduceat(mix64(g * np.uint64(0x2545F4914F6CDD1D) + np.uint64(7)), at)
        seeds = np.random.default_rng(97).integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        shift = np.random.default_rng(98).integers(0, 2**63, bands * rows, dtype=np.uint64)
        for b in range(bands):
            acc = np.zeros(len(full), dtype=np.uint64)
            for r in range(rows):
                k = b * rows + r
                low = np.minimum.reduceat((g ^ shift[k]) * seeds[k], at)
                acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + low)
            out[full, b] = (acc >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return count, da.view(np.int64), db.view(np.int64), out


def _parts(batch, limit=1 << 22):
    """Row ranges of a batch with about ``limit`` bytes of text each."""
    buf, off = text_buffer(batch.column("text"))
    a = 0
    n = len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int, sets: bool = False) -> DataFrame:
    """(doc_id, row_key, grams, set_a, set_b, bands[, gram_set]) for every row; no shuffle."""
    ship_package(docs.sparkSession)

    def sign(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b, buf, off in _parts(batch):
                text, g = _grams(buf, off, n)
                count, da, db, out = _signature(text, g, b - a, bands, rows)
                cols = [batch.column("doc_id").slice(a, b - a), batch.column("row_key").slice(a, b - a), pa.array(count.astype(np.int64)), pa.array(da), pa.array(db),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * bands, bands, dtype=np.int32)),
                                                 pa.array(out.ravel()))]
                names = ["doc_id", "row_key", "grams", "set_a", "set_b", "bands"]
                if sets:
                    end = np.cumsum(count)
                    cols.append(pa.array([g[e - c : e].tobytes() for e, c in zip(end, count, strict=True)], pa.binary()))
                    names.append("gram_set")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"))
    return slim.mapInArrow(sign, "doc_id long, row_key long, grams long, set_a long, set_b long, bands array<int>"
                           + (", gram_set binary" if sets else ""))


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from 0/1 matrices over a bounded number of n-grams at a time."""
    every, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(where, kind="stable")
    where, owner = where[order], owner[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    width = max(1024, MATRIX_CELLS // len(sets))
    for a in range(0, len(every), width):
        lo, hi = np.searchsorted(where, [a, a + width])
        m = np.zeros((len(sets), min(width, len(every) - a)), dtype=np.float32)
        m[owner[lo:hi], where[lo:hi] - a] = 1
        out += m @ m.T
    return out


def _verify(threshold):
    def verify(key, rows):
        import pyarrow as pa

        band, s, t = key[0].as_py(), key[2].as_py(), key[3].as_py()
        ids, members = rows.column("class_id").to_numpy(), rows.column("members").to_numpy()
        salt = rows.column("salt").to_numpy()
        sets = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in rows.column("gram_set")]
        hashes = np.array(rows.column("bands").to_pylist(), dtype=np.int64).reshape(len(ids), -1)
        size = np.array([len(x) for x in sets], dtype=np.float64)
        both = _shared(sets)
        link = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
        np.fill_diagonal(link, False)
        for j in range(band):                                # pairs that share an earlier band are counted there
            link &= hashes[:, j][:, None] != hashes[:, j][None, :]
        if s != t:
            link &= salt[:, None] != salt[None, :]
        n_links = link @ members
        has = link.any(axis=1)
        least = np.where(link, ids[None, :], np.iinfo(np.int64).max).min(axis=1)
        root = np.minimum(least, ids)
        # smallest id within this task that the member reaches
        while True:
            nxt = np.minimum(root, np.where(link, root[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (nxt == root).all():
                break
            root = nxt
        return pa.table({"class_id": ids[has], "links": n_links[has].astype(np.int64), "root": root[has]})
    return verify


def link_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD,
               recall: float = RECALL, rows: int = ROWS, block_members: int = BLOCK_MEMBERS) -> DataFrame:
    """(doc_id, row_key, class_id, n_links, group_id, kept) for every row; row_key hashes id and text.

    class_id: smallest doc_id with the same n-gram set; n_links: other rows linked
    directly (equal sets included); group_id: smallest doc_id reachable by links;
    kept: the row's id is its group's (repeats of one row are all kept or all not).
    """
    bands = banding(threshold, recall, rows)
    sig = written(signatures(docs, id_col, text_col, n, bands, rows), "signatures")
    usable = sig.where((F.col("grams") > 0) & F.col("doc_id").isNotNull())
    classes = written(usable.groupBy("set_a", "set_b", "grams")
                      .agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("members"),
                           F.first("bands").alias("bands")), "classes")
    # one entry per band of a representative; only entries in buckets of two or more go on
    entry = classes.select("class_id", "members", "grams", F.posexplode("bands").alias("band", "hash"))
    shared = entry.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("band", "hash")
    entry = written(entry.join(shared, ["band", "hash"]), "band-entries")
    earlier = entry.select("class_id", "band", "hash", "grams").join(
        classes.join(entry.select("class_id").distinct(), "class_id", "left_semi").select("class_id", "bands"), "class_id")
    least = [F.min(F.when(F.col("band") > j, F.col("bands")[j])).alias(f"_l{j}") for j in range(bands)]
    most = [F.max(F.when(F.col("band") > j, F.col("bands")[j])).alias(f"_h{j}") for j in range(bands)]
    covered = F.lit(False)
    for j in range(bands):
        covered = covered | F.coalesce(F.col(f"_l{j}") == F.col(f"_h{j}"), F.lit(False))
    buckets = (earlier.groupBy("band", "hash")
               .agg(F.count(F.lit(1)).alias("_m"), F.sum("grams").alias("_g"), *least, *most).where(~covered)
               .select("band", "hash", F.greatest(F.ceil(F.col("_m") / block_members),
                                                  F.ceil(F.col("_g") / BLOCK_GRAMS)).cast("int").alias("salts")))
    tasks = (entry.join(buckets, ["band", "hash"])
             .withColumn("salt", F.pmod(F.xxhash64("class_id", "band"), F.col("salts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
             .select("class_id", "members", "band", "hash", "salt", F.least("salt", "other").alias("s"),
                     F.greatest("salt", "other").alias("t")))
    tasks = written(tasks, "verify-tasks")
    # the n-gram sets of the representatives that any task needs, from their own texts
    wanted = tasks.select("class_id").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(wanted.withColumnRenamed("class_id", "doc_id"), "doc_id", "left_semi")
    chosen = classes.select("class_id", "set_a", "set_b")
    full = (signatures(texts, "doc_id", "text", n, bands, rows, sets=True).withColumnRenamed("doc_id", "class_id")
            .join(chosen, ["class_id", "set_a", "set_b"], "left_semi").dropDuplicates(["class_id", "set_a", "set_b"])
            .select("class_id", "bands", "gram_set"))
    held = tasks.join(full, "class_id").select("class_id", "members", "salt", "bands", "gram_set", "band", "hash", "s", "t")
    found = written(held.groupBy("band", "hash", "s", "t")
                    .applyInArrow(_verify(threshold), "class_id long, links long, root long"), "links")
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    known = (classes.join(links, "class_id", "left")
             .join(parts.withColumnRenamed("node", "class_id"), "class_id", "left")
             .select("set_a", "set_b", "grams", "class_id",
                     (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "class_id").alias("group_id")))
    # two different sets may have a representative of the same id (repeated ids): the digest is the key
    out = sig.join(known, ["set_a", "set_b", "grams"], "left")
    linked = F.col("doc_id").isNotNull() & (F.col("grams") > 0)
    pick = lambda c, other: F.when(linked, F.col(c)).otherwise(other)
    return out.select("doc_id", "row_key", pick("class_id", F.col("doc_id")).alias("class_id"),
                      F.coalesce(pick("n_links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
                      pick("group_id", F.col("doc_id")).alias("group_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("group_id"), F.lit(True)))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs``, same columns, with one row of each group: its smallest (id, hash of id and text).

    Rows that link with nothing (null ids, null and empty texts among them) all
    stay; of rows with equal id and text one stays.
    """
    names = docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)])
    at, text = f"_c{names.index(id_col)}", f"_c{names.index(text_col)}"
    own = own.withColumn("_key", F.xxhash64(at, text))
    grouped = link_texts(docs, id_col, text_col, **options).where(F.col("n_links") > 0)   # only these can go
    place = F.struct("doc_id", "row_key")
    firsts = grouped.groupBy("group_id").agg(F.min(place).alias("_first"))
    gone = grouped.join(firsts, "group_id").where(place != F.col("_first")).select("row_key").distinct()
    again = grouped.groupBy("row_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("row_key").alias("_again"))
    left = own.join(gone, F.col("_key") == F.col("row_key"), "left_anti").join(again, F.col("_key") == F.col("_again"), "left")
    single = left.where("_again is null").drop("_again", "_key")
    first = (left.where("_again is not null").groupBy("_again")
             .agg(F.first(F.struct(*[c for c in own.columns if c != "_key"])).alias("r")).select("r.*"))
    return single.unionByName(first).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])
