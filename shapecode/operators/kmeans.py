"""Dictionary training (A13-A15): k-means over window shapes, every source at once.

One DataFrame Lloyd loop over ``train(source_id, j, feat)``, on one path
whatever the sizes:

* init  -- ``k`` evenly spaced training windows per source
  (code ``c`` <- window ``floor(c * tr / k)``), deterministic; an all-zero
  seed window has no shape and seeds a zero centre, so ``k`` codes remain;
  or k-means|| (``seeding``), drawn by hashes;
* assign + partial update -- training windows are grouped once into blocks
  of up to 256 windows per source; each iteration joins a block with the
  packed centres of its source (one dictionary copy per block) and a
  Python task finds every window's nearest centre exactly (same
  arithmetic as the SQL arg-min) and emits, per code present in the block,
  the vector sum with the member count as its last element;
* update -- partial sums are added per ``(source, code)``, a column a position
  (map-side partial aggregation; a hot source's codes spread over many keys);
* a code that lost all its windows keeps its previous centre;
* the centres are cut from the lineage after each iteration with a
  reliable checkpoint (shared storage), so a lost executor never replays
  earlier iterations.

Features are multiples of ``1/GRID``, so sums over members are exact whole
numbers in any order, centres do not depend on partitioning, and the loop ends
early exactly when an iteration changes no centre.

``fit_ml_codebook`` is the library path (``pyspark.ml`` KMeans, one source).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapecode.functions import arrays as A
from shapecode.operators import framing
from shapecode.session import cut_lineage, ship_package


GRID = 1 << 30             # features are multiples of 1 / GRID
ITERATIONS = 20
PARTIAL_BYTES = 4 << 20    # sums that a training task holds before it hands them on


def on_grid(arr: str) -> str:
    """Feature vector rounded to the grid."""
    return f"transform({arr}, v -> floor(v * {GRID}D + 0.5D) / {GRID}D)"


def window_feature_expr(w_col: str, w: int) -> str:
    """P7 + W5 on a single window column, on the grid (NULL for an all-zero window)."""
    taper = A.array_literal(A.taper_values(w))
    avg = f"({A.sum_expr(w_col)} / {w})"
    nrm = f"sqrt({A.sumsq_expr(w_col)})"
    feat = on_grid(f"zip_with(transform({w_col}, v -> (v - s.a) / s.n), {taper}, (a, b) -> a * b)")
    return f"transform(array(named_struct('a', {avg}, 'n', {nrm})), s -> IF(s.n = 0D, NULL, {feat}))[0]"


def training_set(samples: DataFrame, w: int, step: int) -> tuple[DataFrame, DataFrame]:
    """(train(source_id, j, feat), budget) -- the first 20 % of sliding windows
    (``feat`` is NULL for an all-zero window).

    The budget, a row a source, is kept: the windows and the seeds both need
    it, and counting reads every sample.
    """
    budget = cut_lineage(framing.training_budget(samples, w, step))
    wins = framing.sliding_windows(samples, w, step, budget)
    train = wins.select("source_id", "j", F.expr(window_feature_expr("w", w)).alias("feat"))
    return A.fence(train), budget


def init_centers(train: DataFrame, budget: DataFrame, w: int) -> DataFrame:
    """Code ``c`` starts at training window ``floor(c * tr / k)``, ``c < k`` (a zero centre for an all-zero window)."""
    b = budget.where(F.col("k") > 0).select("source_id", "tr", "k")
    t = train.join(b, "source_id")
    c = F.floor((F.col("j") * F.col("k") + F.col("tr") - 1) / F.col("tr")).cast("bigint")
    t = t.withColumn("code", c)
    t = t.where((F.col("code") < F.col("k")) & (F.floor(F.col("code") * F.col("tr") / F.col("k")) == F.col("j")))
    return t.select("source_id", F.col("code").cast("int").alias("code"), F.coalesce("feat", F.array_repeat(F.lit(0.0), w)).alias("center"))


def assign(train: DataFrame, centers: DataFrame) -> DataFrame:
    """J3 for training windows: ``(source_id, j, feat, code, d)``.

    Windows meet chunks of their source's codes in blocks (``chunked``), not
    with a copy of the dictionary each.  Sources that hold a vector with a
    null, non-finite or missing component, or vectors of several lengths, are
    measured by the SQL expression, which defines their distances.
    """
    vectors = train.select("source_id", F.col("feat").alias("v")).unionByName(centers.select("source_id", F.col("center").alias("v")))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    plain = cut_lineage(vectors.where(F.col("v").isNotNull()).groupBy("source_id").agg(
        F.max(odd).alias("_odd"), F.min(F.size("v")).alias("_lo"), F.max(F.size("v")).alias("_hi"))
        .where(~F.col("_odd") & (F.col("_lo") == F.col("_hi"))).select("source_id"))
    usable = F.col("feat").isNotNull()
    rest = train.where(~usable).unionByName(train.where(usable).join(plain, "source_id", "left_anti"))
    return _assign_blocks(train.where(usable).join(plain, "source_id", "left_semi"), centers).unionByName(_assign_sql(rest, centers))


def _assign_blocks(train: DataFrame, centers: DataFrame) -> DataFrame:
    import numpy as np

    from shapecode.operators import chunked

    item = F.struct("j", "feat")
    blocks = cut_lineage(train.groupBy("source_id", F.floor(F.col("j") / F.lit(256)).cast("bigint").alias("blk"))
                         .agg(F.array_sort(F.collect_list(item)).alias("items")))

    def features(r):
        return np.array([np.asarray(it["feat"], dtype=float) for it in r.items]), np.arange(len(r.items))

    best = chunked.nearest_in_chunks(blocks, chunked.code_chunks(centers), "blk", features)
    rows = blocks.select("source_id", "blk", F.posexplode("items").alias("pos", "x"))
    return rows.join(best, ["source_id", "blk", "pos"]).select("source_id", "x.j", "x.feat", "code", "d")


def _assign_sql(train: DataFrame, centers: DataFrame) -> DataFrame:
    packed = centers.groupBy("source_id").agg(
        F.array_sort(F.collect_list(F.struct("code", "center"))).alias("book"))
    t = train.join(packed, "source_id", "inner")
    best = F.expr(A.nearest_expr("array(feat)", "book"))[0]
    out = A.fence(t.withColumn("b", best).drop("book"))
    return out.select("source_id", "j", "feat", F.col("b.code").alias("code"), F.col("b.d").alias("d"))


def window_blocks(train: DataFrame, block: int = 256) -> DataFrame:
    """``train(source_id, j, feat)`` -> ``(source_id, blk, items)``, at most
    ``block`` windows per row (a bounded group)."""
    return train.where(F.col("feat").isNotNull()).groupBy("source_id", F.floor(F.col("j") / F.lit(block)).cast("bigint").alias("blk")).agg(
        F.collect_list(F.struct("j", "feat")).alias("items"))


def block_partials(blocks: DataFrame, centers: DataFrame) -> DataFrame:
    """Assign every window of every block; emit per (source, code) ``vec``: the
    member features' sum in grid units, then the member count."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DataType

    from shapecode.operators import chunked
    from shapecode.operators.code_index import IndexCache
    from shapecode.operators.vectorized import list_matrices

    if not chunked.fits_one_chunk(centers):
        return chunked.chunked_partials(blocks, centers, GRID)
    packed = centers.groupBy("source_id").agg(
        F.array_sort(F.collect_list(F.struct("code", "center"))).alias("book"))
    joined = blocks.join(packed, "source_id", "inner")
    sid = dict(joined.dtypes)["source_id"]
    schema = f"source_id {sid}, code int, vec array<bigint>"
    arrow = to_arrow_schema(DataType.fromDDL(schema))

    def table(sources, rows, codes, vecs):
        ends = np.cumsum([0, *(len(v) for v in vecs)], dtype=np.int32)
        vec = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(vecs), pa.int64()), type=arrow.field("vec").type)
        return pa.RecordBatch.from_arrays([sources.take(pa.array(rows, pa.int32())), pa.array(codes, pa.int32()), vec], schema=arrow)

    def run(batches):
        held = IndexCache()
        for b in batches:
            sources, feats, books, codes = b.column("source_id"), list_matrices(b.column("feats")), list_matrices(b.column("centers")), b.column("codes")
            of, flat = codes.offsets.to_numpy(), codes.values.to_numpy()
            out, size = ([], [], []), 0
            for r, source in enumerate(sources.to_pylist()):
                index = held.held.get(source) or held.of(source, books(r), flat[of[r]:of[r + 1]].astype(np.int64))
                x = feats(r)
                if not len(x):
                    continue
                ci, _d = index.nearest(x)
                # the sums of the blocks' codes: windows in order of their code, added up run by run
                order = np.argsort(ci, kind="stable")
                first = np.flatnonzero(np.diff(ci[order], prepend=ci[order[0]] - 1))
                whole = np.append(np.rint(x * GRID).astype(np.int64), np.ones((len(x), 1), dtype=np.int64), axis=1)
                sums = np.add.reduceat(whole[order], first, axis=0)
                for to, new in zip(out, ([r] * len(sums), index.codes[ci[order[first]]], sums), strict=True):
                    to.extend(new)
                size += sums.nbytes
                if size > PARTIAL_BYTES:
                    yield table(sources, *out)
                    out, size = ([], [], []), 0
            if size:
                yield table(sources, *out)

    ship_package(joined.sparkSession)
    flat_rows = joined.select("source_id", F.col("items.feat").alias("feats"), F.col("book.code").alias("codes"), F.col("book.center").alias("centers"))
    return flat_rows.mapInArrow(run, schema)


def update_from_partials(partials: DataFrame, previous: DataFrame, w: int) -> DataFrame:
    """Centre = summed member features / member count; empty codes keep theirs."""
    # one sum a position, in one row a code: a single shuffle, added up on the map side first
    new = partials.groupBy("source_id", "code").agg(*[F.sum(F.col("vec")[p]).alias(f"_{p}") for p in range(w + 1)])
    members = F.col(f"_{w}").cast("double")
    new = new.select("source_id", "code", F.array(*[F.col(f"_{p}").cast("double") / members / F.lit(float(GRID)) for p in range(w)]).alias("new_center"))
    return (previous.join(new, ["source_id", "code"], "left")
            .select("source_id", "code", F.coalesce("new_center", "center").alias("center")))


def lloyd(train: DataFrame, budget: DataFrame, w: int, max_iter: int = ITERATIONS, init: str = "even") -> DataFrame:
    """All-source Lloyd iterations; returns the long codebook.

    ``init``: ``even`` (evenly spaced windows) or ``parallel`` (k-means||, ``seeding``).

    Runs ``max_iter`` iterations, or fewer where one changes no centre (every
    later one would repeat it); one checksum per iteration reaches the driver.
    """
    train = cut_lineage(train)      # read every iteration: materialise once
    if init not in ("even", "parallel"):
        raise ValueError("init must be even or parallel")
    if init == "even":
        centers = cut_lineage(init_centers(train, budget, w))
    else:
        from shapecode.operators.seeding import parallel_seeds
        centers = parallel_seeds(train, budget, w).drop("j")
    blocks = cut_lineage(window_blocks(train))
    mark = F.sum(F.xxhash64("source_id", "code", "center").cast("decimal(38,0)"))
    seen = centers.agg(mark).first()[0]
    for _ in range(max_iter):
        centers = cut_lineage(update_from_partials(block_partials(blocks, centers), centers, w))
        now = centers.agg(mark).first()[0]
        if now == seen:
            break
        seen = now
    return centers


def fit_ml_codebook(train_one_source: DataFrame, k: int, max_iter: int = 20, seed: int = 1,
                    with_members: bool = False) -> DataFrame:
    """A13(a): ``pyspark.ml`` KMeans over one training set; returns ``(code, center)``
    (plus ``n_members`` from the model's own assignment when asked)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = train_one_source.select(array_to_vector("feat").alias("features"))
    model = KMeans(k=k, maxIter=max_iter, seed=seed, initMode="k-means||").fit(data)
    spark = train_one_source.sparkSession
    # the model holds k centres (its size is k x W by construction)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    centers = spark.createDataFrame(rows, "code int, center array<double>")
    if not with_members:
        return centers
    members = (model.transform(data).groupBy(F.col("prediction").cast("int").alias("code"))
               .agg(F.count(F.lit(1)).alias("n_members")))
    return centers.join(members, "code", "left").select(
        "code", "center", F.coalesce("n_members", F.lit(0)).alias("n_members"))
