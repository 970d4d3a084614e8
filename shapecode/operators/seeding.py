"""k-means|| seeds for the dictionaries of all sources at once.

Each round draws new seeds of a source among its training windows with
probability proportional to the squared distance from the seeds so far.  A
draw is a hash of (seed, round, source, window), so seeds do not depend on
partitions, retries or machines.  Windows are ordered by

    draw * total / distance

(sequential Poisson sampling) and a round takes as many of the smallest as it
lacks of its share of ``k``; values of ``2 n + 16`` or more, which hold
windows that the round would hardly draw, are dropped before the ranking, so
it sees a bounded multiple of ``k`` rows a source.  What is still missing after
the last round is drawn evenly.

Distances are whole multiples of 2**-30, so totals are exact in any order.
Only new seeds are measured in a round; the distances found so far are kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapecode.operators import chunked
from shapecode.operators.kmeans import GRID, window_blocks
from shapecode.session import cut_lineage

ROUNDS = 3
SEED = "seeds-v1"
BLOCK = 256


def draw(round_no: int, source: Column, j: Column, seed: str = SEED) -> Column:
    """A number in (0, 1): 52 bits of a hash."""
    text = F.concat_ws(":", F.lit(seed), F.lit(str(round_no)), source.cast("string"), j.cast("string"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def _distances(blocks: DataFrame, seeds: DataFrame) -> DataFrame:
    """(source_id, j, q): squared distance of every window from the nearest of ``seeds``, in multiples of 2**-30."""
    def features(r):
        return (np.array([np.asarray(it["feat"], dtype=float) for it in r.items]),
                np.array([it["j"] for it in r.items], dtype=np.int64) - r.blk * BLOCK)

    d = chunked.nearest_in_chunks(blocks, chunked.code_chunks(seeds), "blk", features)
    return d.select("source_id", (F.col("blk") * BLOCK + F.col("pos")).alias("j"), F.floor(F.col("d") * F.lit(float(GRID)) + 0.5).cast("bigint").alias("q"))


def parallel_seeds(train: DataFrame, budget: DataFrame, w: int, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """``(source_id, code, j, center)``: ``k`` seeds of every source, codes in the order in which they were drawn."""
    wanted = budget.where("k > 0").select("source_id", "k")
    train = cut_lineage(train.join(wanted.select("source_id"), "source_id", "left_semi"))
    blocks = cut_lineage(window_blocks(train, BLOCK))
    shaped = train.where("feat IS NOT NULL")
    first = shaped.groupBy("source_id").agg(F.min(F.struct(draw(0, F.col("source_id"), F.col("j"), seed).alias("u"), "j")).alias("m"))
    seeds = first.select("source_id", F.lit(0).alias("code"), F.col("m.j").alias("j"))
    with_center = lambda s: s.join(train, ["source_id", "j"]).select(
        "source_id", "code", "j", F.coalesce("feat", F.array_repeat(F.lit(0.0), w)).alias("center"))
    seeds = new = cut_lineage(with_center(seeds))
    state = None
    for r in range(1, rounds + 1):
        now = _distances(blocks, new.select("source_id", "code", "center"))
        state = cut_lineage(now if state is None else now.withColumnRenamed("q", "n").join(state, ["source_id", "j"]).select(
            "source_id", "j", F.least("n", "q").alias("q")))
        totals = state.groupBy("source_id").agg(F.sum("q").alias("total"))
        have = seeds.groupBy("source_id").agg(F.count(F.lit(1)).alias("have"))
        share = wanted.join(have, "source_id").select("source_id", "have", F.ceil((F.col("k") - F.col("have")) / F.lit(rounds - r + 1)).alias("n"))
        order = draw(r, F.col("source_id"), F.col("j"), seed) * F.col("total").cast("double") / F.col("q").cast("double")
        drawn = (state.where("q > 0").join(totals, "source_id").join(share, "source_id").withColumn("x", order).where(F.col("x") < 2 * F.col("n") + 16)
                 .withColumn("rank", F.row_number().over(Window.partitionBy("source_id").orderBy("x", "j"))).where("rank <= n"))
        new = cut_lineage(with_center(drawn.select("source_id", (F.col("have") + F.col("rank") - 1).cast("int").alias("code"), "j")))
        seeds = cut_lineage(seeds.unionByName(new))
    have = seeds.groupBy("source_id").agg(F.count(F.lit(1)).alias("have"))
    lacking = wanted.join(have, "source_id", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < k")
    rest = (train.join(seeds.select("source_id", "j"), ["source_id", "j"], "left_anti").join(lacking, "source_id")
            .withColumn("rank", F.row_number().over(Window.partitionBy("source_id").orderBy(draw(rounds + 1, F.col("source_id"), F.col("j"), seed), "j")))
            .where(F.col("rank") <= F.col("k") - F.col("have")))
    return cut_lineage(seeds.unionByName(with_center(rest.select("source_id", (F.col("have") + F.col("rank") - 1).cast("int").alias("code"), "j"))))


def cost(train: DataFrame, centers: DataFrame) -> DataFrame:
    """(source_id, cost): sum of squared distances from the nearest centre, in multiples of 2**-30."""
    return _distances(window_blocks(train, BLOCK), centers).groupBy("source_id").agg(F.sum("q").alias("cost"))
