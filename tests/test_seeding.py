"""k-means|| seeds: reproducible, k of them, and no dearer than evenly spaced ones."""

import numpy as np
from pyspark.sql import functions as F

from shapecode.operators import kmeans as KM
from shapecode.operators import seeding as SD


def samples(spark):
    rng = np.random.default_rng(8)
    rows = []
    for s in (1, 2):
        t = np.arange(3000)
        x = np.sin(t / 7.0) + rng.normal(0, 0.01, len(t))
        x[200 + 30 * s : 212 + 30 * s] += 4.0                     # a few odd beats among many alike
        x[400:406] -= 3.0
        rows += [(s, int(i), float(v)) for i, v in zip(t, x)]
    rows += [(3, i, 0.0) for i in range(1200)]                      # no shapes at all: zero centres
    rows += [(4, i, float(i % 2)) for i in range(1200)]             # one shape (or two)
    return spark.createDataFrame(rows, "source_id bigint, i bigint, value double")


def test_parallel_seeds(spark):
    train, budget = KM.training_set(samples(spark), 12, 2)
    got = SD.parallel_seeds(train, budget, 12).collect()
    again = SD.parallel_seeds(train.repartition(9), budget, 12).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    k = {r.source_id: r.k for r in budget.collect()}
    for s, n in k.items():
        mine = [r for r in got if r.source_id == s]
        assert sorted(r.code for r in mine) == list(range(n)) and len({r.j for r in mine}) == n
    feats = {(r.source_id, r.j): r.feat for r in train.collect()}
    assert all(list(r.center) == (feats[r.source_id, r.j] or [0.0] * 12) for r in got)
    other = SD.parallel_seeds(train, budget, 12, seed="another").collect()
    assert sorted(map(str, other)) != sorted(map(str, got))


def test_parallel_seeds_cost_no_more_than_even_ones(spark):
    train, budget = KM.training_set(samples(spark).where("source_id < 3"), 12, 2)
    cost = lambda centers: {r.source_id: r.cost for r in SD.cost(train, centers).collect()}
    even, drawn = cost(KM.init_centers(train, budget, 12)), cost(SD.parallel_seeds(train, budget, 12))
    assert all(drawn[s] <= even[s] for s in even)
    even, drawn = cost(KM.lloyd(train, budget, 12, 8)), cost(KM.lloyd(train, budget, 12, 8, init="parallel"))
    assert sum(drawn.values()) <= sum(even.values())
    assert KM.lloyd(train, budget, 12, 1, init="parallel").agg(F.count("code")).first()[0] == sum(r.k for r in budget.collect())
