"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows get a global number in the total order (id, text checksum, text length,
a text hash); identical rows are interchangeable.  A generalised Feistel
network over Z_a x Z_b (a*b >= n, a and b near sqrt(n)) permutes the numbers;
a value that lands at or beyond n walks the cycle until it falls below n.
Shard and slot are then arithmetic on the permuted number p: shard = p mod S,
slot = p div S, so shard sizes differ by at most one row and any row's place
can be computed, without data, from (row number, n, seed).

DataFrame functions only.  The text is read once; the range shuffle carries
only id and fixed-size digests of the text.

Defined cases: a null text has no bytes (size = overhead, checksum 0), null
ids sort first, repeated rows each get their own slot, an empty table gives
an empty result, further input columns are ignored whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shapecode.llm.common import shuffle_width, written

ROUNDS = 4
WALK = 64
OVERHEAD = 16
SEED = 20240


def _round_value(seed: int, j: int, right: Column) -> Column:
    """Keyed round function: the first 13 hex digits of an MD5, as a number below 2**52."""
    text = F.concat(F.lit(f"{seed}:{j}:"), right.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def feistel(x: Column, n: int, seed: int, rounds: int = ROUNDS) -> Column:
    """One application of the network to a number below a*b; a bijection of [0, a*b)."""
    a, b = grid(n)
    left = x % F.lit(a)
    right = ((x - left) / F.lit(a)).cast("long")  # exact below 2**53 rows
    for j in range(1, rounds + 1):
        left, right = right, (left + _round_value(seed, j, right)) % F.lit(a if j % 2 else b)
    return left * F.lit(a) + right if rounds % 2 else left + right * F.lit(a)


def grid(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square grid that holds n numbers."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1) if n > 1 else 1
    return a, max(1, -(-n // a))


def global_rows(rows: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """Number the rows 0.. in a total order without one sorting task.

    Rows are range-partitioned and sorted, tagged with (partition, position)
    and written; a prefix sum over one row per partition turns the tags into
    global numbers.  Returns the numbered rows and their count.
    """
    spark = rows.sparkSession
    width = shuffle_width(spark)
    spread = [*order, F.col("_tie")]
    tagged = (rows.withColumn("_tie", F.monotonically_increasing_id())
              .repartitionByRange(width, *spread).sortWithinPartitions(*spread).drop("_tie")
              .withColumn("_m", F.monotonically_increasing_id())
              .withColumn("_part", F.shiftright("_m", 33)).withColumn("_pos", F.col("_m").bitwiseAND(2**33 - 1)).drop("_m"))
    tagged = written(tagged, name)
    parts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    n = int(parts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0])
    # one row per range partition: at most the shuffle width
    starts = parts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_start"))
    return (tagged.join(F.broadcast(starts), "_part").withColumn("row_number", F.col("_start") + F.col("_pos"))
            .drop("_part", "_pos", "_start")), n


def permuted(row: Column, n: int, seed: int) -> Column:
    """The Feistel image of a row number below n, walking the cycle while it is not below n."""
    first = feistel(row, n, seed)
    a, b = grid(n)
    if a * b == n:
        return first
    # a*b - n < a <= sqrt(n) + 1, so a step leaves [0, n) with probability below 2/sqrt(n); a walk visits each
    # number beyond n at most once.
    steps = min(WALK, a * b - n)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first,
                       lambda acc, _: F.when(acc >= F.lit(n), feistel(acc, n, seed)).otherwise(acc))
    return F.when(first < F.lit(n), first).otherwise(walk)


def shard_rows(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
               overhead: int = OVERHEAD) -> DataFrame:
    """(doc_id, size, text_crc32, row_number, permuted, shard, slot) for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
                     F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("_h"))
    rows, n = global_rows(slim, [F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("_h")], "shard-rows")
    p = permuted(F.col("row_number"), n, seed).alias("permuted")
    out = rows.select("doc_id", "size", "text_crc32", "row_number", p)
    inside = F.when(F.col("permuted") < F.lit(max(n, 1)), F.col("permuted")).otherwise(
        F.raise_error(F.lit("cycle walk did not end")).cast("long"))
    return (out.withColumn("permuted", inside)
            .withColumn("shard", (F.col("permuted") % F.lit(shards)).cast("int"))
            .withColumn("slot", F.expr(f"permuted div {int(shards)}")))
