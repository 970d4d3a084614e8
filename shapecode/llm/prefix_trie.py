"""The trie of conversation prefixes, with subtree totals by time-forward processing.

A turn becomes a digest of its role and text where it is read, so texts are
not shuffled.  A prefix is known by its depth and 128 bits: the exclusive or,
run along the conversation, of hashes of (depth, digest).  Equal prefixes of
all conversations are one node; counts and the smallest member are
pre-aggregated sums and minima, so a prefix that a third of all conversations
share is a row a shard.

Totals.  Conversations are dealt into shards (those that may begin with the
same borrowed turns together).  A shard holds the nodes of its conversations,
one of all copies of a node carrying the node's own values.  Within a shard
the nodes are sorted externally by reverse level order; each passes its
subtree's totals to its parent through a priority queue that keeps at most
``QUEUE`` messages in memory and spills sorted runs, merged again when the
parents come by.  Then the totals go across shards: a node that lies in one
shard only is finished there, and for a node of several shards, above all
shard roots, the shards' totals are added up.

The member lists of nodes where conversations end are digested from a range
partitioning by (node, conv_id): tasks pack sorted runs of ids into pieces, and
one stream a node hashes the pieces in order.  One node's list and one
conversation's turns are each read by one task, as a sorted stream that spills.

Defined cases: null conv_ids take no part; null roles and texts are empty;
turns of equal number are ordered by the digest of role and text; repeated
turns stay turns of their own; conversations without turns end at the root; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapecode.llm.common import shuffle_width, written
from shapecode.session import ship_package

GROUP = 5                  # a conversation borrows from the first of its group of ids
BORROWED = 9               # modulus of the number of borrowed turns
SHARD_ROWS = 1 << 20       # turns of one shard, on average
QUEUE = 1 << 20            # messages of the priority queue in memory
PIECE = 4096               # conversation ids of one piece of a list

_KEY = ("depth", "x1", "x2")


# ------------------------------------------------------------------ conversations and prefixes

def _borrowed(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % BORROWED).cast("int")


def _base(conv: Column) -> Column:
    return conv - conv % GROUP


def numbered_turns(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, i, digest, bytes): the turns of every conversation from 1 on."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    slim = df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "digest")
    return slim.select("conv", F.row_number().over(order).alias("i"), "digest", "bytes")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv, depth, digest, bytes, length): every conversation's turns, the borrowed ones first; depth 0 is the root."""
    heads = (turns.where((F.col("conv") % GROUP == 0) & (F.col("i") < BORROWED)).groupBy(F.col("conv").alias("base"))
             .agg(F.array_sort(F.collect_list(F.struct("i", "digest", "bytes"))).alias("turns")))           # at most BORROWED - 1
    convs = turns.groupBy("conv").agg(F.max("i").alias("n")).withColumn("h", _borrowed(F.col("conv")))
    convs = (convs.withColumn("base", _base(F.col("conv"))).join(heads, "base", "left")
             .withColumn("head", F.slice(F.coalesce("turns", F.array().cast(heads.schema["turns"].dataType)), F.lit(1), F.col("h")))
             .withColumn("m", F.size("head"))
             .withColumn("length", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long"))
             .select("conv", "h", "m", "length", "head"))
    convs = written(convs, "conversations")
    root = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("bytes"), "length")
    borrowed = convs.select("conv", "length", F.posexplode("head").alias("pos", "t")).select(
        "conv", (F.col("pos") + 1).cast("long").alias("depth"), "t.digest", "t.bytes", "length")
    own = turns.join(convs.select("conv", "h", "m", "length"), "conv").where("i > h").select(
        "conv", (F.col("m") + F.col("i") - F.col("h")).cast("long").alias("depth"), "digest", "bytes", "length")
    return root.unionByName(borrowed).unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, x1, x2, p1, p2, bytes, length): a row for each conversation and prefix; p is the parent's x."""
    zero = F.lit(0).cast("long")
    rows = turns.withColumn("h1", F.when(F.col("depth") > 0, F.xxhash64("digest", "depth")).otherwise(zero)).withColumn(
        "h2", F.when(F.col("depth") > 0, F.xxhash64("depth", "digest")).otherwise(zero))
    run = Window.partitionBy("conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("x1", F.bit_xor("h1").over(run)).withColumn("x2", F.bit_xor("h2").over(run))
    return rows.select("conv", "depth", "x1", "x2", F.col("x1").bitwiseXOR(F.col("h1")).alias("p1"),
                       F.col("x2").bitwiseXOR(F.col("h2")).alias("p2"), "bytes", "length")


# ------------------------------------------------------------------ time-forward processing

class SpillingQueue:
    """Messages (x1, x2, values...) to the nodes of one level, taken out in key order.

    At most ``limit`` messages are kept in memory; beyond that they are sorted,
    those to one node are added up, and the run goes to an unnamed temporary
    file that vanishes with the process.
    """

    def __init__(self, values: int, limit: int = QUEUE):
        self.values, self.limit = values, limit
        self.fresh: list[np.ndarray] = []
        self.held, self.runs, self.spilled = 0, [], 0

    def _sorted(self, rows: np.ndarray) -> np.ndarray:
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
        out = rows[new].copy()
        out[:, 2:] = np.add.reduceat(rows[:, 2:], np.flatnonzero(new), axis=0) if len(rows) else out[:, 2:]
        return out

    def push(self, rows: np.ndarray) -> None:
        if len(rows):
            self.fresh.append(rows)
            self.held += len(rows)
            if self.held > self.limit:
                self._close_run(spill=True)

    def _close_run(self, spill: bool) -> None:
        if not self.held:
            return
        run = np.ascontiguousarray(self._sorted(np.concatenate(self.fresh)).T)        # a row a column: the keys lie together
        self.fresh, self.held = [], 0
        if spill:
            file = tempfile.TemporaryFile()
            run.tofile(file)
            file.flush()
            run = np.memmap(file, dtype=np.int64, mode="r", shape=run.shape)
            self.spilled += 1
        self.runs.append([run, 0])

    def opened(self) -> "SpillingQueue":
        """Ready to be taken from: nothing is pushed after this."""
        self._close_run(spill=False)
        return self

    def take(self, x1: int) -> np.ndarray:
        """All messages to nodes up to x1, added up by node."""
        out = []
        for r in self.runs:
            end = r[1] + int(np.searchsorted(r[0][0, r[1] :], x1, side="right"))
            out.append(np.asarray(r[0][:, r[1] : end]).T)
            r[1] = end
        got = np.concatenate(out) if out else np.zeros((0, 2 + self.values), dtype=np.int64)
        return self._sorted(got) if len(out) > 1 else got


def time_forward(batches, limit: int = QUEUE):
    """(depth, x1, x2, totals) of nodes that come by shard, level from the deepest, and key.

    Columns in: shard, depth, x1, x2, p1, p2, then the own values; the values
    of a node and of all below it in its shard come out.
    """
    now, after, level = None, None, None
    for cells in batches:
        shard, depth = cells[0], cells[1]
        values = cells[6:]
        cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (depth[1:] != depth[:-1])) + 1
        for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(depth)).tolist(), strict=True):
            if a == b:
                continue
            here = (int(shard[a]), int(depth[a]))
            if here != level:
                below = level is not None and here == (level[0], level[1] - 1)
                now = (after if below else SpillingQueue(len(values), limit)).opened()
                carry = np.zeros((0, 2 + len(values)), dtype=np.int64)
                after, level = SpillingQueue(len(values), limit), here
            x1, x2 = cells[2][a:b], cells[3][a:b]
            total = np.stack([v[a:b] for v in values], axis=1)
            got = np.concatenate([carry, now.take(int(x1[-1]))])
            at = np.searchsorted(x1, got[:, 0])
            while True:                                    # nodes of equal x1 lie side by side, in order of x2
                wrong = (at < len(x1)) & (x1[np.minimum(at, len(x1) - 1)] == got[:, 0]) & (x2[np.minimum(at, len(x1) - 1)] != got[:, 1])
                if not wrong.any():
                    break
                at[wrong] += 1
            here_now = (at < len(x1)) & (x1[np.minimum(at, len(x1) - 1)] == got[:, 0])
            carry = got[~here_now]
            np.add.at(total, at[here_now], got[here_now, 2:])
            if level[1] > 0:
                after.push(np.concatenate([cells[4][a:b, None], cells[5][a:b, None], total], axis=1))
            yield depth[a:b], x1, x2, total


def _totals(limit: int):
    def run(batches):
        import pyarrow as pa

        names = ["depth", "x1", "x2", "n_leaves", "saved_tokens"]
        cells = ([c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows)
        for depth, x1, x2, total in time_forward(cells, limit):
            yield pa.RecordBatch.from_arrays([pa.array(depth), pa.array(x1), pa.array(x2), *[pa.array(np.ascontiguousarray(total[:, k])) for k in range(2)]],
                                             names=names)
    return run


# ------------------------------------------------------------------ lists of members

def _runs(batches):
    """(node, ids as numpy array) of consecutive rows of one node, at most PIECE at a time."""
    for b in batches:
        if not b.num_rows:
            continue
        key = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        new = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])) + 1
        ids = b.column(3).to_numpy(zero_copy_only=False)
        for lo, hi in zip(np.append(0, new).tolist(), np.append(new, b.num_rows).tolist(), strict=True):
            node = tuple(int(k[lo]) for k in key)
            for a in range(lo, hi, PIECE):
                yield node, ids[a : min(hi, a + PIECE)]


def _pieces(batches):
    import pyarrow as pa

    rows: list[tuple] = []
    for node, ids in _runs(batches):
        rows.append((*node, int(ids[0]), ",".join(map(str, ids.tolist()))))
        if len(rows) >= 1000:
            yield _piece_batch(pa, rows)
            rows = []
    if rows:
        yield _piece_batch(pa, rows)


def _piece_batch(pa, rows):
    kinds = [pa.int64()] * 4 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[*_KEY, "first", "ids"])


def _digests(batches):
    """(node, sha-256 of its ids) from pieces sorted by node and first id; keeps one hash state."""
    import pyarrow as pa

    node, state = None, None
    for b in batches:
        out = []
        for row in zip(*[b.column(i).to_pylist() for i in (0, 1, 2, 4)], strict=True):
            if row[:3] != node:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = row[:3], hashlib.sha256()
            else:
                state.update(b",")
            state.update(row[3].encode())
        yield _digest_batch(pa, out)
    if node is not None:
        yield _digest_batch(pa, [(*node, state.hexdigest())])


def _digest_batch(pa, rows):
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[*_KEY, "ends_sha256"])


def ends_of(rows: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256) of the nodes at which some conversation ends."""
    ends = rows.where(F.col("depth") == F.col("length")).select(*_KEY, "conv")
    width = shuffle_width(rows.sparkSession)
    pieces = (ends.repartitionByRange(width, *_KEY, "conv").sortWithinPartitions(*_KEY, "conv")
              .mapInArrow(_pieces, "depth long, x1 long, x2 long, first long, ids string"))
    return (pieces.repartition(width, *_KEY).sortWithinPartitions(*_KEY, "first")
            .mapInArrow(_digests, "depth long, x1 long, x2 long, ends_sha256 string"))


# ------------------------------------------------------------------ the operator

def prefix_trie(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                shard_rows: int = SHARD_ROWS, queue: int = QUEUE) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): one row a node."""
    spark = df.sparkSession
    ship_package(spark)
    turns = written(numbered_turns(df, id_col, turn_col, role_col, text_col), "turns")
    rows = written(prefixes(rebuilt(turns)), "prefixes")
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(_base(F.col("conv"))), F.lit(shards)))
    local = dealt.groupBy("shard", *_KEY).agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("least"), F.bool_or(F.col("length") > F.col("depth")).alias("goes_on"),
                                              F.first("bytes").alias("bytes"), F.first("p1").alias("p1"), F.first("p2").alias("p2"))
    local = written(local, "shard-nodes")
    nodes = local.groupBy(*_KEY).agg(F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.bool_or("goes_on").alias("goes_on"),
                                     F.count(F.lit(1)).alias("copies"))
    copies = written(local.drop("goes_on").join(nodes, list(_KEY)), "node-copies")
    own = F.col("least") == F.col("conv_id")                # one copy of each node
    ordered = (copies.select("shard", "depth", "x1", "x2", "p1", "p2", (own & ~F.col("goes_on")).cast("long").alias("leaf"),
                             F.when(own, (F.col("n_convs") - 1) * F.col("bytes")).otherwise(F.lit(0)).cast("long").alias("saved"))
               .repartition(shuffle_width(spark), "shard").sortWithinPartitions("shard", F.desc("depth"), "x1", "x2"))
    totals = ordered.mapInArrow(_totals(queue), "depth long, x1 long, x2 long, n_leaves long, saved_tokens long")
    totals = totals.groupBy(*_KEY).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    first = copies.where(own)
    parents = copies.select("shard", F.col("x1").alias("p1"), F.col("x2").alias("p2"), (F.col("depth") + 1).alias("depth"),
                            F.col("conv_id").alias("parent_conv_id"))
    # children of a node in this shard, then over all shards
    children = (first.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2"))
                .agg(F.count(F.lit(1)).alias("n_children")))
    out = (first.join(parents, ["shard", "depth", "p1", "p2"], "left").join(totals, list(_KEY))
           .join(children, list(_KEY), "left").join(ends_of(rows), list(_KEY), "left"))
    return out.select("conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs",
                      F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
