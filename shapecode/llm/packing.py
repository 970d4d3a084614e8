"""Packing into fixed windows by minimum bin slack.

A text of n ids becomes floor(n / size) full pieces and one remainder; only
remainders need packing.  Remainders are grouped by a hash of their key into
groups of bounded size.  In a group the counts of equal lengths form a
multiset, and each sequence is built by minimum bin slack: the longest
remaining length opens it, then a bitset subset-sum dynamic programme over
the remaining (length, count) pairs finds the multiset that fills the rest
closest to capacity, and walking the stored bitsets backwards gives how many
of each length it takes.

Tokenising runs once per text and over the whole text.

Defined cases: a null or empty text has only the end id; repeated rows are
packed as separate documents; an empty table gives an empty result; a text of
any length is cut, never truncated.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapecode.llm.common import written
from shapecode.session import ship_package

SIZE = 2048
END_ID = 1
GROUP_ROWS = 8192          # remainders packed together, on average

# Two white-space characters in a row: only then does the pre-tokenizer's lookahead matter.
_RUN = re.compile(r"\s\s")


class Encoder:
    """Little-endian uint32 ids of a text under a byte-level BPE of the ``tokenizers`` JSON format.

    The vocabulary is read from the JSON file; the merging itself is done by
    tiktoken's core on the same ranks, several times faster than building
    ``tokenizers`` encodings with offsets (tests compare the ids).  Texts
    without runs of white space take the pre-tokenizer pattern without its
    lookahead, which cannot match there and makes the matching backtrack.
    """

    _own: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.full = tiktoken.Encoding("full", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.plain = tiktoken.Encoding("plain", pat_str=PATTERN.replace(LOOKAHEAD, ""), mergeable_ranks=ranks, special_tokens=special)
        self.marker = re.compile("|".join(re.escape(t) for t in sorted(special, key=len, reverse=True))) if special else None

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def encode(self, text: str) -> bytes:
        coder = self.full if _RUN.search(text) else self.plain
        # the markers of the file, as its library reads them, are one id each
        ids = coder.encode(text, allowed_special="all") if self.marker and self.marker.search(text) else coder.encode_ordinary(text)
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()


# The pre-tokenizer of byte-level BPE.
LOOKAHEAD = r"\s+(?!\S)|"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|" + LOOKAHEAD + r"\s+"


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def pieces_of(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
              size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, doc_key, start, length, ids_crc32, doc_tokens): the full pieces and the remainder of every text."""
    ship_package(docs.sparkSession)
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches):
        import pyarrow as pa

        coder = Encoder.of(tokenizer_path)
        for b in batches:
            doc, key, start, length, crc, total = [], [], [], [], [], []
            for d, k, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(1), strict=True):
                ids = coder.encode(t.as_py() or "") + end
                n = len(ids) // 4
                for a in range(0, n, size):
                    doc.append(d)
                    key.append(k)
                    start.append(a)
                    length.append(min(size, n - a))
                    crc.append(zlib.crc32(ids[4 * a : 4 * (a + size)]))
                    total.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, b.schema.field(0).type), pa.array(key, pa.int64()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64())],
                names=["doc_id", "doc_key", "start", "length", "ids_crc32", "doc_tokens"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.monotonically_increasing_id().alias("doc_key"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(cut, f"doc_id {kind}, doc_key long, start long, length long, ids_crc32 long, doc_tokens long")


def fill_windows(lengths: list[int], size: int = SIZE) -> list[dict[int, int]]:
    """Minimum bin slack over a multiset of lengths below ``size``: one {length: count} per sequence."""
    count = np.bincount(np.asarray(lengths, dtype=np.int64), minlength=size + 1).tolist() if lengths else [0] * (size + 1)
    left = sorted({n for n in lengths}, reverse=True)
    out = []
    while left:
        top = left[0]
        count[top] -= 1
        take = {top: 1}
        room = size - top
        if room:
            for n, c in _closest(left, count, room).items():
                count[n] -= c
                take[n] = take.get(n, 0) + c
        out.append(take)
        left = [n for n in left if count[n]] if any(not count[n] for n in take) else left
    return out


def _closest(left: list[int], count: list[int], room: int) -> dict[int, int]:
    """The multiset of remaining lengths whose sum is the largest that is not above ``room``."""
    keep = (1 << (room + 1)) - 1
    goal = 1 << room
    reach, steps = 1, []
    for n in left:
        if n > room or not count[n]:
            continue
        before = reach
        # binary splitting of the count: 1, 2, 4, ... copies of the length
        c, power = min(count[n], room // n), 1
        while c:
            p = min(power, c)
            reach |= (reach << (n * p)) & keep
            c -= p
            power *= 2
        steps.append((n, before))
        if reach & goal:
            break
    best = reach.bit_length() - 1
    take = {}
    for n, before in reversed(steps):
        c = 0
        while not (before >> best) & 1:
            best -= n
            c += 1
        if c:
            take[n] = c
    return take


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         size: int = SIZE, end_id: int = END_ID, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Every piece with its sequence_id and offset; sequences hold at most ``size`` ids.

    Sequence ids: full pieces use their (negative) own number, packed ones
    group * 2**32 + sequence.
    """
    spark = docs.sparkSession
    pieces = written(pieces_of(docs, tokenizer_path, id_col, text_col, size, end_id), "pieces")
    kind = pieces.schema["doc_id"].dataType.simpleString()
    rest = pieces.where(F.col("length") < size)
    groups = max(1, -(-rest.count() // group_rows))
    full = (pieces.where(F.col("length") == size)
            .withColumn("sequence_id", -F.lit(1) - F.monotonically_increasing_id())
            .withColumn("offset", F.lit(0).cast("long")))

    def fill(key, rows):
        import pyarrow as pa

        lengths = rows.column("length").to_numpy()
        order = np.lexsort((rows.column("start").to_numpy(), rows.column("doc_key").to_numpy(), lengths))
        at = np.searchsorted(lengths[order], np.arange(size + 1))
        sequence, offset = np.empty(len(order), dtype=np.int64), np.empty(len(order), dtype=np.int64)
        for s, take in enumerate(fill_windows(lengths.tolist(), size)):
            here = 0
            for n in sorted(take, reverse=True):
                for _ in range(take[n]):
                    row = order[at[n]]
                    at[n] += 1
                    sequence[row], offset[row] = (key[0].as_py() << 32) + s, here
                    here += n
        return (rows.drop_columns(["_group"]).append_column("sequence_id", pa.array(sequence))
                .append_column("offset", pa.array(offset)))

    packed = (rest.withColumn("_group", F.pmod(F.xxhash64("doc_key", "start"), F.lit(groups)))
              .groupBy("_group").applyInArrow(
                  fill, f"doc_id {kind}, doc_key long, start long, length long, ids_crc32 long, doc_tokens long, "
                        "sequence_id long, offset long"))
    return full.unionByName(packed).drop("doc_key")


def packed_texts(pieces: DataFrame) -> DataFrame:
    """One row per sequence: its pieces in order and the padded length.

    A sequence is padded to ``SIZE`` unless its length is a power of two.
    """
    n = F.sum("length")
    return (pieces.groupBy("sequence_id")
            .agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length"))).alias("pieces"),
                 n.alias("n_tokens"))
            .withColumn("padded", F.when(F.expr("n_tokens & (n_tokens - 1)") == 0, F.col("n_tokens")).otherwise(SIZE)))
