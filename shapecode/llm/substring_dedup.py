"""Removal of repeated word windows, with a count-min prefilter.

A window is ``k`` consecutive words of one document.  A word goes when some
window over it starts earlier elsewhere, in (doc_id, position) order; what is
left is judged on the input, so the order of removal does not matter.

Texts are shuffled once into blocks (a hash of doc_id and text); every pass below reads
that same exchange.  Windows are dealt by hash into slices of about
``slice_windows`` windows.

1. Sketch.  Every block sketches its distinct windows for each slice: two
   count-min columns a window.  Per slice the block sketches are merged by
   adding the counters, and each block gets back one bit a window: is the
   smaller of its two merged counters above one?  Merged counters never fall
   short of a window's true count, so no repeated window is lost.
2. Exact.  Only windows with that bit set travel as hashes of 96 bits, once a
   block, with the block's first occurrence.  Per slice the first of all
   occurrences is found, and each block learns which of its windows hold it.
3. Removal.  Every block marks the words of all occurrences but the first.

No sketch, window or document list reaches the driver, nothing is broadcast,
and a window that a third of all documents share is one row a block.

Defined cases: null and empty texts have no words (the digest of the empty
string); texts shorter than k words keep all; rows that repeat a doc_id count
as one document at equal positions; null ids sort first and count as one
document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapecode.llm.common import hash_words, mix64, shuffle_width, text_buffer, text_size, whole_windows, window_hash
from shapecode.session import ship_package

K = 20
BLOCK_CHARS = 2 << 20
SLICE_WINDOWS = 1 << 20
COLUMN_BITS = 22           # counters of a sketch row: four for each window of a slice
LOW = 16                   # second row: within the 2**16 counters that the first column's high bits choose

_NULL_ID = np.iinfo(np.int64).min


class BlockWindows:
    """The windows of one block of documents, distinct and in slice order."""

    def __init__(self, rows, k: int, slices: int):
        import pyarrow.compute as pc

        buf, off = text_buffer(rows.column("text"))
        self.first, (h1, h2) = hash_words(buf, off, hashes=2)
        self.k = k
        self.ids = pc.fill_null(rows.column("doc_id").cast("int64"), int(_NULL_ID)).to_numpy()
        text, self.at = whole_windows(self.first, k)
        self.doc = self.ids[text]
        self.start = self.at - self.first[text]
        a, b = window_hash(h1, k), window_hash(h2, k, 0x9FB21C651E98DF25)
        self.a, self.b = (a[self.at], b[self.at]) if len(self.at) else (a[:0], b[:0])
        part = (mix64(self.a ^ self.b) >> np.uint64(33)) % np.uint64(slices)
        # distinct windows by slice, first column, hash; ties by place, so the first of a run is the first occurrence
        order = np.lexsort((self.start, self.doc, self.b, self.a, self.a >> np.uint64(64 - COLUMN_BITS), part))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (self.a[order[1:]] != self.a[order[:-1]]) | (self.b[order[1:]] != self.b[order[:-1]])
        self.lead = order[new]                       # first occurrence of every distinct window
        self.which = np.empty(len(order), dtype=np.int64)
        self.which[order] = np.cumsum(new) - 1       # distinct number of every window
        again = np.bincount(self.which, minlength=len(self.lead)) > 1 if len(order) else np.zeros(0, dtype=bool)
        # rows that repeat a document at the same place are one occurrence
        if again.any():
            same = (self.doc == self.doc[self.lead][self.which]) & (self.start == self.start[self.lead][self.which])
            again = np.bincount(self.which, weights=~same, minlength=len(self.lead)) > 0
        self.again = again
        part = part[self.lead].astype(np.int64)
        self.slices, self.begin = np.unique(part, return_index=True)
        self.end = np.append(self.begin[1:], len(part))

    def columns(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.a[self.lead], self.b[self.lead]
        return (a >> np.uint64(64 - COLUMN_BITS)).astype(np.uint32), (b & np.uint64((1 << LOW) - 1)).astype(np.uint16)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, plane by plane: high bytes that are all alike compress away in the shuffle."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _from_planes(data: bytes, dtype) -> np.ndarray:
    d = np.dtype(dtype)
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(d.itemsize, -1).T).view(d).ravel()


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _from_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n).astype(bool)


def _table(schema: dict, rows: list[tuple]):
    import pyarrow as pa

    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.table([pa.array([r[k] for r in rows], types[t]) for k, t in enumerate(schema.values())], names=list(schema))


def _ddl(schema: dict) -> str:
    return ", ".join(f"{n} {t}" for n, t in schema.items())


SKETCH = {"slice": "long", "block": "long", "n": "int", "cols": "binary", "lows": "binary", "again": "binary"}
MARKS = {"slice": "long", "block": "long", "n": "int", "bits": "binary"}
EXACT = {"slice": "long", "block": "long", "n": "int", "bits": "binary", "again": "binary", "a": "binary", "b": "binary",
         "doc": "binary", "start": "binary"}
FOUND = {"slice": "long", "block": "long", "n": "int", "bits": "binary", "mine": "binary"}


def _sketch(rows, k, slices):
    w = BlockWindows(rows, k, slices)
    block = rows.column("block")[0].as_py()
    col, low = w.columns()
    out = []
    for s, a, b in zip(w.slices, w.begin, w.end, strict=True):
        step = np.diff(col[a:b], prepend=np.uint32(0))
        out.append((int(s), block, int(b - a), _planes(step), _planes(low[a:b]), _bits(w.again[a:b])))
    return _table(SKETCH, out)


def _merge(rows):
    """Add the block sketches of one slice; answer every window with its estimate's bit."""
    one, two = np.zeros(1 << COLUMN_BITS, dtype=np.uint8), np.zeros(1 << COLUMN_BITS, dtype=np.uint8)

    def read(r):
        col = np.cumsum(_from_planes(r["cols"], np.uint32), dtype=np.uint32)
        low = _from_planes(r["lows"], np.uint16)
        return col, ((col >> np.uint32(LOW)) << np.uint32(LOW)) | low

    cells = [rows.column(c) for c in ("slice", "block", "n", "cols", "lows", "again")]
    row = lambda i: {n: c[i].as_py() for n, c in zip(("slice", "block", "n", "cols", "lows", "again"), cells, strict=True)}
    for i in range(rows.num_rows):
        r = row(i)
        count = _from_bits(r["again"], r["n"]).astype(np.uint8) + np.uint8(1)
        for grid, c in zip((one, two), read(r), strict=True):
            np.add.at(grid, c, count)
            grid[c] = np.minimum(grid[c], 2)         # two is enough; keeps a byte from running over
    out = []
    for i in range(rows.num_rows):
        r = row(i)
        c1, c2 = read(r)
        out.append((r["slice"], r["block"], r["n"], _bits(np.minimum(one[c1], two[c2]) > 1)))
    return _table(MARKS, out)


def _exact(rows, marks, k, slices):
    if rows.num_rows == 0:
        return _table(EXACT, [])
    w = BlockWindows(rows, k, slices)
    block = rows.column("block")[0].as_py()
    bits = {r["slice"]: r for r in marks.select(["slice", "n", "bits"]).to_pylist()}
    out = []
    for s, a, b in zip(w.slices, w.begin, w.end, strict=True):
        r = bits[int(s)]
        hot = _from_bits(r["bits"], r["n"])
        lead = w.lead[a:b][hot]
        if len(lead):
            out.append((int(s), block, int(b - a), r["bits"], _bits(w.again[a:b][hot]), _planes(w.a[lead]),
                        _planes((w.b[lead] >> np.uint64(32)).astype(np.uint32)), _planes(w.doc[lead]),
                        _planes(w.start[lead].astype(np.uint64))))
    return _table(EXACT, out)


def _first(rows):
    """Group the estimated-repeated windows of one slice exactly; tell every block which first occurrences it holds."""
    names = ("slice", "block", "n", "bits", "again", "a", "b", "doc", "start")
    got = [dict(zip(names, (rows.column(c)[i].as_py() for c in names), strict=True)) for i in range(rows.num_rows)]
    a = np.concatenate([_from_planes(r["a"], np.uint64) for r in got])
    b = np.concatenate([_from_planes(r["b"], np.uint32) for r in got])
    doc = np.concatenate([_from_planes(r["doc"], np.int64) for r in got])
    start = np.concatenate([_from_planes(r["start"], np.uint64) for r in got])
    order = np.lexsort((start, doc, b, a))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    lead = order[new]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    mine = (doc == doc[lead][group]) & (start == start[lead][group])
    out, at = [], 0
    for r in got:
        n = len(r["b"]) // 4
        out.append((r["slice"], r["block"], r["n"], r["bits"], _bits(mine[at : at + n])))
        at += n
    return _table(FOUND, out)


def _remove(rows, found, k, slices, with_text):
    schema = {"doc_id": "long", "n_words": "long", "n_removed": "long", "kept_sha256": "string"} | (
        {"kept_text": "string"} if with_text else {})
    if rows.num_rows == 0:
        return _table(schema, [])
    w = BlockWindows(rows, k, slices)
    answers = {r["slice"]: r for r in found.select(["slice", "n", "bits", "mine"]).to_pylist()}
    hot = np.zeros(len(w.lead), dtype=bool)
    mine = np.ones(len(w.lead), dtype=bool)
    for s, a, b in zip(w.slices, w.begin, w.end, strict=True):
        if r := answers.get(int(s)):
            bits = _from_bits(r["bits"], r["n"])
            hot[a:b] = bits
            mine[a:b][bits] = _from_bits(r["mine"], int(bits.sum()))
    lead = w.lead[w.which]
    own = mine[w.which] & (w.doc == w.doc[lead]) & (w.start == w.start[lead])
    gone = w.at[hot[w.which] & ~own]
    cover = np.zeros(int(w.first[-1]) + 1, dtype=np.int64)
    np.add.at(cover, gone, 1)
    np.add.at(cover, np.minimum(gone + k, len(cover) - 1), -1)
    removed = np.cumsum(cover)[:-1] > 0
    out = []
    ids, texts = rows.column("doc_id"), rows.column("text")
    for i in range(rows.num_rows):
        drop = removed[w.first[i] : w.first[i + 1]]
        words = (texts[i].as_py() or "").encode().split()
        if drop.any():
            words = [x for x, d in zip(words, drop.tolist(), strict=True) if not d]
        kept = b" ".join(words)
        row = (ids[i].as_py(), len(drop), int(drop.sum()), hashlib.sha256(kept).hexdigest())
        out.append((*row, kept.decode()) if with_text else row)
    return _table(schema, out)


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                            with_text: bool = True, block_chars: int = BLOCK_CHARS,
                            slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) for every row of ``docs``."""
    spark = docs.sparkSession
    ship_package(spark)
    _rows, chars = text_size(docs, text_col)
    width = shuffle_width(spark)
    blocks = max(2 * width, -(-chars // block_chars))
    slices = max(width, -(-chars // (6 * slice_windows)))     # about six characters a word
    parts = max(width, -(-chars // (16 << 20)))
    dealt = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                         F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(blocks)).alias("block"))
             .repartition(parts, "block"))
    sketches = dealt.groupBy("block").applyInArrow(lambda rows: _sketch(rows, k, slices), _ddl(SKETCH))
    marks = sketches.groupBy("slice").applyInArrow(_merge, _ddl(MARKS))
    exact = dealt.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(
        lambda rows, m: _exact(rows, m, k, slices), _ddl(EXACT))
    found = exact.groupBy("slice").applyInArrow(_first, _ddl(FOUND))
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        lambda rows, f: _remove(rows, f, k, slices, with_text), out)
