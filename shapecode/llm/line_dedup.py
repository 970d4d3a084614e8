"""Removal of lines that many documents share, with two Bloom filters.

A text is split at ``\\n``; a line's key is the line without ASCII white space
at its ends and with A-Z in small letters.  Keys of at least ``least_chars``
code points that ``least_docs`` documents or more hold lose all their lines
except those of the document chosen to keep them (the largest id).

Texts are shuffled once into blocks of bounded size; the passes below read
that one exchange.  Hashes are dealt into slices.

1. Filters.  Every block lays its own keys over two Bloom filters of each
   slice, once-seen and twice-seen, and sends both in sparse form.  Block filters
   are merged by  once = A.once | B.once  and  twice = A.twice | B.twice |
   (A.once & B.once), so a key of two documents has all its places in the
   merged twice-filter, whatever the blocks are.  Each block gets back which of
   its places are set there.
2. Exact.  Only suspected repeats travel on: 128 bits of the key with the
   block's ``least_docs`` largest document ids.  Per slice they are grouped
   exactly; a key of enough documents is confirmed and its keeper chosen.
3. Removal.  Every block drops the lines of confirmed keys that another
   document keeps and joins the rest by ``\\n``.

No filter, key or document list reaches the driver and nothing is broadcast;
a line that a third of all documents hold is one row a block.  Filters
have 16 places for each key that a slice can hold, at any size of the input.

Defined cases: null and empty texts have one empty line; a document is a
doc_id: rows that repeat an id count once, and each of them keeps the line
if the id does; null ids are one document, smaller than all others; ties
cannot arise; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapecode.llm.common import hash_spans, mix64, shuffle_width, text_buffer, text_size
from shapecode.llm.substring_dedup import _bits, _ddl, _from_bits, _from_planes, _planes, _table
from shapecode.session import ship_package

LEAST_CHARS = 20
LEAST_DOCS = 3
BLOCK_CHARS = 2 << 20      # texts of one block, up to LARGEST_BLOCK for large inputs
LARGEST_BLOCK = 32 << 20
SLICE_KEYS = 1 << 18       # keys that a slice can hold, up to LARGEST_SLICE for large inputs
LARGEST_SLICE = 1 << 22
PLACES = 16                # filter places for each of them
SALTS = 16                 # blocks over which rows of equal id and text are dealt

_NULL_ID = np.iinfo(np.int64).min
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class BlockLines:
    """The lines of one block of documents; its distinct keys in slice order."""

    def __init__(self, rows, least_chars: int, slices: int):
        import pyarrow.compute as pc

        self.buf, self.off = buf, off = text_buffer(rows.column("text"))
        ids = pc.fill_null(rows.column("doc_id").cast("int64"), int(_NULL_ID)).to_numpy()
        breaks = np.flatnonzero(buf == 10)
        count = np.diff(np.searchsorted(breaks, off)) + 1
        self.first = np.concatenate([[0], np.cumsum(count)])          # number of the first line of each text
        n = int(self.first[-1])
        self.start, self.end = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        head, tail = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        head[self.first[:-1]] = True
        tail[self.first[1:] - 1] = True
        self.start[head], self.start[~head] = off[:-1], breaks + 1
        self.end[tail], self.end[~tail] = off[1:], breaks
        # keys: white space off both ends, long enough in code points
        solid = np.flatnonzero(~_SPACE[buf])
        lo, hi = np.searchsorted(solid, self.start), np.searchsorted(solid, self.end)
        filled = np.flatnonzero(hi > lo)
        a, b = solid[lo[filled]], solid[hi[filled] - 1] + 1
        points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        long = points[b] - points[a] >= least_chars
        self.line = filled[long]                                      # lines that have a key
        self.doc = np.repeat(ids, count)[self.line]
        h, g = hash_spans(_LOWER[buf], a[long], b[long], 2)
        part = (mix64(h ^ g) >> np.uint64(33)) % np.uint64(slices)
        order = np.lexsort((self.doc, g, h, part))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (h[order[1:]] != h[order[:-1]]) | (g[order[1:]] != g[order[:-1]])
        lead = order[new]
        self.h, self.g = h[lead], g[lead]                             # distinct keys
        self.which = np.empty(len(order), dtype=np.int64)
        self.which[order] = np.cumsum(new) - 1
        # (key, doc) pairs, distinct, documents rising
        own = np.ones(len(order), dtype=bool)
        own[1:] = new[1:] | (self.doc[order[1:]] != self.doc[order[:-1]])
        self.pair_key, self.pair_doc = self.which[order[own]], self.doc[order[own]]
        self.docs = np.bincount(self.pair_key, minlength=len(lead))
        part = part[lead].astype(np.int64)
        self.slices, self.begin = np.unique(part, return_index=True)
        self.stop = np.append(self.begin[1:], len(part))

    def places(self, a: int, b: int, bits: int):
        """(sorted places of the keys a..b, which are seen twice, the two places of every key as indexes into them)."""
        shift = np.uint64(64 - bits)
        both = np.concatenate([self.h[a:b] >> shift, self.g[a:b] >> shift]).astype(np.uint32)
        place, at = np.unique(both, return_inverse=True)
        seen = np.bincount(at, weights=np.tile(np.minimum(self.docs[a:b], 2), 2))
        return place, seen > 1, at.reshape(2, -1)


FILTERS = {"slice": "long", "block": "long", "n": "int", "places": "binary", "twice": "binary"}
SET = {"slice": "long", "block": "long", "n": "int", "bits": "binary"}
EXACT = {"slice": "long", "block": "long", "n": "int", "bits": "binary", "h": "binary", "g": "binary", "docs": "binary", "ids": "binary"}
FOUND = {"slice": "long", "block": "long", "n": "int", "bits": "binary", "keeper": "binary"}


def _filters(rows, least_chars, slices, bits):
    w = BlockLines(rows, least_chars, slices)
    block = rows.column("block")[0].as_py()
    out = []
    for s, a, b in zip(w.slices, w.begin, w.stop, strict=True):
        place, twice, _ = w.places(a, b, bits)
        out.append((int(s), block, len(place), _planes(np.diff(place, prepend=np.uint32(0))), _bits(twice)))
    return _table(FILTERS, out)


def _merge(rows, bits):
    """Merge the block filters of one slice; tell every block which of its places are in the twice-filter."""
    once, twice = np.zeros(1 << bits, dtype=bool), np.zeros(1 << bits, dtype=bool)
    cells = [rows.column(c) for c in FILTERS]
    read = lambda i: np.cumsum(_from_planes(cells[3][i].as_py(), np.uint32), dtype=np.uint32)
    for i in range(rows.num_rows):
        place = read(i)
        twice[place] |= once[place] | _from_bits(cells[4][i].as_py(), len(place))
        once[place] = True
    return _table(SET, [(cells[0][i].as_py(), cells[1][i].as_py(), cells[2][i].as_py(), _bits(twice[read(i)]))
                        for i in range(rows.num_rows)])


def _exact(rows, answers, least_chars, slices, bits, least_docs):
    """The suspected keys of a block (bits over its keys of the slice) with their largest document ids."""
    if rows.num_rows == 0:
        return _table(EXACT, [])
    w = BlockLines(rows, least_chars, slices)
    block = rows.column("block")[0].as_py()
    got = {r["slice"]: r for r in answers.select(["slice", "n", "bits"]).to_pylist()}
    first = np.searchsorted(w.pair_key, np.arange(len(w.h) + 1))
    out = []
    for s, a, b in zip(w.slices, w.begin, w.stop, strict=True):
        r = got[int(s)]
        suspect = _from_bits(r["bits"], r["n"])[w.places(a, b, bits)[2]].all(axis=0)
        keys = a + np.flatnonzero(suspect)
        if not len(keys):
            continue
        n = np.minimum(first[keys + 1] - first[keys], least_docs)     # the largest ids: the last pairs of a key
        at = np.repeat(first[keys + 1] - n - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out.append((int(s), block, int(b - a), _bits(suspect), _planes(w.h[keys]), _planes(w.g[keys]), _planes(n.astype(np.uint32)),
                    _planes(w.pair_doc[at])))
    return _table(EXACT, out)


def _confirm(rows, least_docs):
    """Group the suspected keys of one slice exactly; tell every block which are confirmed and who keeps them."""
    got = [dict(zip(EXACT, (rows.column(c)[i].as_py() for c in EXACT), strict=True)) for i in range(rows.num_rows)]
    h = np.concatenate([_from_planes(r["h"], np.uint64) for r in got])
    g = np.concatenate([_from_planes(r["g"], np.uint64) for r in got])
    n = np.concatenate([_from_planes(r["docs"], np.uint32) for r in got]).astype(np.int64)
    doc = np.concatenate([_from_planes(r["ids"], np.int64) for r in got])
    order = np.lexsort((g, h))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (g[order[1:]] != g[order[:-1]])
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    key = np.repeat(group, n)
    order = np.lexsort((doc, key))                                    # an id may stand in several blocks: count it once
    own = np.ones(len(order), dtype=bool)
    own[1:] = (key[order[1:]] != key[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
    docs = np.bincount(key[order[own]], minlength=int(new.sum()))
    keeper = np.full(len(docs), _NULL_ID, dtype=np.int64)
    np.maximum.at(keeper, key, doc)
    out, at = [], 0
    for r in got:
        suspect = _from_bits(r["bits"], r["n"])
        mine = group[at : at + int(suspect.sum())]
        at += len(mine)
        sure = docs[mine] >= least_docs
        suspect[suspect] = sure
        if sure.any():
            out.append((r["slice"], r["block"], r["n"], _bits(suspect), _planes(keeper[mine[sure]])))
    return _table(FOUND, out)


def _remove(rows, found, least_chars, slices, with_text):
    schema = {"doc_id": "long", "n_lines": "long", "n_dropped": "long", "kept_sha256": "string"} | (
        {"kept_text": "string"} if with_text else {})
    if rows.num_rows == 0:
        return _table(schema, [])
    w = BlockLines(rows, least_chars, slices)
    confirmed = np.zeros(len(w.h), dtype=bool)
    keeper = np.zeros(len(w.h), dtype=np.int64)
    begin = dict(zip(w.slices.tolist(), w.begin.tolist(), strict=True))
    for r in found.to_pylist():
        keys = begin[r["slice"]] + np.flatnonzero(_from_bits(r["bits"], r["n"]))
        confirmed[keys] = True
        keeper[keys] = _from_planes(r["keeper"], np.int64)
    drop = np.zeros(int(w.first[-1]), dtype=bool)
    drop[w.line] = confirmed[w.which] & (keeper[w.which] != w.doc)
    dropped = np.concatenate([[0], np.cumsum(drop)])
    ids, data, out = rows.column("doc_id").to_pylist(), w.buf.tobytes(), []
    for i, doc in enumerate(ids):
        a, b = int(w.first[i]), int(w.first[i + 1])
        gone = int(dropped[b] - dropped[a])
        if gone:
            kept = b"\n".join(data[x:y] for x, y, d in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), drop[a:b].tolist(), strict=True) if not d)
        else:
            kept = data[w.off[i] : w.off[i + 1]]
        row = (doc, b - a, gone, hashlib.sha256(kept).hexdigest())
        out.append((*row, kept.decode()) if with_text else row)
    return _table(schema, out)


def _sizes(chars: int, block_chars: int, slice_keys: int) -> tuple[int, int]:
    """Characters of a block and keys of a slice: both grow with the root of the input, so rows between them do not outnumber its lines."""
    root = int(chars**0.5)
    return max(block_chars, min(LARGEST_BLOCK, 128 * root)), max(slice_keys, min(LARGEST_SLICE, 16 * root))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS,
                        least_docs: int = LEAST_DOCS, with_text: bool = True, block_chars: int = BLOCK_CHARS,
                        slice_keys: int = SLICE_KEYS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256[, kept_text]) for every row of ``docs``."""
    spark = docs.sparkSession
    ship_package(spark)
    _rows, chars = text_size(docs, text_col)
    width = shuffle_width(spark)
    block_chars, slice_keys = _sizes(chars, block_chars, slice_keys)
    blocks = max(2 * width, -(-chars // block_chars))
    slices = max(1, -(-chars // (slice_keys * max(1, least_chars))))    # no slice can hold more than slice_keys keys on average
    bits = min(30, max(10, (PLACES * slice_keys - 1).bit_length()))
    parts = max(width, -(-chars // (16 << 20)))
    dealt = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                         F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))),
                                F.lit(blocks)).alias("block"))
             .repartition(parts, "block"))
    filters = dealt.groupBy("block").applyInArrow(lambda rows: _filters(rows, least_chars, slices, bits), _ddl(FILTERS))
    answers = filters.groupBy("slice").applyInArrow(lambda rows: _merge(rows, bits), _ddl(SET))
    exact = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        lambda rows, a: _exact(rows, a, least_chars, slices, bits, least_docs), _ddl(EXACT))
    found = exact.groupBy("slice").applyInArrow(lambda rows: _confirm(rows, least_docs), _ddl(FOUND))
    out = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        lambda rows, f: _remove(rows, f, least_chars, slices, with_text), out)
