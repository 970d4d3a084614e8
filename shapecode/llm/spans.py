"""Spans of regular-expression matches as Spark columns (no Python on the executors).

Spark has no function that returns the places of all matches.  ``split`` and
``regexp_extract_all`` walk the same leftmost non-overlapping matches, so the
lengths of the gaps and of the matches give every place, in code points.

Patterns for the executors avoid repeated groups that Java matches by
recursion (a possessive repeat is a loop) and guard runs by what stands
before them, so a very long run is read once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT = 40               # code points kept from the gap before a match

MATCH_TYPE = "struct<start:int,end:int,hit:string,part:string,before:string>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body reads it, inner functions included."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_CHUNK = 6                 # running values are taken in chunks of 2**6 elements, and chunks of chunks
_PIECE = 10                # texts are cut in pieces of 2**10 code points


def running(values: Column, op, depth: int = 3) -> Column:
    """array<int>: ``op`` (a sum or a maximum) of 0 and all values before each element.

    Values are folded in chunks, these in chunks again, so the cost of an
    element does not grow with the array and no array grows in an accumulator.
    """
    size, mask = 1 << _CHUNK, (1 << _CHUNK) - 1
    fold = lambda part: F.aggregate(part, F.lit(0), op)
    within = lambda v, i: fold(F.slice(v, i - i.bitwiseAND(mask) + 1, i.bitwiseAND(mask)))

    def chunks(v):
        return F.transform(F.sequence(F.lit(0), F.shiftright(F.size(v) - 1, _CHUNK)), lambda c: fold(F.slice(v, F.shiftleft(c, _CHUNK) + 1, size)))

    def before(v, depth):
        if not depth:
            return F.transform(v, lambda x, i: fold(F.slice(v, F.lit(1), i)))
        whole = lambda o: F.transform(v, lambda x, i: op(F.get(o, F.shiftright(i, _CHUNK)), within(v, i)))
        return F.when(F.size(v) <= size, F.transform(v, lambda x, i: within(v, i))).otherwise(let(let(chunks(v), lambda c: before(c, depth - 1)), whole))
    return let(values, lambda v: before(v, depth))


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def running_max(values: Column) -> Column:
    return running(values, lambda a, b: F.greatest(a, b))


def count_below(ordered: Column, limit: Column) -> Column:
    """How many numbers of a rising array are below ``limit``, by halving."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(ordered) + 1)).cast("int"))

    def halve(acc, _):
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        low = F.get(ordered, mid) < limit
        return F.when(acc["lo"] >= acc["hi"], acc).otherwise(F.struct(F.when(low, mid + 1).otherwise(acc["lo"]).alias("lo"),
                                                                      F.when(low, acc["hi"]).otherwise(mid).alias("hi")))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(ordered).alias("hi")), halve, lambda acc: acc["lo"])


def ends_of(spans: Column) -> Column:
    """The starts and ends of spans as two arrays, to be bound before :func:`touches` reads them."""
    return F.struct(F.transform(spans, lambda s: s["start"]).alias("starts"), F.transform(spans, lambda s: s["end"]).alias("ends"))


def touches(span: Column, ends: Column) -> Column:
    """Whether a span overlaps one of the spans of ``ends_of``, whose starts rise and which lie apart."""
    last = lambda n: F.coalesce((n > 0) & (F.get(ends["ends"], n - 1) > span["start"]), F.lit(False))
    return let(count_below(ends["starts"], span["end"]), last)


def pieces(text: Column) -> Column:
    """The text in pieces of 2**_PIECE code points, for :func:`cut` (a substring would read a text from its start)."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << _PIECE}}}"), F.lit(0))


def cut(of: Column, a: Column, b: Column) -> Column:
    """Code points a..b of the text whose pieces are ``of``."""
    mask, first, last = (1 << _PIECE) - 1, F.shiftright(a, _PIECE), F.shiftright(b - 1, _PIECE)
    within = F.substring(F.get(of, first), a.bitwiseAND(mask) + 1, b - a)
    across = F.concat(F.substring(F.get(of, first), a.bitwiseAND(mask) + 1, F.lit(1 << _PIECE)),
                      F.array_join(F.slice(of, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
                      F.substring(F.get(of, last), F.lit(1), (b - 1).bitwiseAND(mask) + 1))
    return F.when(a >= b, F.lit("")).when(first == last, within).otherwise(across)


def matches(text: Column, pattern: str, group: int = 0, when: Column | None = None) -> Column:
    """array<struct<start, end, hit, part, before>> of all matches; ``part`` is the given group.

    ``when`` skips the search where a necessary condition fails.  The cost is
    linear in the text and in the number of matches.
    """
    lit = F.lit(pattern)
    found = F.struct(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, lit, F.lit(0)).alias("hit"),
                     F.regexp_extract_all(text, lit, F.lit(group)).alias("part"))

    def placed(z):
        long = F.transform(z["hit"], lambda h, i: F.length(h) + F.length(F.get(z["gap"], i)))
        return let(running_sum(long), lambda before: F.transform(z["hit"], lambda h, i: let(
            F.get(before, i) + F.length(F.get(z["gap"], i)), lambda start: F.struct(
                start.alias("start"), (start + F.length(h)).alias("end"), h.alias("hit"), F.get(z["part"], i).alias("part"),
                F.right(F.get(z["gap"], i), F.lit(CONTEXT)).alias("before")))))
    every = let(found, placed)
    return every if when is None else F.when(when, every).otherwise(F.array().cast(f"array<{MATCH_TYPE}>"))


def tagged(found: Column, kind: str, rank: int) -> Column:
    """array<struct<start, rank, kind, end>> for sorting and printing."""
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"),
                                                 F.lit(kind).alias("kind"), m["end"].alias("end")))


def printed(spans: Column) -> Column:
    """``kind:start:end`` by start, then rank, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
