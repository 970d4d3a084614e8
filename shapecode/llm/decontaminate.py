"""Benchmark decontamination by template canonicalisation.

Texts are cut at ASCII white space.  In a canonical text numbers become
``<num>``, a unit after a number ``<unit>``, a capitalised word inside a
sentence ``<name>``; other words lose outer punctuation and capitals.  A folded
text has the same without names and units, so that a copy in other capitals
matches with other numbers (not with other names or units).  Every window of ``k`` canonical words of a document is hashed and joined with the
benchmark's windows, so a question whose numbers, names and units were
replaced still matches.  Matches are gathered by (document, item, diagonal)
with their words; these are compared again, and a window needs
``LITERAL_SHARE`` ordinary words to count.  Windows without a gap between them
form a run.  A stretch leaks if it holds a window of the item's own words, a
run whose names are filled consistently (one name of the item always became
the same name in the document), or 2 k words so filled of a longer run.  Words
between the runs are not judged.  Equal numbers or units may stand for two
things, so each may become another value in each place.

A window is hashed only where all its neighbouring words are neighbours in some
item by a bitmap of bounded size, which never denies a true pair, so most
texts are read once, hashed word by word and dropped.

DataFrame functions only.  The benchmark's windows are broadcast up to a
checked number of rows and shuffled beyond it.

Windows with fewer ordinary words and items of fewer than ``SHORTEST`` words
are joined on their own words (without capitals and outer punctuation), so
verbatim copies of them are found as well.

Defined cases: null and empty texts match nothing; items of fewer than k words
are compared as a whole; rows that repeat are reported alike; null ids are kept; an empty table
or benchmark gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapecode.functions.arrays import fence
from shapecode.llm.common import written
from shapecode.llm.spans import let

K = 10
SHORTEST = 5
LITERAL_SHARE = 0.5
BROADCAST_WINDOWS = 200_000

# Words that are units after a number.
UNITS = ("km", "m", "cm", "mm", "miles", "mile", "feet", "foot", "ft", "inches", "inch", "in", "kg", "g", "mg", "pounds",
         "lb", "lbs", "oz", "tons", "liters", "litres", "l", "ml", "hours", "hour", "hrs", "h", "minutes", "minute", "min",
         "seconds", "second", "s", "days", "day", "weeks", "week", "months", "month", "years", "year", "dollars", "dollar",
         "cents", "euros", "euro", "percent", "degrees", "volts", "watts", "mph", "kmh")

# White space apart from a lone space; the look-aheads in front only make the search cheap.
_SPACES = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
_NUMBER = r"[0-9]+(?:[.,:/][0-9]+)*"
_NAME = r"(?=\p{Lu})(?<=[\p{L}\p{N},;:][\x20])\p{Lu}[\p{L}\p{M}'-]*"
_OUTER = (r"(?![A-Za-z0-9\x20])(?=[^\p{L}\p{N}<>\s])"
          r"(?:(?<![^\s])[^\p{L}\p{N}<>\s]+(?=[\p{L}\p{N}<])|(?<=[\p{L}\p{N}>])[^\p{L}\p{N}<>\s]+(?![^\s]))")


def _marked(text: Column) -> Column:
    """Folded text, white space in single spaces, numbers replaced, ``<name>`` set before names."""
    c = F.regexp_replace(F.regexp_replace(text, _SPACES, " "), r"[<>]", "_")
    c = F.regexp_replace(c, _NAME, "<name>$0")
    c = F.regexp_replace(c, _NUMBER, "<num>")
    return F.lower(F.upper(F.regexp_replace(c, _OUTER, "")))


def _templates(marked: Column) -> Column:
    c = F.regexp_replace(marked, r"<name>[\p{L}\p{M}'-]*", "<name>")
    return F.regexp_replace(c, rf"(?<=<num>[\x20])(?:{'|'.join(UNITS)})(?![^\s])", "<unit>")


def _folded(marked: Column) -> Column:
    return F.replace(marked, F.lit("<name>"), F.lit(""))


def canonical(text: Column) -> Column:
    """Canonical text; its words line up with the text's."""
    return _templates(_marked(text))


def words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(text, _SPACES, " ")), "[ ]")


def plain(text: Column) -> Column:
    """Text without capitals and outer punctuation; its words line up with the text's."""
    return F.lower(F.upper(F.regexp_replace(F.regexp_replace(text, r"[<>]", "_"), _OUTER, "")))


# ------------------------------------------------------------------ windows

def _hashes(found: Column) -> Column:
    return F.transform(found, lambda w: F.xxhash64(w))


def _window(head: Column, tail: Column, at: Column, n: int) -> Column:
    """Hash of the window of ``n`` word hashes at ``at``: the first of ``head``, the others of ``tail``."""
    return F.xxhash64(F.get(head, at), F.slice(tail, at + 2, n - 1)) if n > 1 else F.xxhash64(F.get(head, at))


def _starts(h: Column, n: int) -> Column:
    return F.when(F.size(h) >= n, F.sequence(F.lit(0), F.size(h) - n)).otherwise(F.array().cast("array<int>"))


def _slots(of: Column, table_size: int) -> Column:
    return of.bitwiseAND(F.lit(table_size - 1).cast("long")).cast("int")


def _pair(h: Column, x: Column, i: Column) -> Column:
    return x.bitwiseXOR(F.shiftright(F.coalesce(F.get(h, i + F.lit(1)), F.lit(0).cast("long")), 7))


def _known(h: Column, filled: Column, table_size: int) -> Column:
    """Per word: whether it and the next one may be neighbours in a benchmark item (never false for a true pair)."""
    return F.transform(h, lambda x, i: F.get(filled, _slots(_pair(h, x, i), table_size)))


def _may_match(known: Column, first: int, n: int):
    """Whether the neighbours of a window, from its word ``first`` on, are all known."""
    return lambda s: reduce(lambda a, b: a & b, [F.get(known, s + j) for j in range(first, n - 1)], F.lit(True))


def _found_windows(text: Column, filled: Column, table_size: int, templates: list[int], verbatim: list[int]) -> Column:
    """array<struct<form, n, pos, h>>: the windows of a text that may be a benchmark's.

    A template window is one of canonical words or, where they differ, of
    folded words; what stands before a passage may make its first word look
    like a name or a unit, so the first word may be folded alone.  Each array
    is bound once (``let``) and every step is linear in the words.
    """
    none = F.array().cast("array<struct<form:int,n:int,pos:int,h:bigint>>")
    kind = lambda form, n, s, h: F.struct(F.lit(form).alias("form"), F.lit(n).alias("n"), s.alias("pos"), h.alias("h"))

    def of_templates(filled, a):
        c, f = a["c"], a["f"]

        def of_length(known, n):
            near = lambda k: F.filter(_starts(c, n), _may_match(k, 1, n))
            other_tail = lambda s: F.slice(c, s + 2, n - 1) != F.slice(f, s + 2, n - 1)
            folded = F.concat(F.transform(F.filter(near(known["c"]), lambda s: F.get(c, s) != F.get(f, s)), lambda s: kind(0, n, s, _window(f, c, s, n))),
                              F.transform(F.filter(near(known["f"]), other_tail), lambda s: kind(0, n, s, _window(f, f, s, n))))
            return [F.transform(near(known["c"]), lambda s: kind(0, n, s, _window(c, c, s, n))), F.coalesce(folded, none)]
        return let(F.struct(_known(c, filled, table_size).alias("c"), _known(f, filled, table_size).alias("f")),
                   lambda known: F.concat(*[x for n in templates for x in of_length(known, n)]))

    def of_verbatim(filled, p):
        def of_length(known, n):
            own = _may_match(known, 0, n) if n > 1 else lambda s: F.get(filled, _slots(F.get(p, s), table_size))
            return F.transform(F.filter(_starts(p, n), own), lambda s: kind(1, n, s, _window(p, p, s, n)))
        return let(_known(p, filled, table_size), lambda known: F.concat(*[of_length(known, n) for n in verbatim]))

    def both(filled):
        out = []
        if templates:
            split = lambda t: _hashes(F.split(F.trim(t), "[ ]"))
            forms = let(_marked(text), lambda m: F.struct(_templates(m).alias("c"), _folded(m).alias("f")))
            # a text without names and units has one form (f is null)
            hashed = let(forms, lambda t: F.struct(split(t["c"]).alias("c"), F.when(t["c"] != t["f"], split(t["f"])).alias("f")))
            out.append(let(hashed, lambda a: of_templates(filled, a)))
        if verbatim:
            out.append(let(_hashes(words(plain(text))), lambda p: of_verbatim(filled, p)))
        return F.concat(*out) if len(out) > 1 else out[0]
    return let(filled, both)


def _filled_slots(item: DataFrame, table_size: int) -> Column:
    """The filter: one boolean a slot, set for every word and pair of neighbours of an item in any form."""
    slots = None
    for c in ("canon", "fold", "plain"):
        of = item.select(F.explode(let(_hashes(F.col(c)), lambda h: F.concat(h, F.transform(h, lambda x, i: _pair(h, x, i))))).alias("x"))
        slots = of if slots is None else slots.unionByName(of)
    slots = slots.select(_slots(F.col("x"), table_size).alias("slot")).distinct().withColumn("set", F.lit(True))
    every = item.sparkSession.range(table_size).select(F.col("id").cast("int").alias("slot")).join(slots, "slot", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("set", F.lit(False)).alias("set")))), lambda x: x["set"])
                     .alias("filled")).scalar()


def _forms(text: Column) -> Column:
    """The words as templates (``canon``), with numbers only replaced (``fold``) and as they stand (``plain``)."""
    return let(_marked(text), lambda m: F.struct(words(_templates(m)).alias("canon"), words(_folded(m)).alias("fold"), words(plain(text)).alias("plain")))


def _canon_rows(df: DataFrame, text_col: str, **keep: Column) -> DataFrame:
    """Rows with the text and its forms."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (df.select(*[c.alias(n) for n, c in keep.items()], text.alias("text"))
            .select(*keep, "text", _forms(F.col("text")).alias("forms")).select(*keep, "text", "forms.*"))


def _laid_out() -> Column:
    """The windows of a diagonal as one row of word pairs; between windows stand pairs of nulls, which equal nothing."""
    k, shift = F.col("k"), F.col("shift")
    words_of = ("canon", "dc", "ic"), ("fold", "df", "if"), ("plain", "dr", "ir")
    pair = ", ".join(f"{name}:string" for _, d, i in words_of for name in (d, i))
    gap = F.lit(None).cast(f"struct<{pair}>")

    def part(ws, w, j):
        step = F.coalesce(F.get(ws, j + 1)["pos"] - w["pos"], k)
        n = F.least(step, k)
        zipped = F.arrays_zip(*[x for form, d, i in words_of for x in (
            F.slice(w[form], F.lit(1), n).alias(d), F.slice(F.col(i), w["pos"] - shift + 1, n).alias(i))])
        return F.concat(zipped, F.array_repeat(gap, F.greatest(step - k, F.lit(0)).cast("int")))
    return F.flatten(let(F.col("windows"), lambda ws: F.transform(ws, lambda w, j: part(ws, w, j))))


def row_key(id_col: Column, text: Column) -> Column:
    """128 bits of the text and the id: rows of equal key are equal in both."""
    return F.struct(id_col.alias("id"), F.md5(F.encode(text, "UTF-8")).alias("digest"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_id_col: str = "item_id", item_text_col: str = "text", k: int = K) -> DataFrame:
    """(key, doc_id, item_id, n_words, verbatim): one row for each row of ``docs`` and item that it leaks.

    ``key`` (id and digest of the text) identifies the row; n_words are
    the matching words of the longest stretch; verbatim: every placeholder
    holds the item's own value.
    """
    base = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    item = _canon_rows(benchmark, item_text_col, item_id=F.col(item_id_col))
    item = (item.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("raw", words(F.col("text"))).drop("text")
            .dropDuplicates(["item_id", "raw"]))
    item = written(item.withColumn("item_key", F.struct(F.col("item_id").alias("id"), F.md5(F.array_join("raw", " ")).alias("digest"))),
                   "benchmark-items")
    sizes = item.agg(F.collect_set(F.least(F.size("canon"), F.lit(k))), F.sum(F.size("canon"))).first()
    lengths = sorted(int(n) for n in sizes[0])          # k, and the lengths below it of shorter items
    asked, used = None, {0: [], 1: []}
    for n in lengths:
        own = item.where(F.size("canon") >= n) if n == k else item.where(F.size("canon") == n)
        ordinary = lambda c, n=n: F.size(F.filter(F.slice(c, F.col("pos") + 1, n), lambda w: ~w.startswith("<"))) >= n * LITERAL_SHARE
        long = F.lit(n >= SHORTEST)
        at = own.withColumn("pos", F.explode(_starts(F.col("canon"), n)))

        def asking(form, col, these, n=n, at=at):
            h = _hashes(F.slice(col, F.col("pos") + 1, n))
            return at.where(these).select(F.lit(form).alias("form"), F.lit(n).alias("n"), let(h, lambda x: _window(x, x, F.lit(0), n)).alias("h"),
                                          "item_key", F.col("pos").alias("item_pos"))
        parts = [asking(1, "plain", ~(long & ordinary("fold")))]
        if n >= SHORTEST:
            parts += [asking(0, "canon", ordinary("canon")), asking(0, "fold", ordinary("fold"))]
        for part in parts:
            asked = part if asked is None else asked.unionByName(part)
    names = f"key {base.schema['key'].dataType.simpleString()}, doc_id long, item_id long, n_words int, verbatim boolean"
    if asked is None:
        return docs.sparkSession.createDataFrame([], names)
    asked = written(asked.distinct(), "benchmark-windows")
    count = 0
    for r in asked.groupBy("form", "n").count().collect():          # two forms, at most k lengths
        used[r["form"]].append(r["n"])
        count += r["count"]
    table_size = 1 << max(16, min(22, (16 * int(sizes[1])).bit_length()))
    # documents: what each window that the filter lets through needs for the comparison travels with it
    text = F.coalesce("text", F.lit(""))
    found = _found_windows(text, F.col("filled"), table_size, sorted(used[0]), sorted(used[1]))
    cut = lambda c, w: F.slice(c, w["pos"] + 1, w["n"])
    with_words = let(found, lambda ws: F.when(F.size(ws) > 0, let(_forms(text), lambda a: F.transform(ws, lambda w: F.struct(
        w["form"].alias("form"), w["n"].alias("n"), w["pos"].alias("pos"), w["h"].alias("h"),
        *[cut(a[c], w).alias(c) for c in ("canon", "fold", "plain")])))))
    met = (base.withColumn("filled", _filled_slots(item, table_size)).select("key", with_words.alias("windows"))
           # outer: an inner explode gets a filter on the array's size, which would compute all windows a second time
           .select("key", F.explode_outer("windows").alias("w")).select("key", "w.*").where(F.col("h").isNotNull()))
    hits = met.join(F.broadcast(asked) if count <= BROADCAST_WINDOWS else asked, ["form", "n", "h"])
    # one row a diagonal, which holds no more windows than the item
    diagonals = (hits.groupBy("key", "item_key", (F.col("pos") - F.col("item_pos")).alias("shift"), F.col("n").alias("k"))
                 .agg(F.array_sort(F.collect_set(F.struct("pos", "canon", "fold", "plain"))).alias("windows")))
    theirs = item.select("item_key", "item_id", F.col("canon").alias("ic"), F.col("fold").alias("if"), F.col("plain").alias("ir"))
    both = diagonals.join(theirs, "item_key").select("key", F.col("key")["id"].cast("long").alias("doc_id"), "item_id", "k", _laid_out().alias("z"))
    both = fence(both.withColumn("p", F.transform("z", _compared)).drop("z"))
    both = both.withColumn("same", F.size(F.filter("p", lambda w: w["same"])))
    both = both.where((F.col("same") >= F.col("k")) & _leaks())
    return (both.groupBy("key", "doc_id", "item_id").agg(
        F.max("same").cast("int").alias("n_words"),
        F.bool_or(F.forall("p", lambda w: ~w["same"] | w["own"])).alias("verbatim")))


def _compared(w: Column) -> Column:
    """Two words in the same place: equal in canonical form, equal as they stand, ordinary, names."""
    own, folded = w["dr"] == w["ir"], w["df"] == w["if"]
    sure = lambda c: F.coalesce(c, F.lit(False))
    return F.struct(sure(own | folded | (w["dc"] == w["ic"])).alias("same"), sure(own).alias("own"),
                    sure(~w["ic"].startswith("<") | (folded & ~w["if"].startswith("<"))).alias("ordinary"),
                    sure(w["ic"].startswith("<name>") & w["dc"].startswith("<name>")).alias("name"), w["ir"].alias("item"), w["dr"].alias("doc"))


def _leaks() -> Column:
    """Whether the compared words ``p`` of a diagonal hold a leak of windows of ``k`` words."""
    p, k = F.col("p"), F.col("k")
    window = lambda s: F.slice(p, s + 1, k)
    own = lambda s: F.forall(window(s), lambda w: w["own"])
    alike = lambda s: ((k >= SHORTEST) & F.forall(window(s), lambda w: w["same"])
                       & (F.size(F.filter(window(s), lambda w: w["ordinary"])) >= k * LITERAL_SHARE))
    starts = F.filter(F.sequence(F.lit(0), F.size(p) - k), lambda s: own(s) | alike(s))

    def join(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
                          F.array(F.struct(last["a"].alias("a"), (s + k).alias("b"))))
        return F.when(last["b"] >= s, longer).otherwise(F.concat(acc, F.array(F.struct(s.alias("a"), (s + k).alias("b")))))

    def consistent(a, n):
        names = F.array_distinct(F.transform(F.filter(F.slice(p, a + 1, n), lambda w: w["same"] & w["name"]),
                                             lambda w: F.struct(w["item"].alias("item"), w["doc"].alias("doc"))))
        return F.size(names) == F.size(F.array_distinct(F.transform(names, lambda x: x["item"])))

    runs = F.aggregate(starts, F.array().cast("array<struct<a:int,b:int>>"), join)
    part = lambda r: F.exists(F.sequence(r["a"], F.greatest(r["a"], r["b"] - 2 * k)), lambda s: consistent(s, 2 * k))
    return F.exists(starts, own) | F.exists(runs, lambda r: consistent(r["a"], r["b"] - r["a"]) | (
        (r["b"] - r["a"] >= 2 * k) & part(r)))


def leaked_items(docs: DataFrame, benchmark: DataFrame, **cols) -> DataFrame:
    """(doc_id, item_ids, n_words, verbatim): one row for each contaminated row of ``docs``."""
    found = find_leaks(docs, benchmark, **cols)
    return (found.groupBy("key", "doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"),
                                               F.max("n_words").alias("n_words"), F.bool_or("verbatim").alias("verbatim"))
            .drop("key"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **cols) -> DataFrame:
    """``docs`` without the rows that leak an item."""
    bad = find_leaks(docs, benchmark, id_col, text_col, **cols).select(F.col("key").alias("_leak_key")).distinct()
    names = docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)])
    key = row_key(F.col(f"_c{names.index(id_col)}"), F.col(f"_c{names.index(text_col)}"))
    kept = own.join(bad, key.eqNullSafe(F.col("_leak_key")), "left_anti")
    return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])
