"""Secret scan through a trigram index.

Every rule is a regular expression.  From its parse tree a Boolean trigram
query is derived (an OR of ANDs of trigrams that any match must hold, in small
letters).  The index is a written posting table (trigram, row key) over all
texts, for the trigrams that some query asks for.  Intersecting the postings
of each conjunction gives the candidate rows of a rule; only these are verified
with the regular expression, over their whole text.  A rule without mandatory
trigrams is run on every text.

DataFrame functions only.

Defined cases: a null text is empty (no spans; the digest of the empty
string); rows that repeat share a key and get equal spans; null ids are kept;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapecode.llm.common import written
from shapecode.llm.spans import matches, printed, tagged

MAX_STRINGS = 64           # exact strings that the derivation follows at once


@dataclass(frozen=True)
class Rule:
    """``pattern`` as searched; ``keep(match)`` drops failing matches; ``group`` is what ``keep`` sees as part."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0          # code points of the group that a match must have
    base: bool = True


_ASSIGN = (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
RULES = (
    Rule("assign", _ASSIGN, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # runs of hex digits are maximal, so asking for 24 in the pattern drops exactly the short ones
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}", base=False),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", base=False),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", base=False),
)


# ------------------------------------------------------------------ trigram queries

def _product(a: set[str], b: set[str]) -> set[str] | None:
    return {x + y for x in a for y in b} if len(a) * len(b) <= MAX_STRINGS else None


def _strings(node) -> set[str] | None:
    """The exact strings of a parse node in small letters, or None where they are too many or unbounded."""
    parser = re._parser
    op, arg = node
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "IN":
        out = set()
        for o, a in arg:
            if str(o) == "LITERAL":
                out.add(chr(a).lower())
            elif str(o) == "RANGE" and a[1] - a[0] < 8:
                out |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
            else:
                return None
        return out
    if name == "SUBPATTERN":
        return _sequence_strings(arg[-1])
    if name == "BRANCH":
        parts = [_sequence_strings(p) for p in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, body = arg
        one = _sequence_strings(body)
        if one is None or high is parser.MAXREPEAT or high > 8:
            return None
        out, power = set(), {""}
        for n in range(int(high) + 1):
            if n >= low:
                out |= power
            power = _product(power, one)
            if power is None or len(out) > MAX_STRINGS:
                return None
        return out
    return {""} if name == "AT" else None


def _sequence_strings(nodes) -> set[str] | None:
    now = {""}
    for node in nodes:
        s = _strings(node)
        now = None if s is None else _product(now, s)
        if now is None:
            return None
    return now


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _dnf(nodes) -> set[frozenset[str]]:
    """An OR of ANDs of trigrams that every match holds; {frozenset()} asks for nothing."""
    query = {frozenset()}

    def also(more: set[frozenset[str]]):
        nonlocal query
        if frozenset() not in more and len(query) * len(more) <= MAX_STRINGS:
            query = {a | b for a, b in itertools.product(query, more)}

    run = {""}

    def flush():
        nonlocal run
        if run != {""}:
            also({_grams(s) for s in run})
        run = {""}

    for node in nodes:
        s = _strings(node)
        joined = None if s is None else _product(run, s)
        if joined is not None:
            run = joined
            continue
        flush()
        op, arg = node
        if str(op) == "SUBPATTERN":
            also(_dnf(arg[-1]))
        elif str(op) == "BRANCH":
            also(set().union(*(_dnf(p) for p in arg[1])))
        elif str(op) in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            also(_dnf(arg[2]))
        elif s is not None:
            run = s
    flush()
    return query


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The rule's query as conjunctions; an empty list means that every text must be scanned."""
    out = _dnf(re._parser.parse(pattern))
    needed = [c for c in out if not any(other < c for other in out)]      # a larger conjunction adds nothing
    return [] if frozenset() in out else sorted(needed, key=sorted)


# ------------------------------------------------------------------ index and search

def row_key(id_col: Column, text: Column) -> Column:
    """Joins a row with its postings; rows of equal key only ever add candidates."""
    return F.xxhash64(id_col, text)


def build_index(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """Written postings (trigram, key) of ``rows`` (key, text) for the given trigrams."""
    low = rows.select("key", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in trigrams]))
    return written(low.select("key", F.explode(held).alias("trigram")), "trigram-postings")


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): the rules, as bits, whose trigram query a row satisfies."""
    spark = postings.sparkSession
    terms = [(r, c, g, len(conj)) for r, rule in enumerate(rules)
             for c, conj in enumerate(trigram_query(rule.pattern)) for g in conj]
    asked = spark.createDataFrame(terms, "rule int, conj int, trigram string, need int")   # as many rows as the rules have trigrams
    return (postings.join(F.broadcast(asked), "trigram").groupBy("key", "rule", "conj")
            .agg(F.countDistinct("trigram").alias("n"), F.first("need").alias("need")).where("n = need")
            .groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules")))


def _at_least(n: int):
    return lambda m: F.length(m["part"]) >= F.lit(n)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_<kind> of every rule, base_sha256, spans) for every row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({g for q in queries for conj in q for g in conj})
    if trigrams:
        rows = rows.join(candidates(build_index(rows.select("key", "text"), trigrams), rules), "key", "left")
    else:
        rows = rows.withColumn("rules", F.lit(0).cast("long"))
    found = []
    for r, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        is_candidate = F.expr(f"coalesce(rules, 0L) & {1 << r}L") != 0 if query else None
        hits = matches(F.col("text"), rule.pattern, rule.group, is_candidate)
        if rule.least:
            hits = F.filter(hits, _at_least(rule.least))
        found.append(tagged(hits, rule.kind, r).alias(f"_{rule.kind}"))
    out = rows.select("doc_id", *found)
    base = F.concat(*[F.col(f"_{r.kind}") for r in rules if r.base])
    every = F.concat(*[F.col(f"_{r.kind}") for r in rules])
    return out.select("doc_id", *[F.size(f"_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in rules],
                      F.sha2(F.encode(printed(base), "UTF-8"), 256).alias("base_sha256"), printed(every).alias("spans"))
