"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Candidate spans come from wide patterns: the base kinds (email, ip, card,
phone), which always stay, and looser shapes that may or may not be personal
data (spelled-out addresses, phone numbers without a plus sign, card-like
numbers that fail the checksum, social security numbers, bank accounts,
titled names).  Four labelers vote yes, no or abstain on every candidate:

* form: a stricter regular expression or checksum of the kind;
* gazetteer: known providers, number ranges, country codes, titles;
* context: words shortly before the span that speak for or against the kind;
* place: what touches the span on its left.

Votes are counted by Spark into patterns (kind x 3**4 at most).  Expectation
maximisation over these counts estimates every labeler's reliability for yes
and no (two-class Dawid-Skene, abstentions left out) and the posterior of each
pattern.  A logistic classifier over votes, kind and span length is then
trained on the same bounded counts with the posteriors as soft targets, and
scores every candidate by a Spark expression.

DataFrame functions only; the driver sees the counts (bounded by kinds x vote
patterns x length classes), never rows.

Defined cases: a null text is empty (no spans, the digest of the empty string);
rows that repeat get equal spans; null ids are kept; an empty table gives an
empty result; without candidates the classifier accepts none; other columns
are ignored (``redact`` passes them through).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapecode.llm.common import written
from shapecode.llm.spans import cut, ends_of, let, matches, pieces, printed, running_max, touches

# Base patterns.  Possessive repeats and run guards only spare Java's recursion and rescans.
EMAIL = (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Looser shapes that only the classifier can admit.
SPELLED = r"\b[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}\x20?[\[(]dot[\])]\x20?[A-Za-z]{2,10}\b"
LOCAL_PHONE = r"(?<![0-9+(.-])(?<!\+[0-9]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b"
NAME = r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.\x20\p{Lu}\p{Ll}{1,30}(?:\x20\p{Lu}\p{Ll}{1,30})?"

BASE = ("email", "ip", "card", "phone")
LOOSE = ("spelled_email", "local_phone", "ssn", "iban", "titled_name", "number")
KINDS = BASE + LOOSE
LABELERS = ("form", "gazetteer", "context", "place")
LENGTHS = (8, 12, 16, 24)          # bounds of the length classes
ROUNDS = 50
ACCEPT = 0.5

# Gazetteers and context words.
MAIL_HOSTS = r"@(?:mail[0-9]*\.|gmail\.|yahoo\.|hotmail\.|outlook\.|proton|icloud\.|web\.de|gmx\.)"
TOP_DOMAINS = r"(?i)\b(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$"
IBAN_LANDS = r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)"
SPEAKS_FOR = {
    "email": r"(?i)\b(?:e-?mail|contact|write to|mailto|from|to|cc|courriel|correo)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|ping|client|adresse)\b",
    "card": r"(?i)\b(?:card|visa|master|amex|credit|debit|pay|karte|carte|tarjeta)",
    "phone": r"(?i)\b(?:tel|phone|call|fax|mobile|cell|whatsapp|telefon|t[eé]l[eé]phone)",
    "ssn": r"(?i)\b(?:ssn|social security)\b",
    "iban": r"(?i)\b(?:iban|account|konto|bank|compte|cuenta)\b",
    "name": r"(?i)\b(?:dear|sincerely|signed|patient|client|by)\b",
}
SPEAKS_AGAINST = r"(?i)\b(?:version|ver|page|isbn|issn|doi|chapter|section|figure|table|order|item|model|total|sum|no)\b\.?[\s:#]*$"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn sum."""
    n = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: acc + F.element_at(
        # digit values as they stand, and doubled with digits summed
        F.when((n - i) % 2 == 0, F.array(*[F.lit(d) for d in range(10)]))
        .otherwise(F.array(*[F.lit(d * 2 - 9 if d > 4 else d * 2) for d in range(10)])),
        F.coalesce(F.substring(digits, i, F.lit(1)).try_cast("int"), F.lit(0)) + 1))
    return total % 10 == 0


def _ip_parts(hit: Column) -> Column:
    def small(p):
        bare = F.regexp_replace(p, "^0+", "")
        return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)
    return F.forall(F.split(hit, r"\."), small)


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def base_matches(text: Column) -> dict[str, Column]:
    """kind -> matches that are personal data by rule."""
    digit = _has(text, "[0-9]")
    card = F.filter(matches(text, CARD, 0, _has(text, "[0-9](?:[\\x20-]?[0-9]){11}")),
                    lambda m: F.length(_digits(m["hit"])).between(12, 19) & luhn(_digits(m["hit"])))
    return {
        "email": matches(text, EMAIL, 0, F.contains(text, F.lit("@"))),
        "ip": F.filter(matches(text, IP, 0, digit), lambda m: _ip_parts(m["hit"])),
        "card": card,
        "phone": F.filter(matches(text, PHONE, 0, F.contains(text, F.lit("+"))),
                          lambda m: F.length(_digits(m["hit"])).between(9, 15)),
    }


def loose_matches(text: Column) -> dict[str, Column]:
    digit = _has(text, "[0-9]")
    return {
        "spelled_email": matches(text, SPELLED, 0, _has(text, r"[\[(]at[\])]")),
        "local_phone": matches(text, LOCAL_PHONE, 0, digit),
        "ssn": matches(text, SSN, 0, digit),
        "iban": matches(text, IBAN, 0, digit),
        "titled_name": matches(text, NAME, 0, _has(text, r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.")),
        "number": F.filter(matches(text, CARD, 0, _has(text, "[0-9](?:[\\x20-]?[0-9]){11}")),
                           lambda m: F.length(_digits(m["hit"])).between(13, 19) & ~luhn(_digits(m["hit"]))),
    }


def _votes(kind: str, m: Column) -> list[Column]:
    """form, gazetteer, context, place of one match: 1, -1 or 0 (abstain)."""
    hit, before = m["hit"], m["before"]
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
    digits = _digits(hit)
    form = {
        "email": F.when(hit.rlike(r"^[A-Za-z0-9][^@]{0,63}@.{1,253}$"), yes).otherwise(no),
        "ip": F.when(hit.rlike(r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$"), yes).otherwise(no),
        "card": F.when(F.length(digits).between(13, 19) & hit.rlike(r"^[0-9]{13,19}$|^(?:[0-9]{4}[\x20-]?)+[0-9]{1,4}$"), yes).otherwise(no),
        "phone": F.when(hit.rlike(r"^\+[1-9]"), yes).otherwise(no),
        "spelled_email": yes, "local_phone": F.when(digits.rlike("^[2-9]"), yes).otherwise(no),
        "ssn": F.when(hit.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"), yes).otherwise(no),
        "iban": F.when(F.length(F.regexp_replace(hit, " ", "")).between(15, 34), yes).otherwise(no),
        "titled_name": none, "number": no,
    }[kind]
    gazetteer = {
        "email": F.when(hit.rlike(MAIL_HOSTS) | hit.rlike(TOP_DOMAINS), yes).otherwise(none),
        "spelled_email": F.when(F.regexp_replace(hit, r"[^A-Za-z]+$", "").rlike(TOP_DOMAINS), yes).otherwise(no),
        "ip": F.when(hit.rlike(r"^(?:0|127|255)\."), no).otherwise(none),
        "card": F.when(digits.rlike("^(?:4|5[1-5]|3[47]|6(?:011|5))"), yes).otherwise(none),
        "number": F.when(digits.rlike("^(?:4|5[1-5]|3[47]|6(?:011|5))"), none).otherwise(no),
        "phone": F.when(digits.rlike("^(?:1[2-9]|3[0-9]|4[0-9]|7|8[1-6]|9[0-8])"), yes).otherwise(none),
        "local_phone": F.when(digits.rlike("^(?:800|888|900)"), no).otherwise(none),
        "ssn": none, "iban": F.when(hit.rlike(IBAN_LANDS), yes).otherwise(no), "titled_name": none,
    }[kind]
    words = {"spelled_email": "email", "local_phone": "phone", "titled_name": "name", "number": "card"}.get(kind, kind)
    context = F.when(before.rlike(SPEAKS_FOR[words]), yes).when(before.rlike(SPEAKS_AGAINST), no).otherwise(none)
    place = F.when(before.rlike(r"[\s:<(\[\"']$") | (F.length(before) == 0), none).otherwise(no)
    return [form, gazetteer, context, place]


def _length_class(m: Column) -> Column:
    n = m["end"] - m["start"]
    out = F.lit(len(LENGTHS))
    for k in range(len(LENGTHS) - 1, -1, -1):
        out = F.when(n <= LENGTHS[k], F.lit(k)).otherwise(out)
    return out


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def candidates(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` with ``_base`` and ``_loose``: array<struct<start, rank, kind, end, votes, size>> of each."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = rows.withColumns({f"_m_{k}": c for k, c in {**base_matches(text), **loose_matches(text)}.items()})

    def candidate(kind):
        rank = KINDS.index(kind)
        return F.transform(F.col(f"_m_{kind}"), lambda m: F.struct(
            m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end"),
            F.array(*_votes(kind, m)).alias("votes"), _length_class(m).alias("size")))

    base = F.concat(*[candidate(k) for k in BASE])
    loose = F.concat(*[candidate(k) for k in LOOSE])
    out = rows.withColumns({"_base": base, "_loose": loose}).drop(*[f"_m_{k}" for k in KINDS])
    # a loose span that touches a base span is part of it; the spans of one kind are in order and apart
    of_kinds = F.struct(*[ends_of(_of_kind(F.col("_base"), k)).alias(k) for k in BASE])
    free = let(of_kinds, lambda of: F.filter("_loose", lambda s: ~reduce(lambda a, b: a | b, [touches(s, of[k]) for k in BASE])))
    return out.withColumn("_loose", F.when(F.size("_loose") > 0, free).otherwise(F.col("_loose")))


# ------------------------------------------------------------------ label model and classifier (driver, on counts)

def em(counts: dict[tuple, int], rounds: int = ROUNDS) -> tuple[dict[tuple, float], dict]:
    """Posterior of every (kind, votes), and prior and reliabilities.

    Reliabilities are shared by the kinds, the prior is per kind; counts get
    one pseudo-vote on each side, and labelers start better than chance.
    """
    kinds = sorted({k[0] for k in counts})
    prior = {k: 0.9 if k in BASE else 0.5 for k in kinds}
    right = {(name, c): 0.8 for name in LABELERS for c in (1, -1)}     # P(vote agrees | class c, did not abstain)
    post: dict[tuple, float] = {}
    for _ in range(rounds):
        for key in counts:
            kind, votes = key[0], key[1]
            a, b = math.log(prior[kind]), math.log(1 - prior[kind])
            for name, v in zip(LABELERS, votes, strict=True):
                if v:
                    a += math.log(right[name, 1] if v == 1 else 1 - right[name, 1])
                    b += math.log(right[name, -1] if v == -1 else 1 - right[name, -1])
            post[key] = 1 / (1 + math.exp(min(max(b - a, -700), 700)))
        for name_at, name in enumerate(LABELERS):
            for c in (1, -1):
                hit, seen = 4.0, 5.0
                for key, n in counts.items():
                    v = key[1][name_at]
                    if v:
                        w = n * (post[key] if c == 1 else 1 - post[key])
                        seen += w
                        hit += w * (v == c)
                right[name, c] = min(max(hit / seen, 0.05), 0.95)
        for k in kinds:
            n = sum(c for key, c in counts.items() if key[0] == k)
            s = sum(c * post[key] for key, c in counts.items() if key[0] == k)
            start = 0.9 if k in BASE else 0.5
            prior[k] = min(max((s + 10 * start) / (n + 10), 0.02), 0.98)
    return post, {"prior": prior, "right": right}


def _active(kind: str, votes: tuple, size: int) -> list[str]:
    return ["bias", f"kind={kind}", f"size={size}"] + [f"{n}={v}" for n, v in zip(LABELERS, votes, strict=True) if v]


def fit_classifier(counts: dict[tuple, int], post: dict[tuple, float], steps: int = 400, rate: float = 0.5,
                   ridge: float = 1e-3) -> dict[str, float]:
    """Logistic weights by gradient ascent on soft targets; ``counts`` by (kind, votes, size)."""
    rows = [(_active(*key), n, post[key[:2]]) for key, n in sorted(counts.items())]
    total = sum(n for _, n, _ in rows) or 1
    weights: dict[str, float] = {name: 0.0 for names, _, _ in rows for name in names}
    # patterns count by the square root, so rare kinds are not drowned by frequent ones
    share = [math.sqrt(n / total) for _, n, _ in rows]
    scale = sum(share) or 1.0
    for _ in range(steps):
        slope = {k: -ridge * w for k, w in weights.items()}
        for (names, _n, target), s in zip(rows, share, strict=True):
            p = 1 / (1 + math.exp(-sum(weights[k] for k in names)))
            for k in names:
                slope[k] += s / scale * (target - p)
        for k in weights:
            weights[k] += rate * 4 * slope[k]
    return weights


def train(found: DataFrame) -> dict[str, float]:
    """Classifier weights from all candidates of ``found`` (the columns of ``candidates``)."""
    spans = found.select(F.explode(F.concat("_base", "_loose")).alias("s"))
    got = spans.groupBy("s.kind", "s.votes", "s.size").agg(F.count(F.lit(1)).alias("n")).collect()
    full = {(r["kind"], tuple(r["votes"]), r["size"]): r["n"] for r in got}
    patterns: dict[tuple, int] = {}
    for (kind, votes, _), n in full.items():
        patterns[kind, votes] = patterns.get((kind, votes), 0) + n
    post, _ = em(patterns)
    return fit_classifier(full, post)


def probability(weights: dict[str, float], s: Column) -> Column:
    """The classifier as a Spark expression over one candidate."""
    total = F.lit(weights.get("bias", -20.0))
    for name, w in sorted(weights.items()):
        feature, _, value = name.partition("=")
        if feature == "kind":
            total = total + F.when(s["kind"] == value, F.lit(w)).otherwise(0.0)
        elif feature == "size":
            total = total + F.when(s["size"] == int(value), F.lit(w)).otherwise(0.0)
        elif feature in LABELERS:
            total = total + F.when(s["votes"][LABELERS.index(feature)] == int(value), F.lit(w)).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"),
                                                 s["kind"].alias("kind"), s["end"].alias("end")))


def decide(found: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``found`` with ``_base`` and ``_added`` as plain spans; base spans stay whatever the classifier says."""
    added = F.filter("_loose", lambda s: probability(weights, s) >= ACCEPT)
    return found.withColumns({"_added": _plain(added), "_base": _plain(F.col("_base"))}).drop("_loose")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = written(candidates(rows).drop("text"), "pii-candidates")
    out = decide(found, train(found))
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[count(k) for k in BASE], F.sha2(F.encode(printed(F.col("_base")), "UTF-8"), 256).alias("base_sha256"),
                      printed(F.concat("_base", "_added")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs``, same columns, with every accepted span replaced by ``<KIND>``; overlapping spans become one."""
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(names)])
    at = f"_c{names.index(text_col)}"
    found = written(candidates(inner, at), "pii-candidates")
    out = decide(found, train(found.select("_base", "_loose")))
    text = F.coalesce(F.col(at).cast("string"), F.lit(""))

    def replaced(a):
        """Each span that starts behind all spans before it: the text since their end, then its label."""
        spans, before, of = a["spans"], a["before"], a["of"]
        parts = F.filter(F.transform(spans, lambda s, i: F.when(s["start"] >= F.get(before, i), F.concat(
            cut(of, F.get(before, i), s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")))), lambda x: x.isNotNull())
        return F.concat(F.array_join(parts, ""), cut(of, F.array_max(spans["end"]), F.length(text)))

    spans = let(F.array_sort(F.concat("_base", "_added")), lambda s: F.struct(
        s.alias("spans"), running_max(s["end"]).alias("before"), pieces(text).alias("of")))
    done = let(spans, replaced)
    new = F.when(F.size(F.concat("_base", "_added")) > 0, done).otherwise(F.col(at))
    return out.select(*[(new if f"_c{k}" == at else F.col(f"_c{k}")).alias(c) for k, c in enumerate(names)])
