"""Line dedup against brute force."""

import hashlib
import random

import pytest

from shapecode.llm import line_dedup

SCHEMA = "doc_id long, text string, block int, slice int, bits string, keeper string"      # clashing names
SPACE = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "b", "k") for i, t in rows], SCHEMA).repartition(3)


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def dropped(rows, chars=20, docs=3):
    holders = {}
    rank = lambda i: (i is not None, i or 0)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= chars:
                holders.setdefault(key(x), set()).add(rank(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(holders.get(key(x), ())) < docs or max(holders[key(x)]) == rank(i)]
        kept = "\n".join(keep)
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(map(str, out))


def odd_rows():
    rng = random.Random(5)
    shared = [f"Shared line number {k} which stands in many texts é{k}" for k in range(12)]
    rows = [(i, "\n".join(rng.choice([f" {rng.choice(shared)}\t", rng.choice(shared).upper(), f"own {i} {rng.random()} and more words",
                                      "short", "", "  "]) for _ in range(rng.randrange(12)))) for i in range(120)]
    last = "a line of the last three documents only"
    rows += [(200, last), (201, f"{last}\nx"), (202, f"y\n  {last}\r"), (203, None), (204, ""), (205, "\n\n"), (206, "😀" * 19), (207, "😀" * 20),
             (208, "😀" * 20), (209, "😀" * 20 + "\n" + "ß" * 20), (210, "ẞ" * 20), (None, last), (None, shared[0]), (7, rows[7][1]), (7, shared[1]),
             (7, rows[7][1]), (211, "É" * 30), (212, "É" * 30), (213, "é" * 30), (-5, shared[2]), (214, ("one text says it often enough\n" * 9)),
             (215, "z" * 300000), (216, "z" * 300000), (217, "z" * 300000 + "\n" + shared[3])]
    return rows


@pytest.mark.parametrize("size", [{}, {"block_chars": 300, "slice_keys": 1}, {"least_docs": 5, "least_chars": 3}])
def test_lines_equal_brute_force(spark, size):
    rows = odd_rows()
    out = line_dedup.drop_repeated_lines(frame(spark, rows), **size).collect()
    got = sorted(str((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256, r.kept_text)) for r in out)
    assert got == dropped(rows, size.get("least_chars", 20), size.get("least_docs", 3))


def test_lines_of_no_rows(spark):
    assert line_dedup.drop_repeated_lines(frame(spark, [(1, "a")]).limit(0)).collect() == []


def test_only_suspected_repeats_are_grouped_exactly(spark):
    """Of many lines that stand once, at most a few in a hundred pass the filters."""
    rows = [(i, "\n".join(f"line {k} of the document {i} and no other" for k in range(50))) for i in range(200)]
    import pyarrow as pa
    table = pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows], "block": [0] * len(rows)})
    bits = 18
    parts = [table.slice(a, 50) for a in range(0, 200, 50)]
    sent = [line_dedup._filters(p.set_column(2, "block", pa.array([k] * p.num_rows, pa.int64())), 20, 1, bits) for k, p in enumerate(parts)]
    answers = line_dedup._merge(pa.concat_tables(sent), bits)
    suspects = 0
    for k, p in enumerate(parts):
        mine = answers.filter(pa.compute.equal(answers.column("block"), k))
        exact = line_dedup._exact(p, mine, 20, 1, bits, 3)
        suspects += sum(len(x) // 8 for x in exact.column("h").to_pylist())
    assert suspects <= 0.03 * 200 * 50


def test_texts_are_shuffled_once(spark):
    df = line_dedup.drop_repeated_lines(frame(spark, odd_rows()), with_text=False)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("ReusedExchange") >= 2, final
