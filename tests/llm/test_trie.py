"""The conversation prefix trie against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from shapecode.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth long, shard long, x1 string, digest string"      # clashing names


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA).repartition(3)


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    digest = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest()
    turns = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[0], t[1], digest(*t[2:])))] for c, ts in own.items()}
    convs = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        r = c % 5 if c >= 0 else -(-c % 5)
        convs[c] = tuple(turns.get(c - r, [])[:h] + ts[h:])
    members = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    parents = {k[:-1] for k in members if k}
    out = []
    below = {k: [] for k in members}
    for k in members:
        for d in range(len(k) + 1):
            below[k[:d]].append(k)
    for k, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(convs[c]) == len(k))))
        out.append((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), sum(1 for x in members if x and x[:-1] == k),
                    sum(x not in parents for x in below[k]),
                    sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below[k] if x), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talk(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([0, 1, 2, 3, 5, 8, 12])):
            rows.append((c, t, rng.choice(["user", "bot", None]), rng.choice(["hi", "hello é😀", "", None, f"own {c % 4} {t}", f"own {c} {t}"])))
    return rows


ODD = [(None, 1, "a", "b"), (1000, None, "u", "first"), (1000, 5, "u", "b"), (1000, 5, "u", "a"), (1000, 5, "u", "a"), (1002, 0, None, None),
       (1003, 0, "u", ""), (1004, 7, "", "u"), (-3, 0, "u", "x"), (-5, 0, "u", "x"), (-5, 1, "u", "y"), (1010, 0, "u", "long " * 50000)]


@pytest.mark.parametrize("size", [{}, {"shard_rows": 20, "queue": 3}])
def test_trie_equals_brute_force(spark, size):
    rows = talk(1, 80) + ODD
    rows += [(2000 + i, t, "user", f"the same talk {t}") for i in range(40) for t in range(6)]
    rows += [(3000, t, "u", f"{t}") for t in range(200)]
    out = P.prefix_trie(frame(spark, rows), **size).collect()
    assert sorted(map(tuple, out), key=str) == brute(rows)


def test_no_conversations(spark):
    assert P.prefix_trie(frame(spark, ODD).limit(0)).collect() == []
    assert P.prefix_trie(frame(spark, ODD[:1])).collect() == []


def test_time_forward_processing_with_equal_keys_and_spilled_runs():
    """A random forest whose keys clash in their first half: totals equal those of a walk, whatever the queue and the batches."""
    rng = random.Random(7)
    nodes = {(0, 0, 0): None}
    level = [(0, 0, 0)]
    for d in range(1, 7):
        level = [(d, rng.randrange(5), k) for k in range(60)]
        for v in level:
            nodes[v] = rng.choice([u for u in nodes if u[0] == d - 1])
    own = {v: (rng.randrange(3), rng.randrange(100)) for v in nodes}
    total = {v: list(x) for v, x in own.items()}
    for v in sorted(nodes, reverse=True):
        if nodes[v]:
            total[nodes[v]] = [a + b for a, b in zip(total[nodes[v]], total[v])]
    order = sorted(nodes, key=lambda v: (-v[0], v[1], v[2]))
    cells = [np.array(c, dtype=np.int64) for c in zip(*[(s, *v, *(nodes[v] or (0, 0, 0))[1:], *own[v]) for s in (0, 1) for v in order])]
    for limit, step in ((1 << 20, 1000), (5, 7), (1, 1), (20, 64)):
        got = {}
        for depth, x1, x2, t in P.time_forward(([c[a : a + step] for c in cells] for a in range(0, len(cells[0]), step)), limit):
            for k in zip(depth.tolist(), x1.tolist(), x2.tolist(), t.tolist(), strict=True):
                assert got.setdefault(k[:3], k[3]) == k[3]
        assert got == total


def test_queue_spills_and_adds_up():
    q = P.SpillingQueue(1, limit=10)
    for i in range(100):
        q.push(np.array([[i % 7, i % 3, i]], dtype=np.int64))
    assert q.spilled >= 9 and q.held <= 10
    got = np.concatenate([q.opened().take(2), q.take(100)])
    want = {}
    for i in range(100):
        want[i % 7, i % 3] = want.get((i % 7, i % 3), 0) + i
    assert {(int(a), int(b)): int(v) for a, b, v in got} == want and got[:, 0].tolist() == sorted(got[:, 0].tolist())
