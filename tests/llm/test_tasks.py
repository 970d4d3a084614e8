"""Window removal, packing, vectors, quality, n-gram join, WARC and the pipeline against brute force."""

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapecode.llm import embed_dedup, ngram_join, packing, quality, substring_dedup, warc
from shapecode.llm.graph import components
from shapecode.llm.queries import REGISTRY, tokenizer_path
from tests.llm.test_native import private_spans

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, block int, slice int, n int, row_key string"      # clashing names


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, "k") for i, t in rows], SCHEMA).repartition(3)


def sentences(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# ---------------------------------------------------------------- window removal

def removed(rows, k):
    first, texts = {}, {}
    for i, t in rows:
        texts[i, t] = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    for (i, _t), w in texts.items():
        for a in range(len(w) - k + 1):
            key = tuple(w[a : a + k])
            place = (-math.inf if i is None else i, a)
            first[key] = min(first.get(key, place), place)
    out = {}
    for (i, t), w in texts.items():
        gone = set()
        for a in range(len(w) - k + 1):
            if first[tuple(w[a : a + k])] != (-math.inf if i is None else i, a):
                gone.update(range(a, a + k))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i, t] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("k", [3, 20])
def test_repeated_windows(spark, k):
    rng = random.Random(k)
    hot = sentences(rng, 30)
    rows = [(i, f"{sentences(rng, 40)}  {hot}\n{sentences(rng, rng.randrange(30))}") for i in range(60)]
    rows += [(200, rows[7][1]), (201, None), (202, ""), (203, " \t\n"), (204, "a " * 500), (205, " nbsp stays one word" + " x" * 30),
             (206, rows[3][1][:150]), (None, hot), (207, "y" * 300000), (200, rows[7][1])]
    out = substring_dedup.remove_repeated_windows(frame(spark, rows), k=k).collect()
    want = removed(rows, k)
    assert sorted(map(str, [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in out])) == sorted(
        map(str, [(i, *want[i, t]) for i, t in rows]))


def test_repeated_windows_of_no_rows(spark):
    assert substring_dedup.remove_repeated_windows(frame(spark, [(1, "a")]).limit(0)).collect() == []


def test_sketch_loses_no_repeat(spark):
    """With a few counters nearly every window is overestimated; the result stays exact."""
    rng = random.Random(9)
    rows = [(i, sentences(rng, 80, 25)) for i in range(80)]
    out = substring_dedup.remove_repeated_windows(frame(spark, rows), k=4, slice_windows=10**9, block_chars=500).collect()
    want = removed(rows, 4)
    assert {r.doc_id: r.n_removed for r in out} == {i: want[i, t][1] for i, t in rows}


# ---------------------------------------------------------------- packing

TEXTS = ["", " ", "  two  spaces ", "line\n\nbreaks \n x", "it's we'll I'D", "é ü x　y", "<|endoftext|> a", "a <|endoftext|> b", "a  <|endoftext|>  <|endoftext|><|endoftext|>\n", "<|endoftext|", "x <|EndOfText|>", "tab\tand\r\nmore  ",
         "数字 ١٢٣ ½ ² ⅷ", "😀😀 áb", "x" * 5000, "\x1c\x1d\x85 a", "a ​ b", "'s 's's 'LL", "1 22 333 a1b2"]


def test_ids_equal_the_tokenizers_library(spark):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(6)
    alphabet = list("ab Z9é'\n\t.,  ") + ["'s", " ", "😀", "ß"]
    texts = TEXTS + ["".join(rng.choices(alphabet, k=60)) for _ in range(400)]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(100).collect()]
    coder = packing.Encoder.of(tokenizer_path())
    for x in texts:
        assert np.frombuffer(coder.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def best_sum(lengths, room):
    reach = {0}
    for n in lengths:
        reach |= {r + n for r in reach if r + n <= room}
    return max(reach)


def test_each_sequence_has_the_least_slack():
    rng = random.Random(3)
    for _ in range(60):
        left = [rng.randrange(1, 200) for _ in range(rng.randrange(1, 25))]
        for take in packing.fill_windows(list(left), 200):
            got = sorted((n for n, c in take.items() for _ in range(c)), reverse=True)
            top = max(left)
            assert got[0] == top
            rest = list(left)
            rest.remove(top)
            assert sum(got) == top + best_sum(rest, 200 - top)
            for n in got:
                left.remove(n)
        assert not left


def test_pieces_cover_every_text_once(spark):
    rng = random.Random(8)
    rows = [(i, x) for i, x in enumerate(TEXTS)] + [(100 + i, sentences(rng, rng.randrange(900))) for i in range(60)]
    rows += [(90, None), (None, "null id"), (100, rows[20][1]), (100, rows[20][1]), (500, "word " * 6000)]
    out = packing.pack(frame(spark, rows), tokenizer_path(), group_rows=20).collect()
    coder = packing.Encoder.of(tokenizer_path())
    want = []
    for i, x in rows:
        ids = coder.encode(x or "") + b"\1\0\0\0"
        want += [(i, a, min(2048, len(ids) // 4 - a), zlib.crc32(ids[4 * a : 4 * (a + 2048)]), len(ids) // 4)
                 for a in range(0, len(ids) // 4, 2048)]
    assert sorted(map(str, [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out])) == sorted(map(str, want))
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.pack(frame(spark, rows).limit(0), tokenizer_path()).collect() == []


# ---------------------------------------------------------------- components, joins

def reach(nodes, links):
    out = {}
    for i in sorted(nodes):
        stack = [i]
        while stack:
            u = stack.pop()
            if u not in out:
                out[u] = i
                stack += links[u]
    return out


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(70)]
    links = {n: [] for e in edges for n in e}
    for a, b in edges:
        links[a].append(b)
        links[b].append(a)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = reach(links, links)
    assert got == {n: want[n] for n in links if any(m != n for m in links[n])}


def test_ngram_join_equals_all_pairs(spark):
    rng = random.Random(7)
    rows = []
    for i in range(50):
        base = sentences(rng, rng.randrange(30, 120), 3000).split()
        for c in range(rng.randrange(1, 5)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(999)}"
            rows.append((i * 10 + c, " ".join(copy)))
    rows += [(900, "three words here"), (901, "three words here"), (902, "three words"), (903, None), (904, ""), (905, "")]
    grams = {}
    for i, t in rows:
        w = (t or "").split()
        grams[i] = {tuple(w[a : a + 5]) for a in range(len(w) - 4)} or ({tuple(w)} if w else set())
    links = {i: [j for j in grams if j != i and grams[i] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])] for i in grams}
    out = ngram_join.link_texts(frame(spark, rows), block_members=2).collect()       # tiny blocks: pairs of blocks are used
    want = reach(links, links)
    assert {r.doc_id: (r.n_links, r.group_id, r.kept) for r in out} == {i: (len(links[i]), want[i], want[i] == i) for i in links}
    kept = ngram_join.keep_first(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in links if want[i] == i)
    assert kept.columns == frame(spark, rows).columns


def test_ngram_join_with_repeats_and_nulls(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (2, text), (3, text.replace("w30 ", "zz ")), (None, text), (7, None)]
    out = {(r.doc_id, r.n_links, r.group_id) for r in ngram_join.link_texts(frame(spark, rows)).collect()}
    assert out == {(1, 3, 1), (2, 3, 1), (3, 3, 1), (None, 0, None), (7, 0, 7)}
    assert sorted(str(r.doc_id) for r in ngram_join.keep_first(frame(spark, rows)).collect()) == ["1", "7", "None"]
    assert ngram_join.keep_first(frame(spark, rows).limit(0)).collect() == []


def test_banding_reaches_its_recall():
    b = ngram_join.banding(0.8, 0.9995, 5)
    assert 1 - (1 - 0.8**5) ** b >= 0.9995 > 1 - (1 - 0.8**5) ** (b - 1)


def test_vector_links_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(40):
        center = rng.standard_normal(16)
        for _ in range(rng.integers(1, 6)):
            rows.append((len(rows), (center + 0.15 * rng.standard_normal(16)).tolist(), int(c % 3)))
    rows += [(900, rows[0][1], 0), (901, rows[0][1], None), (902, None, 0), (903, [0.0] * 16, 0), (904, [float("nan")] * 16, 0),
             (905, [1.0, None] + [0.0] * 14, 0), (906, [float("inf")] * 16, 0), (907, rows[0][1][:8], 0), (908, [], 0), (None, rows[0][1], 0),
             (909, [-0.0] * 15 + [1.0], 1), (910, [0.0] * 15 + [2.0], 1)]
    df = spark.createDataFrame([(i, v, k, 1, "s") for i, v, k in rows], "vec_id long, embedding array<double>, label int, salt int, s string")
    good = {i: (np.array(v), k) for i, v, k in rows if i is not None and v and k is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: [] for i, *_ in rows}
    for i, (v, k) in good.items():
        for j, (w, m) in good.items():
            if i != j and k == m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                links[i].append(j)
    want = reach([i for i in links if i is not None], links)
    out = embed_dedup.link_vectors(df, block=8).collect()
    assert len(out) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in out if r.vec_id is not None} == {
        i: (len(links[i]), want[i]) for i in links if i is not None}
    assert all(r.kept == (r.vec_id == r.component_id) for r in out if r.vec_id is not None)
    assert embed_dedup.link_vectors(df.limit(0)).collect() == []


def test_calibrated_count():
    p = math.erf(1 / math.sqrt(2))
    tail = lambda t: sum(math.comb(48, c) * p**c * (1 - p) ** (48 - c) for c in range(t, 49))
    t = embed_dedup.calibrated_count(48, 1.0, 0.9995)
    assert tail(t) >= 0.9995 > tail(t + 1)
    a, b = np.random.default_rng(1).standard_normal((50, 4)), np.random.default_rng(2).standard_normal((60, 4))
    want = (np.abs(a[:, None, :] - b[None, :, :]) <= 0.5).sum(axis=2)
    assert (embed_dedup._collisions(a, b, 0.5) == want).all()


# ---------------------------------------------------------------- quality

def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = REGISTRY["op7_neighbour_voting"][0](spark, "/root/testdata/sf0.01")
    assert out.count() == docs.count()
    held = [r for r in out.join(labels, "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all(r.held_out for r in held)
    assert sum(r.predicted == r.quality for r in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in held)


def test_quality_ignores_labels_of_held_out_rows_and_takes_odd_texts(spark):
    rows = [(i, ("good words stand in a line. " if i % 2 else "BAD!! ||| ### ") * 20) for i in range(80)] + [
        (500, None), (501, ""), (None, "x"), (502, "z" * 100000), (1, "good words again")]
    labels = [(i, 1 if i % 2 else 0) for i in range(80)]
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels] + [(9999, 1), (3, None)]
    make = lambda x: quality.fit(frame(spark, rows), spark.createDataFrame(x, "doc_id long, quality int"))
    docs = frame(spark, rows).orderBy("doc_id", "text")
    a = quality.score(docs, make(labels)).collect()
    assert len(a) == len(rows) and all(0 <= r.score <= 1 for r in a)
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in a if r.doc_id is not None and r.doc_id < 80)
    model = make(labels)
    assert {r.doc_id: r.score for r in a if r.doc_id in (500, 501)} == {500: model["prior"], 501: model["prior"]}
    # labels of no document (9999, 5000..), null, repeated and contradictory ones change nothing either
    extra = [(i, 1) for i in range(5000, 5060)] + labels[:20] + [(2000, 0), (2000, 1), (501, 0), (501, 1)]
    other = make(flipped + extra)
    assert (other["latent"] == model["latent"]).all() and (other["votes"] == model["votes"]).all() and other["prior"] == model["prior"]
    none = quality.fit(frame(spark, rows), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).collect() == []


def test_votes_equal_brute_force():
    """Scores are the similarity-weighted shares of the exact nearest labelled vectors."""
    rng = np.random.default_rng(4)
    terms, rank, n = quality.TERMS + quality.EXTRA, 12, 300
    latent = rng.standard_normal((n, rank)).astype(np.float32)
    latent /= np.linalg.norm(latent, axis=1, keepdims=True)
    model = {"projection": rng.standard_normal((terms, rank)).astype(np.float32), "mean": rng.random(terms).astype(np.float32) / 50, "latent": latent,
             "votes": rng.integers(0, 2, n).astype(float), "weight": rng.choice([0.5, 2.0], n), "neighbours": 25, "prior": 0.4}
    x = rng.random((40, terms)).astype(np.float32)
    x[3] = 0
    got = quality.vote(model, x)
    for i, row in enumerate(x):
        if not row.any():
            assert got[i] == model["prior"]
            continue
        z = [sum(float(a - m) * float(p) for a, m, p in zip(row, model["mean"], column)) for column in model["projection"].T]
        length = math.sqrt(sum(v * v for v in z))
        cosine = [sum(a * float(b) for a, b in zip(z, v)) / length for v in latent]
        near = sorted(range(n), key=lambda k: -cosine[k])[:25]
        weights = [max(cosine[k], 0) ** quality.SHARPNESS * model["weight"][k] for k in near]
        assert abs(got[i] - sum(w * model["votes"][k] for w, k in zip(weights, near)) / sum(weights)) < 1e-3


# ---------------------------------------------------------------- WARC

def test_warc_round_trip(spark):
    big = random.Random(1).randbytes(9 << 20).hex()                       # one record of more than 16 MiB
    rows = [(1, "u", "x" * 2000), (2, "u", "x" * 2000), (3, None, "x" * 2000), (4, "v\r\nX: y", None), (5, "w", ""),
            (6, "w", "a\r\n\r\nWARC/1.1\r\n"), (7, "q", big), (8, "q", "é" * 600), (9, "q", "é" * 600), (None, "z", "x" * 2000),
            (10, "t", "short"), (11, "t", "short"), (12, "q", big), (3, None, "x" * 2000)]
    df = spark.createDataFrame([(*r, "d", 4) for r in rows], "page_id long, url string, html string, digest string, bytes int")
    out = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect())
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", 0), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = i is not None and len(b) >= 1000 and i != last[h or ""]
        want.append((str(i), len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", last[h] if revisit else None))
    assert out == sorted(want)
    assert warc.round_trip(df.limit(0)).collect() == []


def test_every_indexed_member_is_a_record(spark, tmpdir_path):
    import gzip
    df = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string")
    raw, out = f"{tmpdir_path}/raw", f"{tmpdir_path}/out"
    warc.write_monolithic(warc.classify(df), raw, 15)
    index = warc.normalise(spark, raw, out).orderBy("archive", "seq").collect()
    assert len(index) == 40
    files = {}
    for base, _, names in os.walk(out):
        for n in names:
            if n.startswith("part-"):
                files[re.search("archive=([^/]+)", base)[1]] = open(os.path.join(base, n), "rb").read()
    assert max(sum(r.archive == a for r in index) for a in files) <= 15
    whole = {a: gzip.decompress(x) for a, x in files.items()}             # any gzip reader takes the whole file
    for a in files:
        parts = [gzip.decompress(files[a][r.offset : r.offset + r.length]) for r in index if r.archive == a]
        assert b"".join(parts) == whole[a]
        assert all(p.startswith(b"WARC/1.1\r\n") and p.endswith(b"\r\n\r\n") for p in parts)


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline as c
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    columns, text = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in c.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "pii", "packing"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    good = c.written(c.keep_good(spark, docs, "/root/testdata/sf0.01"), "t")
    ids = {r.doc_id for r in good.collect()}
    assert good.columns == columns
    assert all((i in ids) == bool(q) for i, q in labels.items())
    single = c.written(c.keep_one_of_group(spark, good, ""), "t")
    grams = {}
    for i in ids:
        w = text[i].split()
        grams[i] = {tuple(w[a : a + 5]) for a in range(len(w) - 4)} or {tuple(w)}
    where = {}
    for i, g in grams.items():
        for x in g:
            where.setdefault(x, []).append(i)
    links = {i: [j for j in {j for x in g for j in where[x]} if j != i and len(g & grams[j]) >= 0.8 * len(g | grams[j])] for i, g in grams.items()}
    root = reach(links, links)
    assert {r.doc_id for r in single.collect()} == {i for i in ids if root[i] == i}
    clean = c.written(c.drop_contaminated(spark, single, "/root/testdata/sf0.01"), "t")
    items = [" ".join(r.text.split()) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    leaky = {r.doc_id for r in single.collect() if any(x in " ".join(r.text.split()) for x in items)}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - leaky
    hidden = c.written(c.redact_personal_data(spark, clean, ""), "t")
    assert hidden.columns == columns and hidden.count() == clean.count()
    assert not any(private_spans(r.text) for r in hidden.collect())
    assert hidden.where(F.length("text") != F.col("n_chars")).count() == 0
    pieces = c.pack_tokens(spark, hidden, "")
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in clean.collect()}


def test_every_operator_is_registered():
    import __spark_entry__ as e
    names = set(e.queries())
    assert {f"op{n}_" for n in range(1, 14)} <= {re.match(r"op\d+_", x)[0] for x in names if x.startswith("op")}
    assert "pipeline" in names
