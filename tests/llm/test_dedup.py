from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from minutespark.llm import exact_dedup, graph, simhash


def rows(spark, values):
    return spark.createDataFrame(values, "doc_id long, text string")


def test_fingerprints_compose():
    rng = random.Random(1)
    for n in (0, 1, 5, exact_dedup.CHUNK, exact_dedup.CHUNK + 3, 3 * exact_dedup.CHUNK + 17):
        data = rng.randbytes(n)
        x = 0
        for b in data:
            x = (x * exact_dedup.POINT + b + 1) % exact_dedup.PRIME
        assert exact_dedup.fingerprint(data) == x
        for cut in (0, n // 3, n):
            assert exact_dedup.combine(exact_dedup.fingerprint(data[:cut]), exact_dedup.fingerprint(data[cut:]), n - cut) == x
    assert exact_dedup.fingerprint(b"\x00") != exact_dedup.fingerprint(b"\x00\x00")


def test_huge_documents_are_hashed_in_parallel(monkeypatch):
    data = random.Random(2).randbytes(5 * exact_dedup.CHUNK)
    alone = exact_dedup.fingerprint(data)
    monkeypatch.setattr(exact_dedup, "HUGE", 10)
    assert exact_dedup.fingerprint(data) == alone


def brute(data):
    norm = [(i, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for i, t in data]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    return sorted((i, min(groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)


DATA = [(3, "a  b"), (1, "a\tb"), (2, "a b "), (4, None), (5, ""), (6, " "), (7, "\n\t"), (8, "é\x85x"), (9, "é\x85x"), (10, "a\xa0b")] + [(100 + i, "hot copy") for i in range(40)]


def test_exact(spark):
    found = exact_dedup.decisions(rows(spark, DATA).withColumn("row", F.lit(1)))
    got = found.collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute(DATA)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    kept = exact_dedup.exact_dedup(rows(spark, DATA).withColumn("fp", F.lit("clash")))
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({k for _, k, _, _ in brute(DATA)})
    assert exact_dedup.decisions(rows(spark, [])).isEmpty()


def test_exact_with_repeated_and_null_ids(spark):
    data = [(1, "x"), (1, "x"), (1, "y"), (None, "x"), (None, "z"), (None, "z")]
    got = exact_dedup.decisions(rows(spark, data)).collect()
    assert sum(r.kept for r in got) == 3
    left = sorted(map(tuple, exact_dedup.exact_dedup(rows(spark, data)).collect()), key=str)
    assert left == [(1, "x"), (1, "y"), (None, "z")]


def test_one_text_in_most_rows(spark, monkeypatch):
    """A hot text and many rows without an id: hot groups are broadcast, the others shuffled, none is lost."""
    monkeypatch.setattr("minutespark.llm.shared.HOT", 16)
    data = [(i if i % 3 else None, "the  same text" if i % 2 else f"text {i % 40}") for i in range(400)]
    got = sorted((r.doc_id or -1, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.decisions(rows(spark, data)).collect())
    sizes, least = defaultdict(int), {}
    norm = lambda t: re.sub("[ \t-\r]+", " ", t)
    for i, t in data:
        sizes[norm(t)] += 1
        if i is not None:
            least[norm(t)] = min(i, least.get(norm(t), i))
    want = sorted((i or -1, least.get(norm(t)), sizes[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in data)
    assert got == want


def test_colliding_fingerprints(spark, monkeypatch):
    """Texts of one fingerprint that differ are told apart."""
    df = exact_dedup._chunks
    batch = __import__("pyarrow").record_batch({"text": ["aa", "ab"]})
    monkeypatch.setattr(exact_dedup, "fingerprint", lambda data: 7)
    assert {(r["fp"], r["chunk"]) for b in df([batch]) for r in b.to_pylist()} == {(7, b"aa"), (7, b"ab")}
    parts = spark.createDataFrame([(7, 2, 0, bytearray(b"aa")), (7, 2, 0, bytearray(b"ab")), (8, 2, 0, bytearray(b"aa"))], "fp long, n_bytes long, pos long, chunk binary")
    odd = parts.groupBy("fp", "n_bytes", "pos").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most")).filter("least != most")
    assert [r.fp for r in odd.collect()] == [7]


def slow_fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall("[^\x20\x09-\x0d]+", t)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def root(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_simhash(spark):
    rng = random.Random(3)
    words = ["Alpha", "beta", "GAMMA", "É", "delta", "eps"]
    data = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(7)))) for i in range(150)] + [(200, None), (201, " \n"), (202, "x\x0cy")]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.families(rows(spark, data)).collect()}
    fps = {i: slow_fingerprint(t) for i, t in data}
    parent = {i: i for i in fps}
    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((root(parent, a), root(parent, b)))
                parent[y] = x
    assert got == {i: (f"{fps[i]:016x}", root(parent, i)) for i in fps}
    assert simhash.families(rows(spark, [])).isEmpty()


def test_links_of_crowded_blocks(spark):
    """Hundreds of fingerprints in one block: components equal brute force."""
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = set()
    for b in base:
        for _ in range(120):
            x = b
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    heads = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)], "id long, fp long")
    found = {r.node: r.component for r in graph.components(simhash.links(heads)).collect()}
    parent = {i: i for i in range(len(fps))}
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((root(parent, a), root(parent, b)))
                parent[y] = x
    assert {i: found.get(i, i) for i in parent} == {i: root(parent, i) for i in parent}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(50)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        x, y = sorted((root(parent, a), root(parent, b)))
        parent[y] = x
    want = {x: root(parent, x) for e in edges if e[0] != e[1] for x in e}
    assert found == want
    assert graph.components(spark.createDataFrame([], "u long, v long")).isEmpty()


def test_near_stage(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    texts = [[rng.choice(vocab) for _ in range(300)] for _ in range(40)]
    data = [(i, " ".join(t)) for i, t in enumerate(texts)]
    for i in range(40):
        near = list(texts[i % 10])
        for _ in range(3):
            near[rng.randrange(300)] = rng.choice(vocab)
        data.append((100 + i, " ".join(near)))
    data += [(500, None), (501, ""), (502, "short one"), (503, "short one")]
    kept = simhash.near_dedup(rows(spark, data).withColumn("u", F.lit("clash")))
    got = {r.doc_id for r in kept.collect()}
    # the empty texts are one family, the short ones another; near copies follow their originals
    assert kept.columns == ["doc_id", "text", "u"]
    assert set(range(40)) <= got and {500, 502} <= got and not {501, 503} & got
    assert len(got & set(range(100, 140))) <= 2
    assert all(simhash.alike(simhash.sketch(a), simhash.sketch(b)) >= 0.8 for a, b in [(data[0][1], data[0][1])])
    assert np.isclose(simhash.alike(simhash.sketch("a b c d e f"), simhash.sketch("a b c d e g")), 1 / 3)


def test_rows_without_an_id_still_tie_others(spark):
    """A and C lie four bits apart and meet through a fingerprint that only a row without an id holds."""
    base = simhash.majority(simhash.shingle_hashes("a b c"))
    rows = [(1, base), (None, base ^ 0b11), (2, base ^ 0b1111), (3, base ^ (0xFF << 40))]
    signed = [(i, fp - (1 << 64) if fp >> 63 else fp) for i, fp in rows]
    real = simhash.fingerprints
    try:
        simhash.fingerprints = lambda docs, width: spark.createDataFrame(signed, "doc_id long, fp long")
        got = {r.doc_id: r.component_id for r in simhash.families(None).collect()}
    finally:
        simhash.fingerprints = real
    assert got == {1: 1, 2: 1, 3: 3, None: None}


def test_near_dedup_keeps_distinct_texts_of_a_repeated_id(spark):
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80))
    one, two, three = text(), text(), text()
    docs = spark.createDataFrame([(1, one, "x"), (1, two, "x"), (1, two, "x"), (2, two + " end", "x"), (3, three, "x"), (None, one, "x")], "doc_id long, text string, __first string")
    got = simhash.near_dedup(docs)
    assert got.columns == docs.columns
    left = sorted((r.doc_id or 0, r.text) for r in got.collect())
    # the second text of id 1 is alike to that of id 2, whose id is the smaller node
    assert left == sorted([(1, one), (2, two + " end"), (3, three), (0, one)])
