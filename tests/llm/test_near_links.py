from __future__ import annotations

import random

import numpy as np
import pytest

from minutespark.llm import simhash


def rows(spark, values):
    return spark.createDataFrame(values, "doc_id long, text string")


def make(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def found(spark, docs):
    links = simhash.near_links(rows(spark, [(i, " ".join(w)) for i, w in docs.items()])).collect()
    return {(max(r.u, r.v), min(r.u, r.v)) for r in links}


def test_long_pairs_are_verified_whole(spark):
    """Single words changed until a long pair is just above or just below 0.8: only the former link."""
    rng = random.Random(11)
    docs, want = {}, set()
    for i in range(60):
        base = make(rng, rng.randrange(700, 1500))
        copy = list(base)
        places = iter(rng.sample(range(len(base)), len(base)))
        above = list(copy)
        while jaccard(base, copy) >= 0.8:
            above = list(copy)
            copy[next(places)] = make(rng, 1)[0]
        docs[2 * i] = base
        docs[2 * i + 1] = above if i % 2 else copy
        if i % 2:
            want.add((2 * i + 1, 2 * i))
    assert found(spark, docs) == want


def brute(docs):
    ids = sorted(docs)
    return {(b, a) for i, a in enumerate(ids) for b in ids[i + 1 :] if jaccard(docs[a], docs[b]) >= 0.8}


def test_added_and_replaced_passages(spark):
    """Passages of other texts, appended, put before or in the place of others: all pairs of brute force."""
    rng = random.Random(12)
    vocab = make(rng, 3000)
    docs = {}
    for i in range(120):
        base = [rng.choice(vocab) for _ in range(rng.randrange(40, 900))]
        n = len(base)
        other = [rng.choice(vocab) for _ in range(int(n * rng.uniform(0.1, 0.3)))]
        at = rng.randrange(n - len(other) // 2)
        docs[2 * i] = base
        docs[2 * i + 1] = [base + other, other + base, base[:at] + other[: len(other) // 2] + base[at + len(other) // 2 :]][i % 3]
    assert len(brute(docs)) > 60
    assert found(spark, docs) == brute(docs)


def test_prefixes_of_alike_sets_meet():
    rng = random.Random(13)
    import numpy as np

    for _ in range(2000):
        both = rng.randrange(1, 60)
        a, b = rng.randrange(both // 8 + 2), rng.randrange(both // 8 + 2)
        if both < 0.8 * (both + a + b):
            continue
        pool = rng.sample(range(1000), both + a + b)
        x, y = (np.array(sorted(p), dtype=np.uint64) for p in (pool[: both + a], pool[:both] + pool[both + a :]))
        common = np.array(sorted(rng.sample(range(1000), 300)), dtype=np.uint64)
        rank = np.array([rng.randrange(2, 9) for _ in common])
        for order in ((common, rank), (common[:0], rank[:0])):
            assert set(simhash.prefix(x, *order).tolist()) & set(simhash.prefix(y, *order).tolist())


@pytest.mark.parametrize("sample", [20_000, 100, 1])
def test_links_do_not_depend_on_the_number_of_rows(spark, monkeypatch, sample):
    """The same links where the sample of common shingles covers all, some or none of the rows."""
    monkeypatch.setattr(simhash, "SAMPLE", sample, raising=False)
    monkeypatch.setattr(simhash, "COMMON", 50, raising=False)
    monkeypatch.setattr(simhash, "wide_bits", lambda n: 32, raising=False)
    rng = random.Random(14)
    docs, line = {}, make(rng, 30)
    for i in range(100):
        base = make(rng, rng.randrange(20, 300)) + line
        copy = list(base)
        for at in rng.sample(range(len(base)), max(1, len(base) // rng.randrange(30, 70))):
            copy[at] = make(rng, 1)[0]
        docs[2 * i], docs[2 * i + 1] = base, copy
    assert len(brute(docs)) > 50
    assert found(spark, docs) == brute(docs)


def test_common_shingles_are_counted_in_all_rows(spark, monkeypatch):
    """Of 200 rows every one is counted: the total is exact, and the shared line ranks above all else."""
    monkeypatch.setattr(simhash, "SAMPLE", 20, raising=False)
    rng = random.Random(16)
    line = make(rng, 30)
    texts = [" ".join(make(rng, 40) + line) for _ in range(200)]
    common = simhash.common_shingles(rows(spark, list(enumerate(texts))).repartition(3))
    sets = [set(simhash.shingle_hashes(t, simhash.WORDS).tolist()) for t in texts]
    assert common.shingles == sum(map(len, sets)) / 5
    both = np.array(sorted(set.intersection(*sets)), dtype=np.uint64)
    rest = np.array(sorted(set.union(*sets) - set(both.tolist())), dtype=np.uint64)
    assert len(both) == 26 and common.hot[simhash.bucket(both)].all()
    assert common.hot.sum() == 26 and (common.rank[simhash.bucket(both)] > 50).all()
    assert (common.rank[simhash.bucket(rest)] > 50).mean() < 0.01


def parts(ids, pairs):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("hubs", "block"), [(4, 256), (1, 7)])
def test_crowded_groups_lose_no_pair(spark, monkeypatch, hubs, block):
    """A family whose members drift far from any few of it, and small families that share its shingles."""
    monkeypatch.setattr(simhash, "HUBS", hubs)
    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    monkeypatch.setattr(simhash, "COMMON", 0, raising=False)  # common shingles stand in the prefixes
    rng = random.Random(15)
    core = make(rng, 120)
    docs, tail = {}, make(rng, 80)
    for i in range(120):
        docs[i] = core + tail
        tail = list(tail)
        at = rng.randrange(0, 72)
        tail[at : at + 8] = make(rng, 8)
    for i in range(200, 260, 2):
        tail = make(rng, 70)
        docs[i], docs[i + 1] = core + tail, core + tail[:-6] + make(rng, 8)
    want = brute(docs)
    assert 150 < len(want)
    assert parts(docs, found(spark, docs)) == parts(docs, want)
