from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from minutespark.llm import bpe, packing, shared, token_files
from minutespark.llm.shared import stored, table_path


def rows(spark, values):
    return spark.createDataFrame(values, "doc_id long, text string")


def test_encoder_equals_library():
    e = bpe.Encoder(bpe.default_tokenizer(), cache_parts=50)
    rng = random.Random(1)
    letters = list(" \n\t\x0b\x1c  ab,.'s1é日\r\x00!") + ["word", " the", "\n\n", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(16))) for _ in range(3000)] + [None, "", "a b\nc d."]
    for _ in range(2):  # the second time from the cache
        for t, got in zip(texts, e.encode(texts), strict=True):
            assert list(got) == e._tok.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_distinct_parts_are_encoded_in_joined_runs():
    """The library gets a string for many parts, not one for each; ids stay those of the whole texts."""
    e = bpe.Encoder(bpe.default_tokenizer())
    rng = random.Random(5)
    letters = "abcdefgh'é日Ġ9_-.\u0301"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) for _ in range(6000)]
    texts = ["".join(w + rng.choice(["", ".", ",\n", '").']).rstrip("\n") + rng.choice(" \n") for w in words[i : i + 300]).strip() for i in range(0, 6000, 300)]
    handed = []

    class Counting:
        def __init__(self, tok):
            self.tok = tok

        def encode_batch_fast(self, batch, **named):
            handed.extend(batch)
            return self.tok.encode_batch_fast(batch, **named)

    library, e._tok = e._tok, Counting(e._tok)
    got = e.encode(texts)
    for t, ids in zip(texts, got, strict=True):
        assert list(ids) == library.encode(t, add_special_tokens=False).ids, t
    assert len(handed) < 300


def brute(texts, end=0):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_tokenizer())
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_round_trip(spark):
    data = [(5, "five words of plain text"), (1, "one " * 900), (3, None), (2, ""), (1, "one again"), (None, "no id")]
    df = rows(spark, data).withColumn("start", F.lit("clash"))
    manifest = token_files.write_token_files(df, table_path(spark, "t"), length=16)
    got = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(spark, manifest).collect()}
    order = sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    at, want = 0, {}
    for (i, _), ids in zip(order, brute([t for _, t in order]), strict=True):
        want[i, at] = (len(ids), crc(ids))
        at += len(ids)
    assert got == want
    # random access without copies
    first = manifest.orderBy("part").first()
    f = token_files.TokenFile(first.path)
    ids, mask = f.sequence(0)
    assert len(ids) == len(mask) == 16 and not ids.flags.owndata
    assert token_files.write_token_files(rows(spark, []), table_path(spark, "t")).isEmpty()


def test_pack(spark):
    rng = random.Random(2)
    data = [(i, "word " * rng.randrange(90)) for i in range(80)] + [(0, "repeated"), (99, None), (7, "long " * 700), (None, "x")]
    found = packing.pieces(rows(spark, data).repartition(3), 64)

    got = packing.pack(stored(found, "p"), 64, islands=2, rounds=2).collect()
    want = []
    for (i, _), ids in zip(data, brute([t for _, t in data]), strict=True):
        want += [(i, p, s, n, crc(ids[s : s + n])) for p, (s, n) in enumerate(packing.cut(len(ids), 64))]
    assert sorted(map(str, [tuple(r)[:5] for r in got])) == sorted(map(str, want))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64
    assert len(bins) <= -(-sum(n for b in bins.values() for _, n in b) // 64) + 2
    assert packing.pack(stored(packing.pieces(rows(spark, [])), "p")).isEmpty()


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(3, 4) == [(0, 3)] and packing.cut(4, 4) == [(0, 4)]


def test_genetic_algorithm_keeps_every_piece():
    rng = random.Random(4)
    for n in (1, 7, 300):
        counts = [0] * 101
        for _ in range(n):
            counts[rng.randrange(1, 101)] += 1
        a, b = (packing.best_fit(counts, 100, random.Random(s), 0.2) for s in (1, 2))
        child = packing.crossover(a, b, counts, 100, rng)
        for g in (a, b, child, packing.evolve([], counts, 100, 3, 4, 10)[0]):
            used = [0] * 101
            for p, m in g.items():
                assert sum(p) <= 100
                for x in p:
                    used[x] += m
            assert used == counts
        assert packing.fitness(packing.evolve([], counts, 100, 0, 4, 10)[0], 100) >= packing.fitness(packing.best_fit(counts, 100, rng), 100)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_evolution_beats_best_fit_where_that_misses_the_bound(spark, seed):
    """Lengths cut from full sequences in threes, which best fit takes apart wrongly."""
    rng = random.Random(seed)
    counts = [0] * 401
    for _ in range(150):
        a = rng.randrange(152, 196)
        b = rng.randrange(100, (400 - a) // 2 + 1)
        for n in (a, b, 400 - a - b):
            counts[n] += 1
    first = random.Random(3)
    plain = min(sum(packing.best_fit(counts, 400, first, 0.05 * (1 + first.random())).values()) for _ in range(6))
    assert plain > packing.lower_bound(counts, 400) == 150
    found = packing.pack_histogram(spark, counts, 400, islands=2, rounds=2, size=6, births=60)
    assert sum(found.values()) < plain
    used = Counter()
    for p, m in found.items():
        assert sum(p) <= 400
        for n in p:
            used[n] += m
    assert all(used[n] == c for n, c in enumerate(counts) if c)


def test_scratch_is_cleared(spark):
    before = stored(spark.range(3), "x")
    shared.clear(spark)
    with pytest.raises(Exception, match="NOT_EXIST|does not exist"):
        before.collect()
    assert stored(spark.range(3), "x").count() == 3
