from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from minutespark.llm import mixing, topk


def test_top_k(spark):
    rng = random.Random(1)
    data = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    data += [(900 + i, data[0][1]) for i in range(20)]  # ties
    data += [(1000, None), (1001, [float("nan")] * 8), (1002, [1.0, None] * 4), (1003, [float("inf")] * 8), (1004, [1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    v = df.select("vec_id", topk.quantized(F.col("embedding")).alias("v")).filter("v is not null")
    got = topk.top_k(v, v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v"), 5, tile=40, block=3)
    ints = {i: [math.floor(256 * x) for x in e] for i, e in data if e and all(x is not None and math.isfinite(x) for x in e)}
    want = []
    for q in ints:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(ints[q], ints[c], strict=True)), c) for c in ints if c != q and len(ints[c]) == len(ints[q]))[:5]
            want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(v.limit(0), v.limit(0).select(F.col("vec_id").alias("query_id"), "v")).isEmpty()


def test_top_k_of_large_numbers(spark):
    """Products beyond what floats hold exactly."""
    big = [[(1 << 28) + 1, 3], [(1 << 28) - 5, 7], [1, 1 << 29]]
    df = spark.createDataFrame(list(enumerate(big)), "vec_id long, v array<long>")
    got = topk.top_k(df, df.select(F.col("vec_id").alias("query_id"), "v"), 2).collect()
    assert {(r.query_id, r.vec_id): r.score for r in got} == {(a, b): sum(x * y for x, y in zip(big[a], big[b], strict=True)) for a in range(3) for b in range(3) if a != b}


def test_tree_of_tiles(spark):
    """Several levels of merging, with repeated rows: the same result, and no place sees more lists than a branch has."""
    rng = random.Random(6)
    data = [(i, [rng.randrange(-9, 9) for _ in range(4)]) for i in range(400)] + [(7, [8, 8, 8, 8])] * 60
    df = spark.createDataFrame(data, "vec_id long, v array<long>").repartition(3).withColumn("tile", F.lit("clash"))
    queries = df.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v")
    found = topk.top_k(df, queries, 5, tile=8, block=4, fan=3)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("row_number") >= 4
    want = []
    for q, x in data:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), c) for c, y in data if c != q)[:5]
            want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores)]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_scores_beyond_64_bits_are_an_error(spark):
    df = spark.createDataFrame([(1, [1 << 40]), (2, [1 << 40])], "vec_id long, v array<long>")
    with pytest.raises(Exception, match="OverflowError"):
        topk.top_k(df, df.select(F.col("vec_id").alias("query_id"), "v"), 2).collect()


def corpus(spark):
    rng = random.Random(2)
    data = [(i, f"s{min(i % 9, 3)}", " ".join(["w"] * rng.randrange(60))) for i in range(900)] + [(2000, None, "null source words"), (2001, "empty", ""), (2002, "empty", None)]
    return data, spark.createDataFrame(data, "doc_id long, source string, text string")


def brute_mix(rows, weights, budget):
    """How often each (doc_id, place) is dealt; ``rows``: doc_id, source, tokens, place."""
    per = Counter()
    for _, s, n, _ in rows:
        per[s] += n
    out = Counter()
    for s, n in per.items():
        part = budget * weights.get(s, 0) / n if n else 1.0
        if n and not weights.get(s, 0):
            continue
        whole = math.floor(part + 1e-6)
        room = round(max(0.0, part - whole) * n)
        own = sorted((p, i, t) for i, x, t, p in rows if x == s)
        for p, i, _ in own:
            out[i, p] += whole
        taken = 0
        for p, i, t in own:
            if taken + t > room or room == 0:
                break
            taken += t
            out[i, p] += 1
    return +out


@pytest.mark.parametrize(("bits", "edge"), [(10, 1 << 20), (3, 200), (2, 1)])
def test_mix(spark, monkeypatch, bits, edge):
    """Weights against the exponent's definition, and each row's epochs against brute force, at every depth of cutting."""
    monkeypatch.setattr(mixing, "BITS", bits)
    monkeypatch.setattr(mixing, "EDGE", edge)
    data, df = corpus(spark)
    df = df.withColumns({"weight": F.lit("clash"), "epoch": F.lit("clash")})
    got = mixing.mix(df).collect()
    counts = Counter()
    for _, s, t in data:
        counts[s] += len((t or "").split())
    most = {s: n for s, n in counts.items() if n}
    total = sum(most.values())
    a = 1 - math.log(mixing.MAX_REPEAT) / math.log(max(most.values()) / min(most.values()))
    z = sum((n / total) ** a for n in most.values())
    weights = {s: (n / total) ** a / z for s, n in most.items()}
    for r in got:
        assert math.isclose(r["__weight"], weights.get(r.source, 0), rel_tol=1e-9)
    place = {r.doc_id: r.p for r in df.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.lit(mixing.SEED), "doc_id", "source", "text"), 24).alias("p")).collect()}
    rows = [(i, s, len((t or "").split()), place[i]) for i, s, t in data]
    budget = max(math.ceil(n / weights[s]) for s, n in most.items())
    want = brute_mix(rows, weights, budget)
    assert {k: n for k, n in Counter((r.doc_id, place[r.doc_id]) for r in got).items()} == want
    assert {i for i, _ in want} == {i for i, _, _ in data}  # every document once at least
    # permutations: no document comes twice in an epoch, and epochs differ in their order
    assert len({(r.doc_id, r["__epoch"]) for r in got}) == len(got)
    order = [[r.doc_id for r in sorted(got, key=lambda r: (r["__order"], r["__place"])) if r["__epoch"] == e and r.source == "s0"] for e in (0, 1)]
    again = [i for i in order[0] if i in set(order[1])]
    assert len(again) < 5 or again != order[1]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df).collect()))


def test_mix_joins_many_sources(spark, monkeypatch):
    data, df = corpus(spark)
    want = sorted(map(str, mixing.mixed(df).collect()))
    monkeypatch.setattr(mixing, "FEW", 1)
    monkeypatch.setattr(mixing, "HOT", 3)
    assert sorted(map(str, mixing.mixed(df).collect())) == want


def test_mix_by_given_weights_and_budget(spark):
    data, df = corpus(spark)
    got = mixing.mix(df, {"s0": 1, "s3": 3}, budget=9000).collect()
    dealt = Counter()
    for r in got:
        dealt[r.source] += r["__tokens"]
    assert set(dealt) == {"s0", "s3", "empty"}
    assert 2200 <= dealt["s0"] <= 2250 and 6690 <= dealt["s3"] <= 6750


def test_repeated_rows_and_very_long_texts_are_dealt(spark):
    data = [(1, "a", "w " * 300_000), *[(2, "a", "x y")] * 40, *[(None, "b", "z")] * 40, (3, "b", None)]
    df = spark.createDataFrame(data, "doc_id long, source string, text string")
    got = Counter(r.doc_id for r in mixing.mixed(df).collect())
    assert got[1] == 1 and got[2] == 40 and got[None] >= 40 and got[3] >= 1


def test_exponent(spark):
    sources = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10), ("d", 0)], "source string, n long")
    assert mixing.find_exponent(sources) == 1.0
    a = mixing.find_exponent(sources, max_repeat=2)
    assert math.isclose(mixing.repetition(mixing.temperature(sources, a)), 2, rel_tol=1e-9)
    a = mixing.find_exponent(sources, target_entropy=0.8)
    assert math.isclose(mixing.entropies(sources, [a])[0], 0.8, rel_tol=1e-9)
    weights = [r.weight for r in mixing.temperature(sources, a).collect() if r.weight]
    assert math.isclose(-sum(w * math.log(w) for w in weights), 0.8, rel_tol=1e-9)
    assert mixing.find_exponent(sources, max_repeat=1e9) == 0.0
    both = mixing.find_exponent(sources, max_repeat=2, target_entropy=0.8)
    assert both == max(a, mixing.find_exponent(sources, max_repeat=2))


@pytest.mark.parametrize("values", [[], [(1, "s", "")], [(1, "s", None), (1, None, None)]])
def test_mix_without_tokens(spark, values):
    df = spark.createDataFrame(values, "doc_id long, source string, text string")
    assert mixing.mixed(df).count() == len(values)
