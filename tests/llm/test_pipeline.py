from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from minutespark.llm import bpe, catalog, packing

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are absent")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    from minutespark.llm.shared import stored

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, DATA), name)
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] <= sizes[4]
    packed = stored(corpus_pipeline.STAGES[-1][1](spark, docs, DATA), "packed")
    # every token of every document is packed once
    e = bpe.Encoder(bpe.default_tokenizer())
    want = sum(len(x) + 1 for x in e.encode([r.text for r in docs.select("text").collect()]))
    assert packed.agg(F.sum("length")).first()[0] == want
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert fill.filter("n > 2048").isEmpty()
    counts = [0] * 2049
    for r in packed.collect():
        counts[r.length] += 1
    assert fill.count() <= packing.lower_bound(counts, 2048) * 1.02 + 1


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES if n[:2] == "op" and n[2].isdigit()) == list(range(1, 11))
    # the others show what SQL can express of these
    assert {n for n in catalog.QUERIES if not n.startswith("op")} <= set(catalog.ORACLES)
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_against_brute_force(spark, tmp_path):
    """Planted toxic documents, exact and near copies go; every other document is packed, whole."""
    import random
    import zlib
    from collections import defaultdict

    import numpy as np

    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(4000)]
    clean = {i: [rng.choice(vocab) for _ in range(rng.randrange(150, 400))] for i in range(140)}
    docs = [(i, " ".join(w), "en", f"s{min(i % 8, 3)}") for i, w in clean.items()]
    toxic = {i: [rng.choice(vocab) for _ in range(200)] + rng.sample(["vileword", "badinsult", "nastyterm"], 2) for i in range(200, 290)}
    docs += [(i, " ".join(w), "en", "s0") for i, w in toxic.items()]
    docs += [(300 + i, " ".join(clean[i % 5]).replace(" ", "\t \n"), "en", "s1") for i in range(30)]
    for i in range(30):
        near = list(clean[10 + i % 3])
        near[rng.randrange(len(near))] = rng.choice(vocab)
        docs.append((400 + i, " ".join(near), "en", "s2"))
    rows = spark.createDataFrame([(*d, len(d[1])) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    rows.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(i in toxic)) for i in [*clean, *toxic]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(clean)
    e = bpe.Encoder(bpe.default_tokenizer())
    ids = {i: np.append(x.astype("<u4"), np.uint32(0)) for (i, *_), x in zip(docs, e.encode([d[1] for d in docs]), strict=True)}
    times, bins = defaultdict(int), defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length])
        times[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    # each document whole, once or twice
    assert all(n in (len(ids[i]), 2 * len(ids[i])) for i, n in times.items())
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
