"""Toxicity: a factorization machine over hashed terms.

A document is the set of its terms: words (lower case, outer punctuation cut) and
the first four and five letters of longer ones, hashed into ``BUCKETS``.  The
machine adds a weight for each term and, through low-rank factors, one for each
pair of terms, so that an insult beside a group mention can weigh more than both.  The
pairs of a document of k terms are divided by k - 1, so that long texts weigh no more.
It learns from a bounded sample of the labelled documents (``POSITIVES`` and
``NEGATIVES``, in the order of a hash of the id).  Terms are screened twice: those that
toxic documents of the sample hold more often, and their partners, which toxic
documents that hold such a term hold more often than clean ones that do, however
common they are in clean text.  Every document is scored.

Null and empty texts have no terms and get the score of the intercept.  Without
labelled toxic documents every score is the prior.  Null ids are scored, and take
no part in learning; of an id's labels the largest counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_sample, documents, give_back, require, tidy

BUCKETS = 1 << 20
#: Most labelled documents that the machine learns from.
POSITIVES, NEGATIVES = 2500, 7500
#: Terms that pass the screening at most, and the fewest toxic documents that hold one.
TERMS, SUPPORT = 4096, 3
#: Partners at most, and how many standard errors their rates must differ by.
PARTNERS, APART = 512, 4.0
FACTORS, ROUNDS, RATE, DECAY = 4, 250, 0.1, 5e-5
THRESHOLD = 0.7
_OUTER = ".,;:!?%$&*#|()[]{}<>\"'`~_-+=/\\"


def terms(text: str | None) -> np.ndarray:
    """Distinct buckets of a text's terms."""
    crc, found = zlib.crc32, set()
    for w in {w.strip(_OUTER) for w in (text or "").lower().split()}:
        found.add(crc(w.encode("utf-8", "replace")))
        if len(w) > 4:
            found.add(crc(w[:4].encode("utf-8", "replace"), 4))
            if len(w) > 5:
                found.add(crc(w[:5].encode("utf-8", "replace"), 5))
    found.discard(0)  # the empty word
    return np.unique(np.fromiter(found, dtype=np.int64, count=len(found)) & (BUCKETS - 1))


@dataclass
class Machine:
    """Score = sigmoid(bias + sum of weights + sum over pairs of <v_i, v_j>)."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def lookup(self) -> np.ndarray:
        table = np.full(BUCKETS, -1, dtype=np.int32)
        table[self.buckets] = np.arange(len(self.buckets))
        return table

    def score(self, at: np.ndarray) -> float:
        """Of a document that holds the terms numbered ``at``."""
        v = self.factors[at]
        z = self.bias + self.weights[at].sum() + 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum()) / max(1, len(at) - 1)
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def _rates(docs: list[np.ndarray], toxic: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """By class (clean, toxic): documents that hold each bucket, and their smoothed share; how far the shares' logarithms lie apart."""
    count = [np.bincount(np.concatenate([d for d, t in zip(docs, toxic, strict=True) if t == y] or [np.empty(0, np.int64)]), minlength=BUCKETS) for y in (0, 1)]
    n = [max(1, int((toxic == y).sum())) for y in (0, 1)]
    p = [(c + 0.5) / (m + 1) for c, m in zip(count, n, strict=True)]
    return count, p, np.log(p[1] / p[0]) / np.sqrt(1 / (count[1] + 0.5) + 1 / (count[0] + 0.5))


def screen(docs: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Buckets that toxic documents hold more often, the most telling first, and their partners."""
    count, p, lift = _rates(docs, toxic)
    lift[(count[1] < min(SUPPORT, int(toxic.sum()))) | (p[1] < 3 * p[0])] = 0
    order = np.argsort(-lift, kind="stable")[:TERMS]
    telling = np.sort(order[lift[order] > 1.5])
    # among documents with a telling term: what else toxic ones hold more often
    beside = [i for i, d in enumerate(docs) if len(np.intersect1d(d, telling, assume_unique=True))]
    count, p, lift = _rates([docs[i] for i in beside], toxic[beside])
    lift[(count[1] < SUPPORT) | (p[1] < 1.5 * p[0])] = 0
    lift[telling] = 0
    order = np.argsort(-lift, kind="stable")[:PARTNERS]
    return np.union1d(telling, order[lift[order] > APART])


def learn(docs: list[np.ndarray], toxic: np.ndarray, shares: tuple[float, float], seed: int = 0) -> Machine:
    """AdaGrad on the weighted log loss; ``shares``: rows that a sampled clean, toxic one stands for."""
    prior = (toxic * shares[1]).sum() / max(1e-9, ((1 - toxic) * shares[0] + toxic * shares[1]).sum()) if len(toxic) else 0.0
    bias = float(np.log(max(prior, 1e-4) / max(1 - prior, 1e-4)))
    empty = Machine(bias, np.empty(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))
    if not toxic.any() or toxic.all():
        return empty
    buckets = screen(docs, toxic)
    if not len(buckets):
        return empty
    m = Machine(bias, buckets, np.zeros(len(buckets)), np.random.default_rng(seed).normal(0, 0.01, (len(buckets), FACTORS)))
    table = m.lookup()
    held = [table[d][table[d] >= 0] for d in docs]
    size = np.array([len(h) for h in held])
    pairs = 1 / np.maximum(1, size - 1)
    weight = np.where(toxic, shares[1], shares[0]) / np.where(toxic, shares[1], shares[0]).sum()
    row, col = np.repeat(np.arange(len(docs)), size), np.concatenate(held)
    del docs, held
    gw, gv, gb = np.full(len(buckets), 1e-6), np.full(m.factors.shape, 1e-6), 1e-6
    for _ in range(ROUNDS):
        v = m.factors[col]
        s = np.zeros((len(toxic), FACTORS))
        np.add.at(s, row, v)
        q = np.bincount(row, (v**2).sum(axis=1), len(toxic))
        z = m.bias + np.bincount(row, m.weights[col], len(toxic)) + 0.5 * ((s**2).sum(axis=1) - q) * pairs
        g = weight * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - toxic)
        dw = np.bincount(col, g[row], len(buckets)) + DECAY * m.weights / 100
        dv = np.zeros_like(m.factors)
        np.add.at(dv, col, (g * pairs)[row, None] * (s[row] - v))
        dv += DECAY * m.factors
        gw, gv, gb = gw + dw**2, gv + dv**2, gb + g.sum() ** 2
        m.weights -= RATE * 2 * dw / np.sqrt(gw)
        m.factors -= RATE * dv / np.sqrt(gv)
        m.bias -= RATE * g.sum() / np.sqrt(gb)
    return m


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[list[np.ndarray], np.ndarray, tuple[float, float]]:
    """Terms and labels of at most POSITIVES + NEGATIVES documents, whatever the tables hold."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("y")).filter(~held_out(F.col("label_id")))
    totals = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    first = [bounded_sample(known.filter(F.col("y") == y), "label_id", n) for y, n in ((1, POSITIVES), (0, NEGATIVES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("label_id"), b.column("y"), pa.array([terms(t.as_py()).astype(np.int32) for t in b.column("text")], pa.list_(pa.int32()))], ["label_id", "y", "terms"])

    # of texts that repeat an id one learns, whichever task comes first
    one = F.min(F.struct("y", "terms")).alias("one")

    chosen = F.broadcast(first[0].unionByName(first[1]))  # at most 10,000 rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, F.col("doc_id") == F.col("label_id"))
    got = texts.select("label_id", "y", "text").mapInArrow(tidy(run), "label_id long, y int, terms array<int>").groupBy("label_id").agg(one).select("label_id", "one.*").toArrow().sort_by("label_id")
    toxic = got.column("y").to_numpy().astype(np.int64)
    lists = got.column("terms").combine_chunks()
    flat, cuts = lists.flatten().to_numpy(), (lists.offsets.to_numpy() - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int64))
    found = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    taken = {y: max(1, int((toxic == y).sum())) for y in (0, 1)}
    return found, toxic, tuple(max(1.0, totals.get(y, 0) / taken[y]) for y in (0, 1))


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    require(docs, ["doc_id", "text"])
    require(labels, ["doc_id", "toxic"])
    machine = learn(*_sample(docs, labels))
    give_back()
    return machine


def scores(docs: DataFrame, machine: Machine, name: str = "toxicity") -> DataFrame:
    """All columns of ``docs``, with the score (0 to 1) last, in the place of any of its name; one scan, no shuffle."""
    made, docs = {}, docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = made.setdefault("table", machine.lookup())
        for b in batches:
            out = []
            for t in b.column(b.schema.get_field_index("text")):
                at = table[terms(t.as_py())]
                out.append(machine.score(at[at >= 0]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, name])

    schema = docs.withColumn(name, F.lit(0.0)).schema
    return docs.mapInArrow(tidy(run), schema)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score stays below THRESHOLD, with the columns they came with."""
    return scores(docs, train(docs, labels), "__toxicity").filter(F.col("__toxicity") < THRESHOLD).drop("__toxicity")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = scores(docs.select("doc_id", "text"), train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLES: dict[str, str] = {}
