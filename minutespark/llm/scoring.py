"""Language-model scoring: a log-bilinear neural model trained by noise contrast.

Tokens are words between white space, A-Z lowered, and one end a document.  A token's
probability is factored: of its class after the classes of the two tokens before it,
and of the token within its class after the class of the token before it.  The most
frequent words and the end are classes of their own; the others are dealt to classes
by their last two bytes, which makes every product below a bounded table.

Both factors are log-bilinear.  A context (a, b) gives the vector A[a] + B[b], a class
c the score (A[a] + B[b]) . R[c] + bias[c]; within a class the context b gives V[b], a
word w the score V[b] . W[w] + bias[w].  The ``VOCABULARY`` most frequent words have
vectors of their own; in each class one more stands for the words beyond them, whose
counts smoothed by 0.1 decide among them.  Batched matrix products over all contexts
give the logarithms of the sums, so every probability is normalised.

Everything counted covers the whole training part of the corpus: words, triples of
classes, and pairs of a class and a word, by shuffles that grow with the text.
Noise-contrastive estimation draws its positives from these counts.  The triples are
descended in shards that average their parameters after each round; the classes of
words are dealt to shards that share no word.  The number of draws is fixed
(``ROUNDS`` * ``STEPS`` * ``BATCH`` a shard), as that of the parameters is.

Only the ``FREQUENT`` words, of bounded number, are broadcast; counts of the others
are joined to the documents.  Texts are cut into words twice: to count them, and to
write them as numbers, which all later passes read.

Null and empty texts have the end alone.  Repeated rows count each time; null ids
are scored and belong to training.  An empty table gives no rows.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import HOT, documents, require, stored, tidy

#: Classes: single words (with the end) and groups of the others.
HEADS, TAILS = 192, 64
CLASSES = HEADS + TAILS
#: Numbers of a class's and of a word's vector.
DIM, WORD_DIM = 32, 16
#: Words with vectors of their own.
VOCABULARY = 1 << 16
#: Words whose counts are broadcast (their bytes bounded as well); the others are joined.
FREQUENT, LONGEST = 1 << 18, 40
#: Shards of the descent, rounds of averaging, and steps of a round.
SHARDS, ROUNDS, STEPS, BATCH, NOISE, RATE = 6, 3, 500, 1024, 64, 0.15
#: Steps within classes, positives of a step, and noise words of each.
WORD_STEPS, WORD_BATCH, WORD_NOISE, WORD_RATE = 600, 1024, 5, 0.5
#: Distinct words a task holds before it hands on their counts.
HELD = 400_000
#: Keys counted, and tokens scored, at once.
COUNTED, SCORED = 1 << 22, 1 << 17
SMOOTH = 0.1


def words(text: str | None) -> list[bytes]:
    """bytes.lower() lowers A-Z alone; bytes.split() cuts at 20 and 09-0D."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def tail_class(word: bytes) -> int:
    return HEADS + zlib.crc32(word[-2:]) % TAILS


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


# --- counts


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; each task counts before it shuffles.  The end is not among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                held.update(words(t.as_py()))
                if len(held) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
                    held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(tidy(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What the driver keeps of the counts: bounded by FREQUENT words.

    A word's number is its rank.  Classes: 0 is the end, 1 to HEADS - 1 the first
    words, the others groups.
    """

    words: list[bytes]
    counts: np.ndarray
    n: int  # tokens, ends included
    v: int  # distinct tokens, the end included
    ends: int
    class_n: np.ndarray  # tokens of each class
    class_v: np.ndarray  # distinct words of each class
    floor: int  # words of lower classes of counts are not among the frequent

    @property
    def known(self) -> int:
        """Words with vectors."""
        return min(VOCABULARY, len(self.words))

    def classes(self) -> np.ndarray:
        """Of each frequent word."""
        return np.array([i + 1 if i < HEADS - 1 else tail_class(w) for i, w in enumerate(self.words)], dtype=np.int64)

    def log10(self, n: np.ndarray) -> np.ndarray:
        """The base probability of a token seen n times."""
        return np.log10((n + SMOOTH) / (self.n + SMOOTH * (self.v + 1)))

    def beyond(self) -> np.ndarray:
        """Of each group the smoothed sum of the counts of its words without vectors."""
        c = self.classes()[: self.known]
        n = self.class_n - np.bincount(c, self.counts[: self.known] * (c >= HEADS), CLASSES)
        v = self.class_v - np.bincount(c, c >= HEADS, CLASSES)
        return (n + SMOOTH * (v + 1))[HEADS:]


def _rank_class(n: Column) -> Column:
    """Counts in 32 classes an octave: at most some 2,000."""
    return F.floor(F.log2(n) * 32).cast("int")


def _group(word: Column) -> Column:
    """As ``tail_class``, from 0."""
    return F.crc32(F.substring(word, F.greatest(F.length(word) - 1, F.lit(1)), F.lit(2))) % TAILS


def vocabulary(counts: DataFrame, n_docs: int) -> Vocabulary:
    # the lowest class of counts with which FREQUENT holds; no word is ordered for it
    short = counts.filter(F.length("word") <= LONGEST).withColumn("c", _rank_class(F.col("n")))
    held, floor = 0, 1 << 30
    for r in sorted(short.groupBy("c").count().collect(), key=lambda r: -r.c):
        if (held := held + r["count"]) > FREQUENT:
            break
        floor = r.c
    top = short.filter(F.col("c") >= floor).select("word", "n").toArrow()  # at most FREQUENT rows
    order = sorted(zip((-n for n in top.column("n").to_pylist()), top.column("word").to_pylist(), strict=True))
    words = [bytes(w) for _, w in order]

    group = F.lit(HEADS) + _group(F.col("word"))
    per = {int(r.c): (r.n, r.v) for r in counts.groupBy(group.alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for c, (n, v) in per.items():
        class_n[c], class_v[c] = n, v
    total, distinct = int(class_n.sum()), int(class_v.sum())
    for i, (n, w) in enumerate(order[: HEADS - 1], 1):
        c = tail_class(bytes(w))
        class_n[i], class_v[i] = -n, 1
        class_n[c] += n
        class_v[c] -= 1
    class_n[0], class_v[0] = n_docs, 1 if n_docs else 0
    return Vocabulary(words, np.array([-n for n, _ in order], dtype=np.int64), total + n_docs, distinct + (1 if n_docs else 0), n_docs, class_n, class_v, floor)


# --- texts as numbers


class _Numbers(dict):
    """Numbers of words; of one beyond the frequent, below zero, by its group.  Remembers up to a bound."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(len(words)), strict=True))
        self._most = len(words) + HELD

    def __missing__(self, w: bytes) -> int:
        n = HEADS - 1 - tail_class(w)
        if len(self) < self._most:
            self[w] = n
        return n


def encode(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """at (a number of the row), doc_id, train, ids, and the words beyond the frequent with their times; stored."""
    words_ = vocabulary.words
    names = ["at", "doc_id", "train", "ids", "rare", "times"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, at = _Numbers(words_), TaskContext.get().partitionId() << 33
        for b in batches:
            ids, rare, times = [], [], []
            for t in b.column("text"):
                ws = words(t.as_py())
                x = np.fromiter(map(number.__getitem__, ws), dtype=np.int32, count=len(ws))
                held = Counter(ws[i] for i in np.flatnonzero(x < 0).tolist())
                ids.append(x)
                rare.append(list(held))
                times.append(list(held.values()))
            cols = [pa.array(np.arange(at, at + len(ids))), b.column("doc_id"), b.column("train"), *(pa.array(x, k) for x, k in zip((ids, rare, times), kinds[3:], strict=True))]
            at += len(ids)
            yield pa.RecordBatch.from_arrays(cols, names)

    return stored(rows.select("doc_id", "train", "text").mapInArrow(tidy(run), "at long, doc_id long, train boolean, ids array<int>, rare array<binary>, times array<long>"), "encoded")


@dataclass
class Tokens:
    """All tokens of a batch of documents, each document's end included."""

    a: np.ndarray  # class two before
    b: np.ndarray  # class before
    c: np.ndarray  # class
    word: np.ndarray  # number of the word; -1 for ends, lower beyond the frequent
    size: np.ndarray  # tokens of each document

    @classmethod
    def of(cls, lists: pa.ListArray, class_of: np.ndarray) -> Tokens:
        off = lists.offsets.to_numpy()
        n, ids = np.diff(off), lists.flatten().to_numpy()
        docs = np.arange(len(n))
        # two ends before each document and one behind it
        place = np.arange(len(ids)) + 2 + 3 * np.repeat(docs, n)
        c = np.zeros(len(ids) + 3 * len(n), dtype=np.int64)
        c[place] = np.where(ids >= 0, class_of[np.maximum(ids, 0)] if len(class_of) else 0, HEADS - 1 - ids)
        word = np.full(len(c), -1, dtype=np.int64)
        word[place] = np.where(ids >= 0, ids, -2)
        told = np.ones(len(c), dtype=bool)
        starts = off[:-1] - off[0] + 3 * docs
        told[starts] = told[starts + 1] = False
        at = np.flatnonzero(told)
        return cls(c[at - 2], c[at - 1], c[at], word[at], n + 1)


def slots(t: Tokens, known: int) -> np.ndarray:
    """Where a token of a group stands among the word vectors: its own place, or that of its group's other words."""
    return np.where((t.word >= 0) & (t.word < known), t.word, known + t.c - HEADS)


def counted(encoded: DataFrame, keys: Callable[[Tokens], tuple[np.ndarray, np.ndarray]], class_of: np.ndarray) -> DataFrame:
    """(shard, key, n) over the training documents; ``keys`` gives shards (below SHARDS) and keys of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((key % SHARDS).astype(np.int32)), pa.array(key // SHARDS), pa.array(n.astype(np.int64))], ["shard", "key", "n"])

        for b in batches:
            shard, key = keys(Tokens.of(b.column("ids"), class_of))
            held.append(key * SHARDS + shard)
            size += len(key)
            if size > COUNTED:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return encoded.filter("train").select("ids").mapInArrow(tidy(run), "shard int, key long, n long").groupBy("shard", "key").agg(F.sum("n").alias("n"))


def triples(encoded: DataFrame, class_of: np.ndarray) -> DataFrame:
    """How often class c follows a, b; key = (a * CLASSES + b) * CLASSES + c, dealt to shards by a hash."""

    def keys(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        key = (t.a * CLASSES + t.b) * CLASSES + t.c
        return (key * 0x9E3779B1 >> 16) % SHARDS, key

    return counted(encoded, keys, class_of)


def pairs(encoded: DataFrame, class_of: np.ndarray, known: int) -> DataFrame:
    """How often a slot of a group follows class b; key = slot * CLASSES + b, a shard holds whole groups."""

    def keys(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        on = t.c >= HEADS
        return (t.c[on] - HEADS) % SHARDS, slots(t, known)[on] * CLASSES + t.b[on]

    return counted(encoded, keys, class_of)


# --- the model


@dataclass
class Bilinear:
    a: np.ndarray  # of the class two before
    b: np.ndarray  # of the class before
    r: np.ndarray  # of the class predicted
    bias: np.ndarray

    @classmethod
    def start(cls, unigram: np.ndarray, seed: int = 0) -> Bilinear:
        rng = np.random.default_rng(seed)
        return cls(*(rng.normal(0, 0.1, (CLASSES, DIM)).astype(np.float32) for _ in "abr"), np.log(unigram).astype(np.float32))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by (a, c) and by (b, c), bias in the latter, and log sums by (a, b), by batched products."""
        ra, rb = self.a @ self.r.T, self.b @ self.r.T + self.bias
        logz = np.empty((CLASSES, CLASSES), dtype=np.float64)
        for i in range(CLASSES):
            s = (self.a[i] + self.b) @ self.r.T + self.bias
            top = s.max(axis=1)
            logz[i] = top + np.log(np.exp(s - top[:, None]).sum(axis=1, dtype=np.float64))
        return ra, rb, logz


def contrast(m: Bilinear, a: np.ndarray, b: np.ndarray, c: np.ndarray, unigram: np.ndarray, noise: np.ndarray, grads: dict, rate: float) -> None:
    """One step of noise-contrastive estimation; the noise words are shared by the batch.

    A class is told from k noise words by its score against log(k q); the sum over
    classes is taken for one, which the score learns (normalisation comes later).
    """
    k = len(noise)
    h = m.a[a] + m.b[b]
    log_kq = np.log(k * unigram).astype(np.float32)
    pos = (h * m.r[c]).sum(axis=1) + m.bias[c] - log_kq[c]
    neg = h @ m.r[noise].T + m.bias[noise] - log_kq[noise]
    gp = -1 / (1 + np.exp(np.clip(pos, -30, 30)))
    gn = 1 / (1 + np.exp(-np.clip(neg, -30, 30)))
    dh = gp[:, None] * m.r[c] + gn @ m.r[noise]

    def summed(at: np.ndarray, g: np.ndarray) -> np.ndarray:
        order = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.diff(at[order], prepend=-1))
        out = np.zeros((CLASSES, g.shape[1]), dtype=np.float32)
        out[at[order][cuts]] = np.add.reduceat(g[order], cuts, axis=0)
        return out

    da, db = summed(a, dh), summed(b, dh)
    dr = summed(c, gp[:, None] * h) + summed(noise, gn.T @ h)
    dbias = np.bincount(c, gp, CLASSES) + np.bincount(noise, gn.sum(axis=0), CLASSES)
    for name, g in (("a", da), ("b", db), ("r", dr), ("bias", dbias.astype(np.float32))):
        g = g / len(a)
        grads[name] = grads.get(name, 1e-8) + g * g
        setattr(m, name, getattr(m, name) - rate * g / np.sqrt(grads[name]))


def _local_round(r: int, start: bytes, unigram: np.ndarray, plan: tuple[int, int, int]):
    """A shard's part of a round: from its triples to its own parameters."""
    seed, rounds, steps = plan

    def run(key, table):
        m, grads = pickle.loads(start)
        grads = grads or {}
        order = np.argsort(table.column("key").to_numpy(), kind="stable")
        keys, ends = table.column("key").to_numpy()[order], np.cumsum(table.column("n").to_numpy()[order])
        rng = np.random.default_rng([seed, r, key[0].as_py()])
        noises = np.cumsum(unigram / unigram.sum())
        for s in range(steps):
            x = keys[np.searchsorted(ends, rng.integers(0, ends[-1], BATCH), side="right")]
            noise = np.minimum(np.searchsorted(noises, rng.random(NOISE)), CLASSES - 1)
            done = (r * steps + s) / (rounds * steps)
            contrast(m, x // CLASSES**2, x // CLASSES % CLASSES, x % CLASSES, unigram, noise, grads, RATE * (1 - 0.9 * done))
        return pa.table({"n": pa.array([int(ends[-1])], pa.int64()), "model": pa.array([pickle.dumps((m, grads))], pa.binary())})

    return run


def train(counts: DataFrame, unigram: np.ndarray, rounds: int = ROUNDS, steps: int = STEPS, seed: int = 0) -> Bilinear:
    """Rounds of local descent on shards of the triples, and averages of the parameters.

    A shard holds at most CLASSES^3 / SHARDS triples; positives are drawn by their counts.
    """
    sharded = stored(counts, "triples")
    m, grads = Bilinear.start(unigram, seed), None
    for r in range(rounds):
        start = pickle.dumps((m, grads))

        run = _local_round(r, start, unigram, (seed, rounds, steps))
        got = sharded.groupBy("shard").applyInArrow(run, "n long, model binary").collect()
        if not got:
            return m
        parts = [(x.n, *pickle.loads(x.model)) for x in sorted(got, key=lambda x: bytes(x.model))]
        total = sum(n for n, _, _ in parts)
        mean = {k: sum(n / total * getattr(p, k) for n, p, _ in parts).astype(np.float32) for k in ("a", "b", "r", "bias")}
        grads = {k: sum(n / total * g[k] for n, _, g in parts) for k in parts[0][2]}
        m = Bilinear(**mean)
    return m


@dataclass
class Inner:
    """The model within the groups: vectors of the contexts (of each shard) and of the slots."""

    v: np.ndarray  # SHARDS, CLASSES, WORD_DIM
    w: np.ndarray  # slots, WORD_DIM
    bias: np.ndarray
    group: np.ndarray  # group of each slot, or -1

    def logs(self) -> np.ndarray:
        """Logarithms of the sums over each group, by (group, context class), by one product a group."""
        out = np.zeros((TAILS, CLASSES))
        order = np.argsort(self.group, kind="stable")
        cuts = np.searchsorted(self.group[order], np.arange(TAILS + 1))
        for g in range(TAILS):
            own = order[cuts[g] : cuts[g + 1]]
            s = self.v[g % SHARDS] @ self.w[own].T + self.bias[own]
            if len(own):
                top = s.max(axis=1)
                out[g] = top + np.log(np.exp(s - top[:, None]).sum(axis=1, dtype=np.float64))
        return out

    def score(self, group: np.ndarray, b: np.ndarray, slot: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probability of slots in their groups after class b."""
        return (self.v[group % SHARDS, b] * self.w[slot]).sum(axis=1) + self.bias[slot] - logs[group, b]


def _word_descent(group: np.ndarray, seed: int):
    """Noise-contrastive descent within the groups of one shard; noise comes from the group's own counts."""

    def run(key, table):
        k, n = table.column("key").to_numpy(), table.column("n").to_numpy()
        order = np.argsort(k, kind="stable")
        k, n = k[order], n[order]
        slot, b = k // CLASSES, k % CLASSES
        own, at = np.unique(slot, return_inverse=True)
        # slots in the order of their groups, so that a group's noise is a range of the running sum
        by = np.argsort(group[own], kind="stable")
        own, at = own[by], np.argsort(by, kind="stable")[at]
        count = np.bincount(at, n, len(own))
        g = group[own]
        sums = np.concatenate([[0.0], np.cumsum(count)])
        begin, end = sums[np.searchsorted(g, g, side="left")], sums[np.searchsorted(g, g, side="right")]
        log_q = np.log(count / (end - begin)).astype(np.float32)
        rng = np.random.default_rng([seed, key[0].as_py()])
        v = rng.normal(0, 0.1, (CLASSES, WORD_DIM)).astype(np.float32)
        w = rng.normal(0, 0.1, (len(own), WORD_DIM)).astype(np.float32)
        bias = log_q.copy()
        gv, gw, gb = np.full(CLASSES, 1e-6), np.full(len(own), 1e-6), np.full(len(own), 1e-6)
        ends = np.cumsum(n)
        log_k = np.log(WORD_NOISE)

        def summed(where: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            o = np.argsort(where, kind="stable")
            cuts = np.flatnonzero(np.diff(where[o], prepend=-1))
            return where[o][cuts], np.add.reduceat(x[o], cuts, axis=0)

        for step in range(WORD_STEPS):
            x = np.searchsorted(ends, rng.integers(0, ends[-1], WORD_BATCH), side="right")
            p, c = at[x], b[x]
            u = begin[p][:, None] + rng.random((WORD_BATCH, WORD_NOISE)) * (end - begin)[p][:, None]
            noise = np.clip(np.searchsorted(sums, u, side="right") - 1, 0, len(own) - 1)
            both = np.concatenate([p[:, None], noise], axis=1)
            h, r = v[c], w[both]
            z = np.einsum("nd,nkd->nk", h, r) + bias[both] - log_q[both] - log_k
            grad = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            grad[:, 0] -= 1
            grad = (grad / WORD_BATCH).astype(np.float32)
            rate = WORD_RATE * (1 - 0.9 * step / WORD_STEPS)
            for param, total, where, part in ((v, gv, c, np.einsum("nk,nkd->nd", grad, r)), (w, gw, both.ravel(), (grad[:, :, None] * h[:, None, :]).reshape(-1, WORD_DIM))):
                i, d = summed(where, part)
                total[i] += (d * d).mean(axis=1)
                param[i] -= rate * d / np.sqrt(total[i])[:, None].astype(np.float32)
            i, d = summed(both.ravel(), grad.ravel())
            gb[i] += d * d
            bias[i] -= rate * d / np.sqrt(gb[i])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "model": pa.array([pickle.dumps((own, v, w, bias))], pa.binary())})

    return run


def train_words(counts: DataFrame, vocabulary: Vocabulary, seed: int = 0) -> Inner:
    """Each shard learns its groups alone; what comes back are WORD_DIM numbers a slot."""
    known = vocabulary.known
    group = np.concatenate([vocabulary.classes()[:known] - HEADS, np.arange(TAILS)])
    group[group < 0] = -1
    size = known + TAILS
    share = np.concatenate([vocabulary.counts[:known], np.maximum(vocabulary.beyond(), SMOOTH)])
    m = Inner(np.zeros((SHARDS, CLASSES, WORD_DIM), np.float32), np.zeros((size, WORD_DIM), np.float32), np.log(share).astype(np.float32), group)
    total = np.bincount(group[group >= 0], share[group >= 0], TAILS)
    m.bias[group >= 0] -= np.log(np.maximum(total, SMOOTH))[group[group >= 0]].astype(np.float32)
    for r in counts.groupBy("shard").applyInArrow(_word_descent(group, seed), "shard int, model binary").collect():
        own, v, w, bias = pickle.loads(r.model)
        m.v[r.shard], m.w[own], m.bias[own] = v, w, bias
    return m


# --- scores


def score(docs: DataFrame, trains: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row; rows that ``trains`` tells are learnt from."""
    require(docs, ["doc_id", "text"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(trains, F.lit(False)).alias("train"), F.col("text").cast("string").alias("text"))
    training = rows.filter("train")
    counts = stored(word_counts(training.select("text")), "words")
    vocab = vocabulary(counts, training.count())
    encoded = encode(rows, vocab)
    class_of, known = vocab.classes(), vocab.known
    unigram = np.maximum(vocab.class_n, 0.5)
    unigram = unigram / unigram.sum()
    model = train(triples(encoded, class_of), unigram)
    inner = train_words(pairs(encoded, class_of, known), vocab)
    base = vocab.log10(vocab.counts)
    end = float(vocab.log10(np.array([vocab.ends]))[0])
    beyond = vocab.beyond()
    # of a frequent word without a vector: its share of its group's other words
    group = np.maximum(class_of - HEADS, 0)
    within = np.where((np.arange(len(class_of)) >= known) & (class_of >= HEADS), np.log10((vocab.counts + SMOOTH) / beyond[group]), 0.0) if len(class_of) else np.zeros(0)
    state: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not state:
            state["tables"], state["logs"] = model.tables(), inner.logs()
        (ra, rb, logz), logs = state["tables"], state["logs"]
        for b in batches:
            t = Tokens.of(b.column("ids"), class_of)
            net, plain = np.zeros(len(t.c)), np.full(len(t.c), end)
            held = t.word >= 0
            if len(base):
                plain[held] = base[t.word[held]]
            plain[t.word == -2] = 0
            slot = slots(t, known)
            for i in range(0, len(t.c), SCORED):
                j = slice(i, i + SCORED)
                net[j] = (ra[t.a[j], t.c[j]] + rb[t.b[j], t.c[j]] - logz[t.a[j], t.b[j]]) / np.log(10)
                tail = i + np.flatnonzero(t.c[j] >= HEADS)
                net[tail] += inner.score(t.c[tail] - HEADS, t.b[tail], slot[tail], logs) / np.log(10)
            if len(base):
                net[held] += within[t.word[held]]
            first = np.cumsum(t.size) - t.size
            sums = [np.add.reduceat(x, first) if len(first) else np.zeros(0) for x in (plain, net, ((t.word >= 0) | ((t.word == -1) & (vocab.ends > 0))).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([b.column("at"), b.column("doc_id"), pa.array(t.size.astype(np.int64)), *map(pa.array, sums)], ["at", "doc_id", "n_tokens", "base", "model", "known"])

    summed = encoded.select("at", "doc_id", "ids").mapInArrow(tidy(run), "at long, doc_id long, n_tokens long, base double, model double, known long")

    # words beyond the frequent meet their counts, once a document
    rare = encoded.select("at", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("at", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    table = counts.filter((_rank_class(F.col("n")) < vocab.floor) | (F.length("word") > LONGEST))
    n = F.coalesce("n", F.lit(0)) + F.lit(SMOOTH)
    own = F.element_at(F.array(*[F.lit(float(x)) for x in beyond]), (_group(F.col("word")) + 1).cast("int"))
    # a long word may be that of a third of all rows: such are few, and broadcast
    joined = rare_counts(rare, table)
    sums = joined.groupBy("at").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10(n / F.lit(float(vocab.n + SMOOTH * (vocab.v + 1))))).alias("rare_base"),
        F.sum(F.col("times") * F.log10(n / own)).alias("rare_model"),
    )
    done = summed.join(sums, "at", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return done.select(
        "doc_id", "n_tokens",
        (F.col("known") + zero("rare_known")).cast("long").alias("n_known"),
        F.lit(vocab.n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_base")).alias("base_score"),
        (F.col("model") + zero("rare_model")).alias("score"),
    )


def rare_counts(rare: DataFrame, table: DataFrame) -> DataFrame:
    """(at, word, times) with the training count ``n`` of the word, null for one never seen.

    Words of many occurrences, which only their length keeps from being frequent, are
    fewer than HOT and broadcast; the others meet their counts by a shuffle.
    """
    least = (table.agg(F.sum("n")).first()[0] or 0) // HOT
    hot = F.broadcast(table.filter(F.col("n") > least))
    met = rare.join(hot, "word")
    return met.unionByName(rare.join(hot.select("word"), "word", "left_anti").join(table.filter(F.col("n") <= least), "word", "left"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(documents(spark, sf_dir).select("doc_id", "text"), ~held_out(F.col("doc_id")))
    return found.withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of ``op8_lm_score`` SQL can express: all but the model's score."""
    return op8_lm_score(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 6))


#: CRC-32 of the id's digits, bit by bit.
BASE_SQL = """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), CAST(4294967295 AS BIGINT)), 4294967295) % 10 = 0 AS held_out FROM documents
), t AS (
  SELECT doc_id, held_out, unnest(list_append(list_transform(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), lambda w: concat('w', w)), 'end')) AS token FROM h
), c AS (
  SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY token
), n AS (
  SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c
)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, max(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))), 6) AS base_score
FROM t LEFT JOIN c ON t.token = c.token, n GROUP BY doc_id, held_out
"""

QUERIES = {"op8_lm_score": op8_lm_score, "lm_base_scores": lm_base_scores}
ORACLES = {"lm_base_scores": BASE_SQL}
