"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces of one length are alike to a packer, so the problem is no longer than the
histogram of lengths: at most ``capacity`` counts, whatever the corpus holds.  A
genome is a multiset of bins, kept as pattern -> how many bins are filled so.
Crossover injects whole well-filled bins of one parent into the other, removes
bins that would use a piece twice, and best-fits the displaced pieces.  Islands
evolve as Spark tasks; after each round the best genome of an island migrates to
its neighbour.  The winner then deals real pieces to bins: piece number r of its
length takes the r-th place of that length, found by arithmetic, so no group of
equal lengths meets in one task.

What travels is bounded: a histogram of ``capacity`` counts and genomes whose
patterns follow the lengths in use, not the rows.
"""

from __future__ import annotations

import pickle
import random
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import default_tokenizer, encoder, text_groups
from .shared import documents, require, stored

Genome = dict[tuple[int, ...], int]

PIECES = "part long, k long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Tokenize and cut; ``k`` numbers the pieces of one length within a partition."""
    require(docs, ["doc_id", "text"])
    tokenizer = tokenizer or default_tokenizer()
    names = [f.split()[0] for f in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e, part = encoder(tokenizer), TaskContext.get().partitionId()
        end, seen = np.array([end_id], dtype="<u4"), Counter()
        for ids, texts in text_groups(batches):
            rows = []
            for i, a in zip(ids, e.encode(texts), strict=True):
                a = np.concatenate([a.astype("<u4"), end])
                for p, (s, n) in enumerate(cut(len(a), capacity)):
                    rows.append((part, seen[n], i, p, s, n, zlib.crc32(a[s : s + n])))
                    seen[n] += 1
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int32() if n == "piece" else pa.int64() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


# --- the genetic algorithm, on a histogram of lengths


def best_fit(left: list[int], capacity: int, rng: random.Random, noise: float = 0.0) -> Genome:
    """Fill bins from the longest piece down until nothing is left.

    ``left[n]`` counts the pieces of length n.  A gap takes a piece, or two, that
    close it exactly; else the longest that fits.  Of such a bin as many are made
    as the pieces allow.  With ``noise`` now and then the second choice is taken.
    """
    left = list(left)
    sizes = [n for n in range(1, capacity + 1) if left[n]]
    here = np.zeros(capacity + 1, dtype=bool)
    here[sizes] = True
    genome: Genome = Counter()

    def drop(n: int) -> None:
        here[n] = False
        del sizes[bisect_right(sizes, n) - 1]

    while sizes:
        use = Counter([sizes[-1]])
        gap = capacity - sizes[-1]

        def free(n: int, use: Counter = use) -> int:
            return left[n] - use[n]

        while gap:
            if here[gap] and free(gap) > 0:
                use[gap] += 1
                break
            pick = 0
            pairs = np.flatnonzero(here[1 : (gap + 1) // 2] & here[gap - 1 : gap // 2 : -1]) if gap > 2 else ()
            if len(pairs):
                x = int(pairs[rng.randrange(len(pairs))] if rng.random() < noise else pairs[0]) + 1
                if free(x) > 0 and free(gap - x) > 0:
                    use[x] += 1
                    use[gap - x] += 1
                    break
            at = bisect_right(sizes, gap) - 1
            skip = rng.random() < noise
            while at >= 0:
                if free(sizes[at]) > 0:
                    pick = sizes[at]
                    if not skip:
                        break
                    skip = False
                at -= 1
            if not pick:
                break
            # a run of equal short pieces at once
            n = max(1, min(free(pick), gap // pick) if pick * 8 < gap else 1)
            use[pick] += n
            gap -= n * pick
        times = min(left[n] // c for n, c in use.items())
        genome[tuple(sorted(use.elements(), reverse=True))] += times
        for n, c in use.items():
            left[n] -= c * times
            if not left[n]:
                drop(n)
    return genome


def fitness(genome: Genome, capacity: int) -> tuple[int, float]:
    """Fewer bins first; then bins as unevenly filled as can be (mean of squares)."""
    bins = sum(genome.values())
    return -bins, sum(m * (sum(p) / capacity) ** 2 for p, m in genome.items()) / max(1, bins)


def crossover(mother: Genome, father: Genome, counts: list[int], capacity: int, rng: random.Random) -> Genome:
    """Inject well-filled bins of the father, keep what still fits of the mother, best-fit the rest."""
    left = list(counts)
    child: Genome = Counter()

    def take(p: tuple[int, ...], most: int) -> None:
        use = Counter(p)
        m = min([most, *(left[n] // c for n, c in use.items())])
        if m > 0:
            child[p] += m
            for n, c in use.items():
                left[n] -= c * m

    full = sorted(father, key=lambda p: -sum(p))
    for p in full[: max(1, len(full) // 2)]:
        if rng.random() < 0.5:
            take(p, father[p])
    worst = sum(1 for p in mother if sum(p) < capacity) or 1
    for p in sorted(mother, key=lambda p: -sum(p)):
        # badly filled bins dissolve, and now and then a full one
        if (sum(p) == capacity and rng.random() > 0.05) or rng.random() < 0.3 / worst:
            take(p, mother[p])
    for p, m in best_fit(left, capacity, rng, noise=0.1).items():
        child[p] += m
    return child


def evolve(genomes: list[Genome], counts: list[int], capacity: int, seed: int, size: int, births: int) -> list[Genome]:
    """One island's round: the best ``size`` of its genomes and their offspring."""
    rng = random.Random(seed)
    bound = lower_bound(counts, capacity)
    genomes = list(genomes)
    while len(genomes) < size:
        genomes.append(best_fit(counts, capacity, rng, noise=0.0 if seed % 7 == 0 and not genomes else 0.05 * (1 + rng.random())))
        if sum(genomes[-1].values()) <= bound:
            return [genomes[-1]]
    genomes.sort(key=lambda g: fitness(g, capacity), reverse=True)
    for _ in range(births):
        if sum(genomes[0].values()) <= bound:
            break
        mother, father = (min(rng.sample(range(len(genomes)), 2)) for _ in "ab")
        if mother == father:
            father = (father + 1) % len(genomes)
        genomes.append(crossover(genomes[mother], genomes[father], counts, capacity, rng))
        genomes.sort(key=lambda g: fitness(g, capacity), reverse=True)
        del genomes[size:]
    return genomes


def lower_bound(counts: list[int], capacity: int) -> int:
    """No packing has fewer bins."""
    return max(-(-sum(n * c for n, c in enumerate(counts)) // capacity), sum(counts[capacity // 2 + 1 :]))


def pack_histogram(spark: SparkSession, counts: list[int], capacity: int = 2048, islands: int = 4, rounds: int = 3, size: int = 4, births: int = 8) -> Genome:
    """Evolve on islands with migration of the elite; stops where the lower bound is met."""
    if not any(counts):
        return {}
    bound = lower_bound(counts, capacity)
    homes: list[list[Genome]] = [[] for _ in range(islands)]
    best: Genome = {}
    for r in range(rounds):

        def island(batches: Iterator[pa.RecordBatch], r: int = r) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for x in b.to_pylist():
                    out = evolve(pickle.loads(x["genomes"]), counts, capacity, 7 * r + x["island"], size, births)
                    yield pa.RecordBatch.from_pydict({"island": [x["island"]], "genomes": [pickle.dumps(out)]})

        rows = spark.createDataFrame([(i, pickle.dumps(h)) for i, h in enumerate(homes)], "island long, genomes binary")
        done = rows.repartition(islands, "island").mapInArrow(island, "island long, genomes binary").collect()
        homes = [pickle.loads(x.genomes) for x in sorted(done, key=lambda x: x.island)]
        best = max([*(h[0] for h in homes), *([best] if best else [])], key=lambda g: fitness(g, capacity))
        if sum(best.values()) <= bound:
            break
        homes = [[*h[: size - 1], homes[i - 1][0]] for i, h in enumerate(homes)]
    return best


class Places:
    """Where piece r of length n goes: sequence and offset."""

    def __init__(self, genome: Genome, capacity: int):
        rows, base = [], 0
        for p, m in sorted(genome.items(), key=lambda x: x[0], reverse=True):
            at = 0
            for n, c in sorted(Counter(p).items(), reverse=True):
                rows.append((n, m * c, c, base, at))
                at += n * c
            base += m
        a = np.array(rows, dtype=np.int64).reshape(-1, 5)
        a = a[np.argsort(a[:, 0], kind="stable")]
        self.length, self.share, self.base, self.at = a[:, 0], a[:, 2], a[:, 3], a[:, 4]
        ends = np.cumsum(a[:, 1])
        self.begins = ends - a[:, 1]  # over all lengths in turn
        firsts = np.searchsorted(self.length, np.arange(capacity + 2))
        self.zero = np.append(self.begins, ends[-1] if len(ends) else 0)[firsts]
        self.bins = base

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g = self.zero[length] + rank
        i = np.searchsorted(self.begins, g, side="right") - 1
        r = g - self.begins[i]
        return self.base[i] + r // self.share[i], self.at[i] + r % self.share[i] * length


def pack(found: DataFrame, capacity: int = 2048, **options: int) -> DataFrame:
    """Give each row of ``pieces`` its sequence_id and offset; ``found`` must be a stored table."""
    spark = found.sparkSession
    # bounded by capacity rows
    per = found.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = [0] * (capacity + 1)
    for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r.length] = r.n
    whole, counts[capacity] = counts[capacity], 0
    genome = dict(pack_histogram(spark, counts, capacity, **options))
    if whole:
        genome[(capacity,)] = whole
    places = Places(genome, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = found.join(starts, ["part", "length"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, off = places(b.column("length").to_numpy(), b.column("k").to_numpy() + b.column("before").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(deal, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(stored(pieces(documents(spark, sf_dir)), "pieces"))


QUERIES = {"op10_pack": op10_pack}
ORACLES: dict[str, str] = {}
