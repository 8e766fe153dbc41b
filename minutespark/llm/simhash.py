"""SimHash near-deduplication over pigeonhole blocks.

A text's 64 fingerprint bits are the majority of the bits of its shingles' XXH64
hashes.  Texts link at ``RADIUS`` = 2 or fewer differing bits.  Equal fingerprints
are collapsed first, so copies never meet.  The bits are split into four blocks of
16; two fingerprints within two bits agree in two blocks at least, so they share
one of the six pairs of blocks, and a join on those pairs misses none.

A pair of blocks that many fingerprints share (a family of near copies) is not
joined all with all: its members are split once more, each under the 33 values at
most one bit away in the other two blocks.  Members within two bits share such a
value, and all members under a value are within two bits, so a star to the least
of them keeps the components and no group exceeds 33.

Null texts count as empty; an empty text has fingerprint zero and links like any
other.  Repeated ids: each row has its own fingerprint; ids link through all their
rows.  Rows with a null id keep their fingerprint and a null component; others
reach each other through them.  Ids from ``BEYOND`` on stand for nodes without one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .shared import documents, join_groups, require, stored, tidy

SEED = 42
SHINGLE = 3
RADIUS = 2
#: A pair of blocks with more fingerprints is split once more.
SMALL = 24
#: Nodes of no id of their own are numbered from here, behind the ids.
BEYOND = 1 << 62
_MASKS = [((0xFFFF << 16 * a) | (0xFFFF << 16 * b)) for a, b in combinations(range(4), 2)]


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of the shingles, repeats included.  bytes.lower() lowers A-Z alone, bytes.split() cuts at 20, 09-0D."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < width:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    begins = (ends - np.diff(ends, prepend=0)).tolist()
    ends = (ends - 1).tolist()
    return np.array([xxh64_intdigest(flat[a:b], SEED) for a, b in zip(begins, ends[width - 1 :], strict=False)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(bits), 255):  # sums of so many bits fit in a byte
        total += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(total * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprint_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [majority(shingle_hashes(t.as_py(), width)) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    require(docs, ["doc_id", "text"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(_fingerprint_rows(width)), "doc_id long, fp long")


def _flips(fp: Column, mask: int) -> Column:
    """fp and all values one bit away outside the mask, as an array."""
    free = [b for b in range(64) if not mask >> b & 1]
    signed = [(1 << b) - (1 << 64) if b == 63 else 1 << b for b in free]
    return F.array(fp, *[fp.bitwiseXOR(F.lit(s)) for s in signed])


def links(heads: DataFrame) -> DataFrame:
    """Links (u, v) between heads (columns id, fp; fp distinct) that keep the components."""
    signed = [m - (1 << 64) if m >> 63 else m for m in _MASKS]
    keyed = heads.select("id", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("block", "key"))
    sizes = keyed.groupBy("block", "key").count().filter("count > 1")
    blocks = stored(keyed.join(sizes, ["block", "key"]), "blocks")
    small = blocks.filter(F.col("count") <= SMALL)
    other = small.select("block", "key", F.col("id").alias("v"), F.col("fp").alias("fp2"))
    near = small.join(other, ["block", "key"]).filter((F.col("v") < F.col("id")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= RADIUS)).select(F.col("id").alias("u"), "v")

    large = blocks.filter(F.col("count") > SMALL)
    center = F.when(F.lit(False), F.array(F.col("fp")))
    for n, m in enumerate(_MASKS):
        center = center.when(F.col("block") == n, _flips(F.col("fp"), m))
    balls = large.select("block", "id", F.explode(center).alias("center"))
    stars = balls.groupBy("block", "center").agg(F.min("id").alias("v"), F.collect_set("id").alias("ids")).filter(F.size("ids") > 1)
    far = stars.select(F.explode("ids").alias("u"), "v").filter("u != v")
    return near.unionByName(far).distinct()


def families(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint, component_id of every row; further: the size of its fingerprint's group."""
    rows = stored(fingerprints(docs, width), "simhash")
    # fingerprints that no id holds have nodes too; those alike but for the last two bits are linked, and may share one
    nameless = F.lit(BEYOND) + F.shiftrightunsigned("fp", 2)
    heads = stored(rows.groupBy("fp").agg(F.coalesce(F.min("doc_id"), nameless).alias("id"), F.count(F.lit(1)).alias("copies")), "heads")
    # ids that stand under several fingerprints tie these together
    named = rows.filter("doc_id is not null").distinct()
    ties = named.join(named.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "doc_id").join(heads.select("fp", "id"), "fp").select(F.col("doc_id").alias("u"), F.col("id").alias("v")).filter("u != v")
    found = components(links(heads.select("id", "fp")).unionByName(ties))
    heads = heads.join(found.withColumnRenamed("node", "id"), "id", "left").select("fp", "copies", F.coalesce("component", "id").alias("component_id"))
    out = rows.join(heads, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), "copies")


# --- looser copies: five-word shingles alike to four fifths

#: The similarity that links, and the words of a shingle.
ALIKE, WORDS = 0.8, 5
#: Buckets in which the shingles of all documents are counted, the slices they travel in,
#: and how many of the fullest are told apart.
BUCKETS, SLICES, COMMON = 1 << 22, 256, 1 << 18
#: A bucket is hot that holds so many more of the documents' shingles than the mean.
HOT_SHARE = 0.0012
#: Members that the others of a crowded group are compared with first, and rows of a block of what is left.
HUBS, BLOCK = 8, 256
#: Bits of a signature.
SIGN = 1024
#: Prefix shingles that are grouped in one task, on average.
GROUPED = 1 << 18


def sketch(text: str | None) -> bytes:
    """The distinct hashes of a text's shingles, all of them, in order."""
    return np.unique(shingle_hashes(text, WORDS)).astype("<u8").tobytes()


def mark(shingles: bytes) -> int:
    """Names a set of shingles, as a signed 64-bit number."""
    from xxhash import xxh3_64_intdigest

    x = xxh3_64_intdigest(shingles)
    return x - (1 << 64) if x >> 63 else x


def alike(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two shingle sets."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 0.0


def verified(rows: DataFrame, heads: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) of marks whose whole shingle sets are alike to ALIKE or more; ``heads`` leads from a mark to a row."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sketch(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([mark(x) for x in found], pa.int64()), pa.array(found, pa.binary())], ["mark", "shingles"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [alike(x.as_py(), y.as_py()) >= ALIKE for x, y in zip(b.column("su"), b.column("sv"), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    # sets of the nominated alone; a repeated id may bring others, which meet no pair
    asked = pairs.select(F.col("u").alias("mark")).unionByName(pairs.select(F.col("v").alias("mark"))).distinct()
    ids = heads.join(asked, "mark", "left_semi").select(F.col("id").alias("doc_id")).distinct()
    found = stored(rows.join(ids, "doc_id", "left_semi").select("text").mapInArrow(tidy(sets), "mark long, shingles binary"), "sets")
    found = found.groupBy("mark").agg(F.min("shingles").alias("shingles"))
    both = pairs.join(found.select(F.col("mark").alias("u"), F.col("shingles").alias("su")), "u").join(found.select(F.col("mark").alias("v"), F.col("shingles").alias("sv")), "v")
    return both.select("u", "v", "su", "sv").mapInArrow(tidy(check), "u long, v long")


def prefix(shingles: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles in the order of their rank (0 unless in ``common``), then of their hash.

    Two sets alike to ALIKE have one in common among the first n - ceil(ALIKE * n) + 1,
    whatever the order is, if it is one for all sets.
    """
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        shingles = shingles[np.lexsort((shingles, np.where(common[at] == shingles, rank[at], 0)))]
    return shingles[: len(shingles) + (-4 * len(shingles) // 5) + 1]


def signature(shingles: np.ndarray) -> np.ndarray:
    """SIGN bits as signed longs: each tells whether an odd number of the set's hashes falls to it.

    Two sets differ in as many hashes at least as their signatures differ in bits.
    """
    odd = np.bincount((shingles & np.uint64(SIGN - 1)).astype(np.int64), minlength=SIGN) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def bucket(shingles: np.ndarray) -> np.ndarray:
    """Where a shingle is counted, of signed or unsigned hashes."""
    return shingles.view(np.uint64) & np.uint64(BUCKETS - 1)


@dataclass
class Common:
    """How often the shingles of all documents fall into each bucket.

    The ranks order the shingles of a prefix and ``hot`` routes what is grouped; no
    result depends on either, so that shingles may share a bucket.
    """

    rank: np.ndarray  # of a bucket: 0, or more the fuller it is
    hot: np.ndarray  # buckets that could fill a task
    shingles: float  # prefix shingles of the whole table


def common_shingles(rows: DataFrame) -> Common:
    """From all documents, of which each counts a shingle once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.uint32)  # of one task
        for b in batches:
            for t in b.column("text"):
                np.add.at(counts, bucket(np.unique(shingle_hashes(t.as_py(), WORDS))), np.uint32(1))
        if counts.any():
            packed = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(packed, pa.binary())], ["slice", "counts"])

    def add(key, table):
        total = np.zeros(BUCKETS // SLICES, dtype=np.uint64)
        for x in table.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_py()), dtype=np.uint32)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    counted = rows.select("text").mapInArrow(tidy(run), "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, counts binary")
    counts = np.zeros((SLICES, BUCKETS // SLICES), dtype=np.uint64)
    for r in counted.collect():
        counts[r.slice] = np.frombuffer(zlib.decompress(r.counts), dtype=np.uint64)
    counts = counts.ravel()
    held, rank, hot = int(counts.sum()), np.zeros(BUCKETS, dtype=np.uint8), np.zeros(BUCKETS, dtype=bool)
    if held and COMMON:
        least = max(1, int(np.partition(counts, -COMMON - 1)[-COMMON - 1]))  # at most COMMON buckets hold more
        full = counts > least
        rank[full] = np.minimum(255, 1 + 8 * np.log2(counts[full] / least))
        hot = counts > held / BUCKETS + max(SMALL, HOT_SHARE * rows.count())
    return Common(rank, hot, held / 5)


#: Both sets of a pair that stands in a group may still share enough: the shingle that
#: they share first has no more of them behind it than either set has left.
_WITHIN = "9 * least(n - pos, n2 - pos2) >= 4 * (n + n2)"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, mark, n, pos) of all prefix shingles of a batch of ``prefixes``."""
    for b in batches:
        lists = b.column("keys")
        size = np.diff(lists.offsets.to_numpy())
        keys = lists.flatten().to_numpy()
        at = np.arange(len(keys), dtype=np.int32) - np.repeat(np.cumsum(size) - size, size).astype(np.int32)
        yield keys, np.repeat(b.column("mark").to_numpy(), size), np.repeat(b.column("n").to_numpy(), size), at


_ENTRY = ["key", "mark", "n", "pos"]


def _met(key, table):
    """The entries of keys that several sets have, each set once, and how many they are."""
    k, m, n, pos = (np.concatenate([np.empty(0, np.int64), *(c.flatten().to_numpy() for c in table.column(x).chunks)]) for x in _ENTRY)
    order = np.lexsort((pos, m, k))
    k, m, n, pos = (x[order] for x in (k, m, n, pos))
    first = np.ones(len(k), dtype=bool)
    first[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
    k, m, n, pos = (x[first] for x in (k, m, n, pos))
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    count = np.repeat(np.diff(begin, append=len(k)), np.diff(begin, append=len(k)))
    on = count > 1
    return pa.table({"key": k[on], "mark": m[on], "n": n[on].astype(np.int32), "pos": pos[on].astype(np.int32), "count": count[on].astype(np.int64)})


def groups(prefixes: DataFrame, common: Common) -> DataFrame:
    """key, mark, n, pos and ``count`` of every prefix shingle that several sets have; ``prefixes``: mark, n, keys.

    Most prefix shingles stand in one set alone.  They travel once, packed, to the
    task of their hash, and only those that meet come out of it as rows.  Shingles
    of hot buckets, which could fill such a task, are grouped as rows instead, after
    each task has counted its own.
    """
    tasks = max(1, math.ceil(common.shingles / GROUPED))
    hot = np.flatnonzero(common.hot).astype(np.uint64)

    def is_hot(k: np.ndarray) -> np.ndarray:
        return np.isin(bucket(k), hot)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entries in _entries(batches):
            cold = ~is_hot(entries[0])
            entries = [x[cold] for x in entries]
            # shingles are hashes already
            to = ((entries[0].view(np.uint64) >> np.uint64(20)) % np.uint64(tasks)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            task, size = np.unique(to, return_counts=True)
            ends = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in entries]
            yield pa.RecordBatch.from_arrays([pa.array(task), *lists], ["task", *_ENTRY])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entries in _entries(batches):
            on = is_hot(entries[0])
            yield pa.RecordBatch.from_arrays([pa.array(x[on]) for x in entries], _ENTRY)

    rows = prefixes.select("mark", "n", "keys")
    packed = rows.mapInArrow(tidy(deal), "task long, key array<long>, mark array<long>, n array<int>, pos array<int>")
    met = packed.groupBy("task").applyInArrow(_met, "key long, mark long, n int, pos int, count long")
    frequent = rows.mapInArrow(single, "key long, mark long, n int, pos int").groupBy("key", "mark").agg(F.min("n").alias("n"), F.min("pos").alias("pos"))
    frequent = stored(frequent, "frequent")
    sizes = frequent.groupBy("key").count().filter("count > 1")
    return stored(met.unionByName(join_groups(frequent, sizes, ["key"], "count").select(*met.columns)), "groups")


def nominated(members: DataFrame) -> DataFrame:
    """All pairs (u, v) of sets that may be alike to ALIKE or more, of those in ``groups``."""
    other = members.select("key", F.col("mark").alias("v"), F.col("n").alias("n2"), F.col("pos").alias("pos2"))
    return members.select("key", F.col("mark").alias("u"), "n", "pos").join(other, "key").filter("v < u").filter(_WITHIN).select("u", "v").distinct()


def with_hubs(members: DataFrame) -> DataFrame:
    """Of those pairs the ones with HUBS members of the group."""
    slot = F.pmod(F.xxhash64("mark"), F.lit(HUBS)).alias("slot")
    hubs = members.groupBy("key", slot).agg(F.min(F.struct(F.col("mark").alias("v"), F.col("n").alias("n2"), F.col("pos").alias("pos2"))).alias("h")).select("key", "h.*")
    far = members.join(hubs, "key").filter("v != mark").filter(_WITHIN)
    return far.select(F.greatest("mark", "v").alias("u"), F.least("mark", "v").alias("v")).distinct()


#: Sets alike to ALIKE differ in a ninth of their hashes at most, and their signatures in no more bits.
_SIGNS = "9 * (" + " + ".join(f"bit_count(sig[{i}] ^ sig2[{i}])" for i in range(SIGN // 64)) + ") <= n + n2"


def plausible(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """The pairs (u, v) that their signatures (mark, n, sig) do not rule out."""
    u = signs.select(F.col("mark").alias("u"), "n", "sig")
    v = signs.select(F.col("mark").alias("v"), F.col("n").alias("n2"), F.col("sig").alias("sig2"))
    return pairs.join(u, "u").join(v, "v").filter(_SIGNS).select("u", "v")


def across(members: DataFrame, links: DataFrame, signs: DataFrame) -> DataFrame:
    """Of those pairs all that ``links`` do not tie already, directly or through others.

    Each has a member outside the group's largest component, so such members alone
    are compared with all.  Both sides are dealt into blocks of BLOCK rows, and the
    signatures (mark, sig) rule out, without loss, most pairs that are not alike.
    """
    tied = components(links)
    parts = stored(members.drop("count").join(tied.withColumnRenamed("node", "mark"), "mark", "left").withColumn("component", F.coalesce("component", "mark")), "parts")
    sizes = parts.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    most = sizes.groupBy("key").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("m"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    most = most.select("key", F.col("top.component").alias("top"), F.ceil(F.col("m") / BLOCK).alias("all_blocks"), F.ceil((F.col("m") - F.col("top.c")) / BLOCK).alias("blocks"))
    open_ = stored(parts.join(most, "key").join(signs.select("mark", "sig"), "mark"), "open")
    place, every = lambda n: F.pmod(F.xxhash64("mark"), F.col(n)), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = open_.filter("component != top").select("key", "mark", "n", "pos", "sig", "component", place("blocks").alias("a"), every("all_blocks").alias("b"))
    right = open_.select("key", F.col("mark").alias("v"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("sig").alias("sig2"), F.col("component").alias("c2"), "top", place("all_blocks").alias("b"), every("blocks").alias("a"))
    met = left.join(right, ["key", "a", "b"]).filter("component != c2 and (c2 = top or v < mark)").filter(_WITHIN).filter(_SIGNS)
    return met.select(F.greatest("mark", "v").alias("u"), F.least("mark", "v").alias("v")).distinct()


def near_links(docs: DataFrame) -> DataFrame:
    """Links (u, v) between documents whose five-word shingles are alike to ALIKE or more,
    as many as keep the components.

    Sets that share one of their rarest shingles (``prefix``) are nominated, which
    misses no such pair at any number of rows.  The whole shingle sets of the
    nominated decide.  In a group of more than SMALL sets all are compared with a
    few first; then every pair that is not tied by that.  Rows of equal sets are
    collapsed first.  Texts without words link to nothing.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    common = common_shingles(rows)
    rank = common.rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, marks, sizes, firsts, sigs = [], [], [], [], []
            for i, t in zip(b.column("doc_id"), b.column("text"), strict=True):
                whole = sketch(t.as_py())
                if whole:
                    hashes = np.frombuffer(whole, "<u8")
                    ids.append(i.as_py())
                    marks.append(mark(whole))
                    sizes.append(len(hashes))
                    firsts.append(prefix(hashes, hashes, rank[bucket(hashes)]).view(np.int64))
                    sigs.append(signature(hashes))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((ids, marks, sizes, firsts, sigs), kinds, strict=True)], ["doc_id", "mark", "n", "keys", "sig"])

    raw = stored(rows.mapInArrow(tidy(run), "doc_id long, mark long, n int, keys array<long>, sig array<long>"), "prefixes")
    heads = stored(raw.groupBy("mark").agg(F.min("doc_id").alias("id")), "prefix-heads")
    same = raw.select("doc_id", "mark").join(heads, "mark").select(F.col("doc_id").alias("u"), F.col("id").alias("v")).filter("u != v")
    members = groups(raw, common)
    signs = raw.join(members.select("mark").distinct(), "mark", "left_semi").select("mark", "n", "sig").dropDuplicates(["mark"])
    signs = stored(signs, "signatures")
    small, large = members.filter(F.col("count") <= SMALL), members.filter(F.col("count") > SMALL)
    tried = stored(plausible(nominated(small).unionByName(with_hubs(large)).distinct(), signs), "pairs")
    found = stored(verified(rows, heads, tried), "alike")
    if not large.isEmpty():
        left = across(large, found, signs).join(tried, ["u", "v"], "left_anti")
        found = found.unionByName(verified(rows, heads, stored(left, "pairs")))
    found = found.join(heads.select(F.col("mark").alias("u"), F.col("id").alias("a")), "u").join(heads.select(F.col("mark").alias("v"), F.col("id").alias("b")), "v")
    return found.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(same)


def near_dedup(docs: DataFrame) -> DataFrame:
    """One document of each family stays, that with the smallest id; rows without an id stay.

    Families are tied by close fingerprints (as in ``families``) and by five-word
    shingles alike to four fifths (``near_links``).  Of rows that repeat an id those
    with another text are documents of their own; of rows alike in both one stays.
    """
    # whole rows travel as one column, so that no name of theirs can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("node"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    twice = stored(rows.select(F.col("node").alias("id")).filter("id is not null").groupBy("id").count().filter("count > 1").select("id"), "twice")
    repeated = not twice.isEmpty()
    if repeated:
        again = rows.withColumn("sha", F.sha2("text", 256)).join(twice, F.col("node") == F.col("id"), "left")
        first = again.filter("id is not null").groupBy(F.col("id").alias("id1")).agg(F.min("sha").alias("sha1"))
        again = again.join(first, F.col("id") == F.col("id1"), "left")
        other = F.lit(BEYOND) + F.shiftrightunsigned(F.xxhash64("id", "sha"), 2)
        rows = stored(again.withColumn("node", F.when(F.col("sha") != F.col("sha1"), other).otherwise(F.col("node"))).drop("id1", "sha1"), "nodes")
    named = rows.select(F.col("node").alias("doc_id"), "text")
    tight = stored(families(named), "families")
    ties = tight.filter("doc_id is not null and doc_id != component_id").select(F.col("doc_id").alias("u"), F.col("component_id").alias("v"))
    found = components(ties.unionByName(near_links(named)))
    gone = found.filter("node != component").select(F.col("node").alias("gone")).distinct()
    kept = rows.join(gone, F.col("node") == F.col("gone"), "left_anti")
    if repeated:
        kept = kept.filter("id is null").unionByName(kept.filter("id is not null").dropDuplicates(["id", "sha"]))
    return kept.select("row.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families(documents(spark, sf_dir))


QUERIES = {"op3_simhash": op3_simhash}
ORACLES: dict[str, str] = {}
