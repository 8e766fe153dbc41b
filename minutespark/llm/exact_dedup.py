"""Exact deduplication by composable polynomial fingerprints.

The fingerprint of a byte string is its value as a polynomial at a fixed point,
modulo the prime 2^61 - 1.  Fingerprints compose: H(a + b) = H(a) * X^len(b) + H(b),
so the chunks of a text can be hashed apart, in any order, and combined by
length-shifted arithmetic.  The chunks of huge documents are hashed in parallel
where the document is read; sending them elsewhere costs more than hashing them.

Fingerprints only nominate.  Texts of equal fingerprint and length are then
compared chunk by chunk as they stream by; where a group holds different texts,
it is divided by SHA-256.

Null texts count as empty.  Of equal texts the smallest doc_id stays, null ids
last; of rows that even share the id, one stays.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WS, documents, join_groups, require, stored, tidy

PRIME = (1 << 61) - 1
POINT = 0x1B873593CC9E2D51 % PRIME
#: Bytes of a chunk in hashing and in comparison.
CHUNK = 1 << 16
#: The chunks of texts with more bytes are hashed side by side, by so many threads.
HUGE = 1 << 24
THREADS = 4

_LOW = (1 << 31) - 1
_powers: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """Powers of POINT in halves of 31 bits, the highest first."""
    if not _powers:
        x, out = 1, np.empty(CHUNK, dtype=np.uint64)
        for i in range(CHUNK - 1, -1, -1):
            out[i] = x
            x = x * POINT % PRIME
        _powers.extend([out & np.uint64(_LOW), out >> np.uint64(31)])
    return _powers


def chunk_hash(data: bytes) -> int:
    """Of at most CHUNK bytes.  Each is raised by one, so that zero bytes count."""
    low, high = _tables()
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    n = len(b)
    if not n:
        return 0
    return (int(b @ low[-n:]) + (int(b @ high[-n:]) << 31)) % PRIME


def combine(left: int, right: int, right_len: int) -> int:
    return (left * pow(POINT, right_len, PRIME) + right) % PRIME


def fingerprint(data: bytes) -> int:
    at = range(0, len(data), CHUNK)
    parts = [data[i : i + CHUNK] for i in at] if len(data) <= HUGE else [memoryview(data)[i : i + CHUNK] for i in at]
    hashes = map(chunk_hash, parts) if len(data) <= HUGE else ThreadPoolExecutor(THREADS).map(chunk_hash, parts)
    h = 0
    for x, part in zip(hashes, parts, strict=True):
        h = combine(h, x, len(part))
    return h


_SPACES = bytes(32 if 9 <= i <= 13 else i for i in range(256))
_RUN = re.compile(rb" {2,}")


def normalized(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass").translate(_SPACES)
    return _RUN.sub(b" ", data) if b"  " in data else data


def normal_column(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WS + "+", " ")


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hashes, sizes, shas = [], [], []
        for t in b.column("text"):
            data = normalized(t.as_py())
            hashes.append(fingerprint(data))
            sizes.append(len(data))
            shas.append(hashlib.sha256(data).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(shas)], ["doc_id", "fp", "n_bytes", "text_sha256"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp, n_bytes, text_sha256 of every row; one scan, no shuffle."""
    require(docs, ["doc_id", "text"])
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(_hash_rows), "doc_id long, fp long, n_bytes long, text_sha256 string")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The normalised texts as chunks under their fingerprint."""
    names = ["fp", "n_bytes", "pos", "chunk"]
    for b in batches:
        rows, size = [], 0
        for t in b.column("text"):
            data = normalized(t.as_py())
            h = fingerprint(data)
            rows += [(h, len(data), at, data[at : at + CHUNK]) for at in range(0, max(1, len(data)), CHUNK)]
            size += len(data)
            if size > 1 << 23:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)


def collisions(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Fingerprints under which the named documents hold more than one text.

    All chunks of a group at one position are compared as they stream by: the least
    and the greatest are equal exactly if all are.  Each task compares its own
    first, so a group of any size sends one pair a task and chunk.
    """
    d, i = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), ids.select(F.col("doc_id").alias("other_id")).distinct()
    named = d.join(i, F.col("doc_id") == F.col("other_id"), "left_semi")
    # rows without an id, however many, are no key of a join: all are compared if one is named
    nameless = d.filter("doc_id is null").join(F.broadcast(i.filter("other_id is null").limit(1)))
    parts = named.select("text").unionByName(nameless.select("text")).mapInArrow(tidy(_chunks), "fp long, n_bytes long, pos long, chunk binary")
    compared = parts.groupBy("fp", "n_bytes", "pos").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
    return compared.filter("least != most").select("fp", "n_bytes").distinct()


def decisions(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = stored(fingerprints(docs).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    key = ["fp", "n_bytes"]
    several = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    unequal = stored(collisions(docs, join_groups(rows, several, key, "n").select("doc_id")), "collisions")
    if unequal.isEmpty():
        rows = rows.withColumn("class", F.lit(""))
    else:
        rows = rows.join(unequal.withColumn("odd", F.lit(True)), key, "left").withColumn("class", F.when(F.col("odd"), F.col("text_sha256")).otherwise("")).drop("odd")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))).alias("first")
    groups = rows.groupBy(*key, "class").agg(first, F.count(F.lit(1)).alias("group_size"))
    # one text may be that of a third of all rows
    rows = stored(rows, "classes") if not unequal.isEmpty() else rows
    return join_groups(rows, groups, [*key, "class"], "group_size").select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, with the columns they came with."""
    found = stored(decisions(docs), "exact-decisions")
    kept = found.filter("kept").select(F.col("doc_id").alias("__kept_id"), F.col("text_sha256").alias("__kept_sha"))
    same_id = F.col("doc_id").cast("long").eqNullSafe(F.col("__kept_id"))
    if found.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return docs.join(kept, same_id, "left_semi")
    # ids that repeat: the text decides too, and of rows alike in both one stays
    sha = F.sha2(F.encode(normal_column(F.col("text")), "UTF-8"), 256)
    left = docs.join(kept, same_id & (sha == F.col("__kept_sha")), "left_semi")
    twice = found.groupBy("doc_id", "text_sha256").count().filter("count > 1").select(F.col("doc_id").alias("__kept_id"), F.col("text_sha256").alias("__kept_sha"))
    alike = same_id & (sha == F.col("__kept_sha"))
    single = left.join(twice, alike, "left_anti")
    return single.unionByName(left.join(twice, alike, "left_semi").withColumn("__sha", sha).dropDuplicates(["doc_id", "__sha"]).drop("__sha"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(documents(spark, sf_dir))


OP7_SQL = """
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""

QUERIES = {"op7_exact_dedup": op7_exact_dedup}
ORACLES = {"op7_exact_dedup": OP7_SQL}
