"""Writing by key: upserts, replacement, cascades.  All are pure; ``swap_table`` stores a result."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str | Sequence[str], *order: Column) -> DataFrame:
    """One row a key: the first in the given order."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """Incoming rows (one a key) replace existing ones; columns in ``keep`` stay as they were.

    One shuffle by the key: both sides are stacked and each key's rows merged by a
    grouped aggregate that combines before the exchange.  A null key, or one that a
    side repeats, fails the write, as a unique constraint would.
    """
    columns = existing.columns
    # by name of type: whether an array may hold nulls is no matter of casting
    kinds = {f.name: f.dataType.simpleString() for f in existing.schema}
    row = f"struct<{','.join(f'`{c}`:{k}' for c, k in kinds.items())}>"
    old = existing.select(key, F.struct(*columns).cast(row).alias("old"), F.lit(None).cast(row).alias("new"))
    new = incoming.select(key, F.lit(None).cast(row).alias("old"), F.struct(*[F.col(c).cast(kinds[c]).alias(c) for c in columns]).alias("new"))
    one = lambda side: F.when((F.count(side) > 1) | F.col(key).isNull(), F.raise_error(F.concat(F.lit(f"{key} is null or repeated: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.first(side, ignorenulls=True))
    both = old.unionByName(new).groupBy(key).agg(one("old").cast(row).alias("old"), one("new").cast(row).alias("new"))
    picked = [F.coalesce(F.col(f"old.{c}"), F.col(f"new.{c}")).alias(c) if c in keep else F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in columns if c != key]
    return both.select(key, *picked).select(*columns)


def upsert_metadata(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """By url; a known meeting keeps its doc_id."""
    return upsert(existing, incoming, "url", keep=["doc_id"])


def upsert_summaries(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """By doc_id; ``created_at`` becomes the time of the update."""
    if "created_at" in existing.columns and "created_at" not in incoming.columns:
        incoming = incoming.withColumn("created_at", F.current_timestamp())
    return upsert(existing, incoming, "doc_id")


def delete_documents(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select("doc_id"), "doc_id", "left_anti")


def replace_chunks(chunks: DataFrame, incoming: DataFrame) -> DataFrame:
    """All chunks of the documents in ``incoming`` give way to those."""
    return delete_documents(chunks, incoming.select("doc_id").distinct()).unionByName(incoming)


def cascade(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children whose parent is left (or that name none)."""
    return children.join(parents.select("doc_id"), "doc_id", "left_semi")


def latest_status(jobs: DataFrame) -> DataFrame:
    """Of each document the status reported last."""
    last = F.max_by(F.struct("status", "last_error"), F.struct("updated_at", "status")).alias("s")
    return jobs.groupBy("doc_id").agg(last, F.max("updated_at").alias("updated_at")).select("doc_id", "s.status", "s.last_error", "updated_at")


#: Ranges of documents whose chunks are numbered apart.
RANGES = 256


def _bounds(ids: DataFrame, ranges: int) -> list:
    """At most ``ranges`` values that cut the ids into parts of about one size, by a sample of 64 a range."""
    every = max(1, ids.count() // (64 * ranges))
    sample = [r[0] for r in ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).orderBy("doc_id").collect()]
    return list(dict.fromkeys(sample[:: max(1, len(sample) // ranges)]))[1:]


def with_chunk_ids(chunks: DataFrame, first: int = 1) -> DataFrame:
    """Ids in the order of (doc_id, pos): counts a document, then a running sum, so no row order is global.

    Ranges of documents are summed apart, then the few ranges in turn.  Their bounds
    are constants of the plan, so a task that runs again finds the same ranges.
    """
    counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n"))
    bounds = _bounds(counts.select("doc_id"), RANGES)
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    w = Window.partitionBy("__b").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("__b", at).withColumn("__in", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    totals = before.groupBy("__b").agg(F.sum("__n").alias("__t"))
    base = totals.withColumn("__base", F.coalesce(F.sum("__t").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = before.join(base, "__b").select("doc_id", (F.col("__base") + F.col("__in") + first).alias("__start"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    return chunks.join(starts, "doc_id").withColumn("chunk_id", F.col("__start") + F.row_number().over(order) - 1).drop("__start")


def _files(spark: SparkSession, path: str):
    """(file system, Path constructor) of a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table is there, after a swap that was cut short is undone.

    Between the two renames of ``swap_table`` the table stands under its old name
    only; it is put back, and what was to replace it is written again by whoever
    runs the write again.
    """
    fs, at = _files(spark, path)
    if fs.exists(at(path)):
        return True
    kept = fs.globStatus(at(f"{path}.old-*"))
    if not kept:
        return False
    last = max(kept, key=lambda f: f.getModificationTime()).getPath()
    if not fs.rename(last, at(path)):
        raise OSError(f"cannot put {last} back")
    return True


def swap_table(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write beside ``path``, then put the result in its place; never overwrites what is being read."""
    there = table_exists(spark, path)
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    fs, at = _files(spark, path)
    if there and not fs.rename(at(path), at(old)):
        raise OSError(f"cannot move {path} away")
    if not fs.rename(at(new), at(path)):
        raise OSError(f"cannot put {new} in the place of {path}")
    for left in fs.globStatus(at(f"{path}.old-*")) or []:
        fs.delete(left.getPath(), True)
