"""What several operators of this package need: tables in the shared folder,
the token cutter, and a columns guard."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One space, tab, LF, VT, FF, CR: the white space of the contracts, for Java regexes.
WS = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    (local tests) a temporary folder takes its place.
    """
    sc = spark.sparkContext
    local = sc.master.startswith("local[") or sc.master == "local"
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.getCheckpointDir():
        if not local:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="minutespark-"))
    return sc.getCheckpointDir().rstrip("/")


def table_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/minutespark/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the re-read of a file, not the
    work that led to it.
    """
    spark = df.sparkSession
    path = table_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes all tables and files that this package stored; results read from them must be kept elsewhere first."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/minutespark")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Rows and bytes of an Arrow batch.  Whole texts travel in them: the default of 10,000
#: rows would hold tens of MB of text in each task, twice, outside of the heap, and a
#: thousand texts of a megabyte each would be a gigabyte.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def require(df: DataFrame, names: Iterable[str]) -> None:
    """Checks the columns, and lowers the bounds of the batches in which rows go to Python.

    The bounds are settings of the session that Spark reads when a query runs, so they
    stay lowered; results do not depend on them.
    """
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(str(conf.get(f"spark.sql.execution.arrow.{name}")).lower().rstrip("b") or 0)
        if not 0 < now <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def give_back() -> None:
    """Hand freed memory back to the system: a worker that waits for its next task holds less."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, which hands its memory back at the end of a task."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


#: Groups of more than one in so many of all rows are joined apart.
HOT = 1024


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], size: str) -> DataFrame:
    """Each row of the stored table ``rows`` with its group's; ``size`` is the column of the groups' row counts.

    Groups of over one HOTth of all rows are fewer than HOT, so they are broadcast;
    of the others, which meet their rows by a shuffle, none can fill a task.
    """
    least = max(1, rows.count() // HOT)
    hot = F.broadcast(groups.filter(F.col(size) > least))
    cold = groups.filter(F.col(size) <= least)
    rest = rows.join(hot.select(*key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(cold, key))


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows in the order of a hash of ``key``.

    Where there are many more, a threshold on the hash thins them where they are
    read, so that what is ordered is little more than ``n`` rows, not n a task.
    """
    h = F.xxhash64(key)
    share = 1.2 * n / max(1, df.count())
    if share < 1:
        df = df.filter(F.pmod(F.shiftrightunsigned(h, 20), F.lit(1 << 40)) < int(share * (1 << 40)))
    return df.orderBy(h, key).limit(n)
