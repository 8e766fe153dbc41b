"""Token-ID output: Arrow IPC files of equal-length sequences and masks.

Each file holds one range of documents in ascending ``doc_id`` order (nulls
first, repeated ids by a hash of the text, so that many of them need not meet in one
file).  Files follow the bytes of the input (``FILE_BYTES``).  Its record batches have two fixed-size-list columns, ``ids`` and
``mask``; a batch is one contiguous buffer, so that a reader that maps the file
into memory reaches any sequence without copying.  A second Arrow file beside it
lists the documents: ``doc_id``, ``start`` (ids of the file before it) and
``n_tokens``.  Ids take 16 bits where the vocabulary allows it, masks one bit.

Empty and null texts give the end id alone.  The last sequence of a file is
padded with the end id under a mask of zeros.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import default_tokenizer, encoder, text_groups
from .shared import documents, require, stored, table_path, tidy

#: Sequences in a record batch.
BATCH = 64


def file_system(uri: str):
    """(Arrow file system, path) of a folder that Spark names by path or URI."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class _Writer:
    """Streams ids into the sequences of one file."""

    def __init__(self, folder: str, name: str, dtype: np.dtype, length: int, end_id: int):
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        self.path, self.index_path = f"{folder}/{name}.arrow", f"{folder}/{name}.docs.arrow"
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self._files = [fs.open_output_stream(f"{path}/{name}.arrow"), fs.open_output_stream(f"{path}/{name}.docs.arrow")]
        self._out = pa.ipc.new_file(self._files[0], self.schema)
        self._index = pa.ipc.new_file(self._files[1], self.index_schema)
        self._length, self._end = length, end_id
        self._full = np.empty(BATCH * length, dtype=dtype)
        self._at = 0
        self.n_tokens = 0
        self.n_docs = 0

    def add(self, doc_ids: list, arrays: list[np.ndarray]) -> None:
        starts, counts = [], []
        for a in arrays:
            starts.append(self.n_tokens)
            counts.append(len(a))
            self.n_tokens += len(a)
            at = 0
            while at < len(a):
                n = min(len(a) - at, len(self._full) - self._at)
                self._full[self._at : self._at + n] = a[at : at + n]
                at += n
                self._at += n
                if self._at == len(self._full):
                    self._flush()
        self.n_docs += len(doc_ids)
        self._index.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=self.index_schema))

    def _flush(self) -> None:
        n = -(-self._at // self._length)
        if not n:
            return
        ids = self._full[: n * self._length].copy()
        ids[self._at :] = self._end
        mask = np.zeros(n * self._length, dtype=bool)
        mask[: self._at] = True
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), self._length) for x in (ids, mask)]
        self._out.write_batch(pa.record_batch(cols, schema=self.schema))
        self._at = 0

    def close(self) -> None:
        self._flush()
        self._out.close()
        self._index.close()
        for f in self._files:
            f.close()


class TokenFile:
    """Random access to the sequences of one file, without copying where the file is local."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        local = type(fs).__name__ == "LocalFileSystem"
        self._source = pa.memory_map(path) if local else fs.open_input_file(path)
        self._file = pa.ipc.open_file(self._source)
        self.length = self._file.schema.field("ids").type.list_size

    def batches(self) -> Iterator[pa.RecordBatch]:
        return (self._file.get_batch(i) for i in range(self._file.num_record_batches))

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view of the mapped file) and mask of sequence ``i``."""
        b = self._file.get_batch(i // BATCH)
        at = i % BATCH
        ids = b.column(0).slice(at, 1).flatten().to_numpy(zero_copy_only=True)
        return ids, b.column(1).slice(at, 1).flatten()

    def stream(self) -> Iterator[np.ndarray]:
        """The ids under the mask, batch by batch."""
        for b in self.batches():
            ids = b.column(0).flatten().to_numpy(zero_copy_only=True)
            n = b.column(1).flatten().true_count
            yield ids[:n]


#: Bytes of the input (as stored) that make a file, about.
FILE_BYTES = 64 << 20


def _files(docs: DataFrame) -> int:
    """By the size that Spark expects of the input; as many as its shuffles have partitions at least."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // FILE_BYTES), 1 << 20))


MANIFEST = "part long, path string, index_path string, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, length: int = 2048, end_id: int = 0) -> DataFrame:
    """Encode and write; returns the manifest, one row per file in the order of ``part``.

    Only the files that the manifest names count: a task that runs again after a
    lost executor writes under a new name.
    """
    require(docs, ["doc_id", "text"])
    tokenizer = tokenizer or default_tokenizer()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e, w, part = encoder(tokenizer), None, TaskContext.get().partitionId()
        end = np.array([end_id], dtype=e.dtype)
        for ids, texts in text_groups(batches):
            w = w or _Writer(folder, f"{part:06d}-{uuid.uuid4().hex}", e.dtype, length, end_id)
            w.add(ids, [np.concatenate([a, end]) for a in e.encode(texts)])
        if w:
            w.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [w.path], "index_path": [w.index_path], "n_docs": [w.n_docs], "n_tokens": [w.n_tokens]})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(_files(docs), "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    return stored(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Each document as the files give it back: doc_id, start, n_tokens, ids_crc32."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("path", "index_path", "base")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                stream, held = TokenFile(row["path"]).stream(), np.empty(0, np.uint16)
                for ib in TokenFile.index(row["index_path"]):
                    crcs = []
                    for n in ib.column("n_tokens").to_pylist():
                        crc = 0
                        while n:
                            if not len(held):
                                held = next(stream)
                            crc = zlib.crc32(held[:n].astype("<u4"), crc)
                            n, held = n - min(n, len(held)), held[n:]
                        crcs.append(crc)
                    starts = pa.array(ib.column("start").to_numpy() + row["base"])
                    yield pa.RecordBatch.from_arrays([ib.column("doc_id"), starts, ib.column("n_tokens"), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(max(1, manifest.count())).mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _index(uri: str) -> Iterator[pa.RecordBatch]:
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        file = pa.ipc.open_file(f)
        for i in range(file.num_record_batches):
            yield file.get_batch(i)


TokenFile.index = staticmethod(_index)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(documents(spark, sf_dir), table_path(spark, "token-files"))
    return read_token_files(spark, manifest)


QUERIES = {"op4_token_files": op4_token_files}
ORACLES: dict[str, str] = {}
