"""Helpers shared by the training-data operators.

Tables that a job reads more than once are written as Parquet into the folder that the session names in
``spark.checkpoint.dir``, which every executor can read, so a lost executor never loses an intermediate result.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.  In local mode (tests) one is made if it names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="quillgraph-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return qualified(spark, path.rstrip("/"))


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme and authority of the file system that Spark takes it to be on."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/quillgraph/{name}-{uuid.uuid4().hex}"


#: Rows in a file of an intermediate table whose size is known beforehand.
ROWS_PER_FILE = 100_000


def files_for(rows: int) -> int:
    """Files for a table of narrow rows."""
    return max(1, -(-rows // ROWS_PER_FILE))


def written(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and computes it once.

    ``files``: how many at most, for tables that are small for the number of shuffle partitions.
    """
    path = scratch_path(df.sparkSession, name)
    (df if files is None else df.coalesce(files)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower_words(text: str | None) -> list[bytes]:
    """UTF-8 words of a text: A-Z lower-cased, split at space and U+0009 to U+000D.  Null has no words."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def blocks_of(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Split record batches so that the texts of each hold at most ``max_bytes`` bytes (or are one single row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        yield batch.slice(start)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Record batches put together, so that each but the last has at least so many rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


Batches = Iterator[pa.RecordBatch]


def freeing(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for ``mapInArrow``, after which the worker gives back what it no longer holds: it stays for later stages, whose
    workers come on top."""

    def then_free(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim is not None:
                trim(0)

    return then_free
