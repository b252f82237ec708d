"""Session, scratch-table and Arrow helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import on_one_machine, ship

#: Rows and bytes of one Arrow batch between the JVM and a Python worker; texts can be long.
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20
#: Text bytes that one numpy pass works on.
PASS_BYTES = 1 << 19
BLANK = re.compile(rb"[ \t-\r]")


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches and let Python workers import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return ship(spark)


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside gets Arrow batches of so many rows: for rows of a few bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="controlspark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the whole cluster shares: ``spark.checkpoint.dir``.

    Where it is unset and the executors are threads of this process (tests), a
    temporary folder serves; on a cluster a folder of one machine would lose
    rows, so an unset one is an error there.
    """
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    if not on_one_machine(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return _own_folder()


class Scratch:
    """Tables written to the shared folder.

    A written table cuts the lineage and outlives the executors that wrote it.
    Spark removes the tables when its file system closes; ``drop`` removes one
    earlier.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = prepare(spark)
        self.root = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
        path, fs = self._fs(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables, and lets Spark find the shuffles that only they needed."""
        for name in names:
            path, fs = self._fs(f"{self.root}/{name}")
            fs.delete(path, True)
        gc.collect()
        self.spark._jvm.System.gc()


def own_ids(docs: DataFrame) -> bool:
    """Whether every row has a doc_id of its own."""
    return docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty()


def with_row_keys(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with a column __row, of another value in each row, in the order of doc_id (nulls last).

    Where every row has a doc_id of its own, that is its key. Otherwise the rows
    are sorted, numbered and written; rows that repeat a doc_id, or lack one,
    are numbered in the order in which they are read.
    """
    prepare(docs.sparkSession)
    if own_ids(docs):
        return docs.withColumn("__row", F.col("doc_id").cast("bigint"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("__place")]
    placed = docs.withColumn("__place", F.monotonically_increasing_id())
    # The partitions are ranges in order, so the number grows with the order.
    numbered = placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id())
    return scratch.save("rows", numbered.drop("__place"))


def tidy(f: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """f, whose task ends by giving freed memory back: a Python worker lives on and serves other stages."""

    @functools.wraps(f)
    def run(*args):
        try:
            yield from f(*args)
        finally:
            release()

    return run


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not on every C library
        ctypes.CDLL(None).malloc_trim(0)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; a null counts as an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def passes(batch: pa.RecordBatch, column: str = "text", limit: int = PASS_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of rows of about ``limit`` text bytes: the first row's index and the texts."""
    start, size, run = 0, 0, []
    for i, text in enumerate(as_bytes(batch.column(column))):
        if run and size + len(text) > limit:
            yield start, run
            start, size, run = i, 0, []
        run.append(text)
        size += len(text)
    if run:
        yield start, run


def cut(text: bytes, limit: int = PASS_BYTES) -> list[bytes]:
    """A text in parts of ``limit`` bytes or a little more, cut after white space; a longer word stays whole."""
    out, at = [], 0
    while len(text) - at > limit and (m := BLANK.search(text, at + limit)):
        out.append(text[at : m.end()])
        at = m.end()
    return [*out, text[at:]]


def part_passes(texts: list[bytes], limit: int = PASS_BYTES) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Runs of parts of texts of about ``limit`` bytes: the index of each part's text, and the parts."""
    of, run, size = [], [], 0
    for i, text in enumerate(texts):
        for part in [text] if len(text) <= limit else cut(text, limit):
            if run and size + len(part) > limit:
                yield np.array(of), run
                of, run, size = [], [], 0
            of.append(i)
            run.append(part)
            size += len(part)
    if run:
        yield np.array(of), run


def integers(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64)


def batch_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
