"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only characters that separate words in the contracts.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a Java pattern for one word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the documents that no model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scratch_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.

    Where that is unset on one machine, as in tests, a temporary folder is set; on a cluster it has to be set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` once and reads it back: later steps neither recompute it nor hold its lineage."""
    spark, path = df.sparkSession, scratch_folder(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*frames: DataFrame) -> None:
    """Deletes what ``stored`` wrote for frames that nothing lazy reads any more."""
    for df in frames:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
            hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, what runs sends at most ``rows`` rows at once to a Python worker; for rows that are large each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def few_rows(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """Small rows, stored; sent to all tasks only where they are few, and joined by key beyond that."""
    rows = stored(rows)
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def linked_heads(near: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns of a matrix of links: the smallest id that each can reach within it."""
    head_a, head_b, top = ids_a.copy(), ids_b.copy(), np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(head_a, np.where(near, head_b[None, :], top).min(axis=1))
        new_b = np.minimum(head_b, np.where(near, new_a[:, None], top).min(axis=0))
        if (new_a == head_a).all() and (new_b == head_b).all():
            return head_a, head_b
        head_a, head_b = new_a, new_b
