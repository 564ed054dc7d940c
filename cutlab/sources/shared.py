"""Tables in the folder that all executors share, to cut a long plan where its parts would be computed again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What this process has kept and not yet released.
_KEPT: list[str] = []


def keep(df: DataFrame) -> DataFrame:
    """Writes ``df`` below ``spark.checkpoint.dir`` and reads it back; unset on one machine, as in tests, a temporary folder is set."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    _KEPT.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes all that ``keep`` has written so far, once no frame that reads it is needed any more; returns how many tables."""
    done = len(_KEPT)
    while _KEPT:
        place = spark._jvm.org.apache.hadoop.fs.Path(_KEPT.pop())
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return done
