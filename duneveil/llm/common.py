"""What the operators of this subpackage share: word pattern, shared folder, written intermediate tables."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in Java's and RE2's syntax.
WORD = r"[^\x20\x09-\x0D]+"

#: After so many written tables what dropped plans still hold is collected.
COLLECT_EVERY = 6

_written: list[list[str]] = []
_saves = 0


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where a local session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    folder = os.path.join(tempfile.gettempdir(), "duneveil-shared")
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a cut in the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/duneveil/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _written:
        _written[-1].append(path)
    _collected(spark)
    return spark.read.schema(df.schema).parquet(path)


def _collected(spark: SparkSession) -> None:
    """Spark deletes shuffle files and broadcasts of plans that nobody holds when the driver collects its garbage, which a roomy
    one rarely does; an operator of many steps so would fill disks and the driver's memory."""
    global _saves
    _saves += 1
    if _saves % COLLECT_EVERY == 0:
        gc.collect()
        spark.sparkContext._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving the tables that were saved inside; what is still needed must be written elsewhere by then."""
    _written.append([])
    try:
        yield
    finally:
        paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in map(paths, _written.pop()):
            path.getFileSystem(conf).delete(path, True)


def private(*names: str) -> list[str]:
    """Column names that no table bears."""
    tag = uuid.uuid4().hex
    return [f"__{x}_{tag}" for x in names]


def row_key(*columns: str) -> Column:
    """A 64-bit hash that tells rows apart whose ids are null or repeated."""
    return F.xxhash64(*columns)


def n_words(text: Column) -> Column:
    """The number of words as a long; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
