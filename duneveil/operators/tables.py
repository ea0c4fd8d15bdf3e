"""A dataset is a dict of tables: DataFrames of text columns with a stable row number."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "__row"
#: The folder of the session that is open, if one is (see sessions).
writes_to: ContextVar[str | None] = ContextVar("writes_to", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, from spark.checkpoint.dir; a local one where a local session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return found.rstrip("/") if found else f"file://{os.path.join(tempfile.gettempdir(), 'duneveil-shared')}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, which cuts its lineage."""
    path = f"{writes_to.get() or shared_dir(df.sparkSession) + '/tables'}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """df in as many partitions as a shuffle has: rows of few bytes that take long must not come together in a few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def columns_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW]


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text: whole floats without a fraction, booleans lower case, midnight as a date, no exponents."""

    def text(name: str, kind: T.DataType) -> Column:
        c = F.col(f"`{name}`")
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
            return F.when(whole, c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.when(F.date_format(c, "HH:mm:ss") == "00:00:00", F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"))
        if isinstance(kind, T.BinaryType):
            return F.decode(c, "UTF-8")
        return c.cast("string")

    return df.select(*(F.col(f.name) if f.name == ROW else text(f.name, f.dataType).alias(f.name) for f in df.schema))


def numbered(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """df with ROW, 0, 1, 2 ... in the order in which it is read, without gathering it: rows are counted in each
    partition of a written copy, and each partition starts behind those before it.

    by: columns (of file and block) that order the pieces that are read, as Spark deals these by size; they are dropped.
    """
    kept = written(df.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    piece = F.struct(*by) if by else F.struct(F.shiftright("__id", 33))
    starts, at = [], 0
    for _, least, n in sorted(kept.groupBy(piece.alias("piece")).agg(F.min("__id"), F.count(F.lit(1))).collect()):  # a row for each partition or piece
        starts.append((least, n, at))
        at += n
    # rows of a piece follow one another in their partition, so its numbers are a range
    moves = df.sparkSession.createDataFrame([(least >> 33, least, least + n, first - least) for least, n, first in starts], "__part long, __from long, __to long, __move long")
    rows = kept.withColumn("__at", F.shiftright("__id", 33)).join(F.broadcast(moves), (F.col("__at") == F.col("__part")) & (F.col("__id") >= F.col("__from")) & (F.col("__id") < F.col("__to")))
    return rows.withColumn(ROW, F.col("__id") + F.col("__move")).drop("__id", "__at", "__part", "__from", "__to", "__move", *by)


def cells(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(ROW, column, value): a row for each cell."""
    columns = columns_of(df) if columns is None else columns
    if not columns:
        return df.sparkSession.createDataFrame([], f"{ROW} long, column string, value string")
    return df.unpivot(ROW, columns, "column", "value")


@dataclass(frozen=True)
class ForeignKey:
    child_table: str
    child_column: str
    parent_table: str
    parent_column: str
    containment: float = 1.0


@dataclass(frozen=True)
class ColumnProfile:
    table: str
    column: str
    dtype: str
    n_rows: int
    n_null: int
    n_unique: int
    mean_len: float
    arabic_ratio: float
    is_primary_key: bool = False


@dataclass
class Profile:
    columns: dict[tuple[str, str], ColumnProfile] = field(default_factory=dict)
    primary_keys: dict[str, str | None] = field(default_factory=dict)
    foreign_keys: list[ForeignKey] = field(default_factory=list)


@dataclass(frozen=True)
class Detection:
    table: str
    column: str
    tag: str
    kind: str | None = None
    score: float = 0.0
    valid_ratio: float = 0.0
    name_hint: bool = False
    needs_review: bool = False
    reason: str = ""
    human_override: bool = False


def numbered_in_group(df: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """df with `out`, a row's place (0, 1, ...) among the rows of its key by `order`, whose last column tells rows apart.

    Rows are dealt by ranges of key and order, so a key with very many rows is numbered in several tasks: places
    inside a range are added to the counts of the ranges before.  A null key gets a null place.
    """
    some = df.withColumn("_key", F.col(f"`{key}`"))
    ranged = written(some.repartitionByRange("_key", *order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part", "_key").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select(F.col("_part").alias("_p"), F.col("_key").alias("_k"), F.coalesce(before, F.lit(0)).alias("_first"))
    own = F.row_number().over(Window.partitionBy("_part", "_key").orderBy(*order)) - 1
    both = ranged.withColumn("_own", own).join(first, (F.col("_part") == F.col("_p")) & F.col("_key").eqNullSafe(F.col("_k")))
    place = F.when(F.col("_key").isNotNull(), F.col("_own") + F.col("_first"))
    return both.withColumn(out, place).drop("_key", "_part", "_p", "_k", "_own", "_first")


def exact_percentiles(values: DataFrame, shares: list[float]) -> dict[str, dict[float, float]]:
    """{group: {share: percentile}} of rows (g, v) or (g, v, n), interpolated between neighbours; a group without values is not in it.

    No task holds a group's values: counts by value are dealt by ranges of group and value, what comes before a range is known
    from the sizes of the ranges, and only the two values beside each percentile leave them.  Groups are few (columns).
    """
    n = F.col("n") if "n" in values.columns else F.lit(1)
    counts = values.select(F.col("g").cast("string").alias("g"), F.col("v").cast("double").alias("v"), n.cast("long").alias("n"))
    counts = counts.filter("g IS NOT NULL AND v IS NOT NULL AND NOT isnan(v) AND n > 0").groupBy("g", "v").agg(F.sum("n").alias("n"))
    ranged = written(counts.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()), "percentiles")
    totals: dict[str, int] = {}
    starts = []
    for part, group, size in sorted(ranged.groupBy("part", "g").agg(F.sum("n")).collect()):  # a row for each range and group
        starts.append((part, group, totals.get(group, 0)))
        totals[group] = totals.get(group, 0) + size
    if not totals:
        return {}
    places = {(g, s): (total - 1) * s for g, total in totals.items() for s in shares}
    spark = values.sparkSession
    firsts = spark.createDataFrame(starts, "p int, of string, first long")
    wanted = sorted({(g, min(int(p) + k, totals[g] - 1)) for (g, _), p in places.items() for k in (0, 1)})
    asked = spark.createDataFrame(wanted, "asked string, at long")
    run = Window.partitionBy("part", "g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    last = ranged.join(F.broadcast(firsts), (F.col("part") == F.col("p")) & (F.col("g") == F.col("of"))).withColumn("stop", F.col("first") + F.sum("n").over(run))
    hits = last.join(F.broadcast(asked), (F.col("g") == F.col("asked")) & (F.col("at") >= F.col("stop") - F.col("n")) & (F.col("at") < F.col("stop")))
    found = {(r["g"], r["at"]): r["v"] for r in hits.select("g", "at", "v").collect()}  # two for each group and share
    out: dict[str, dict[float, float]] = {g: {} for g in totals}
    for (g, s), p in places.items():
        low, high = found[g, int(p)], found[g, min(int(p) + 1, totals[g] - 1)]
        out[g][s] = low + (high - low) * (p - int(p))
    return out
