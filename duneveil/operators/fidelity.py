"""How like the original a synthetic table is, how useful, and how far from single records."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import exact_percentiles, written

MAX_CATEGORIES = 12
#: Ranges of numbers in the contingency tables of the quality score.
BINS = 10
#: A column with more values than this is no category; it is refused, not cut.
MAX_VALUES = 5_000
ZERO = 1e-6
#: Nearest points: rows of a cell, cells and sampled rows for each at most, rows of a block, numbers in an array of distances.
CELL_ROWS, MAX_CELLS, SAMPLE_PER_CELL, BLOCK_ROWS, NUMBERS_AT_ONCE = 1024, 16_384, 8, 4096, 1 << 17
#: A part's number is its cell's times this, plus its block's.
PARTS = 1 << 32


# ---------------------------------------------------------------- likeness


def ks_statistic(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(column, ks): the largest distance of the two empirical distributions, at distinct values.

    Running counts are taken inside ranges of values and added to the totals of the ranges before, so no task holds
    all values.
    """
    value = F.col(f"`{column}`").cast("double")
    side = lambda df, x, y: df.select(value.alias("v"), F.lit(x).alias("a"), F.lit(y).alias("b")).filter("v IS NOT NULL AND NOT isnan(v)")
    counts = side(a, 1, 0).union(side(b, 0, 1)).groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ranged = written(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "ks")
    parts = ranged.groupBy("part").agg(F.sum("a").alias("pa"), F.sum("b").alias("pb"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = parts.select("part", F.coalesce(F.sum("pa").over(before), F.lit(0)).alias("a0"), F.coalesce(F.sum("pb").over(before), F.lit(0)).alias("b0"), F.sum("pa").over(Window.partitionBy()).alias("na"), F.sum("pb").over(Window.partitionBy()).alias("nb"))
    run = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    both = ranged.join(F.broadcast(parts), "part")
    gap = F.abs((F.col("a0") + F.sum("a").over(run)) / F.col("na") - (F.col("b0") + F.sum("b").over(run)) / F.col("nb"))
    return both.select(gap.alias("gap")).agg(F.coalesce(F.max("gap"), F.lit(0.0)).alias("ks")).select(F.lit(column).alias("column"), "ks")


def tvd(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(column, tvd): half the summed distance of the two frequency tables; null is a value."""
    counts = lambda df, name: df.select(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("\0")).alias("v"), F.lit(name).alias("side"))
    both = counts(a, "a").union(counts(b, "b")).groupBy("v").agg(F.count_if(F.col("side") == "a").alias("a"), F.count_if(F.col("side") == "b").alias("b"))
    totals = both.agg(F.sum("a").alias("na"), F.sum("b").alias("nb")).withColumn("k", F.lit(1))
    share = both.withColumn("k", F.lit(1)).join(F.broadcast(totals), "k").withColumn("gap", F.abs(F.col("a") / F.nullif("na", F.lit(0)) - F.col("b") / F.nullif("nb", F.lit(0))))
    return share.agg((F.coalesce(F.sum("gap"), F.lit(0.0)) / 2).alias("tvd")).select(F.lit(column).alias("column"), "tvd")


def correlation_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> float:
    """The mean absolute difference of the correlations of all pairs of numeric columns."""
    pairs = [(x, y) for k, x in enumerate(columns) for y in columns[k + 1 :]]
    if not pairs:
        return 0.0
    of = lambda df: df.agg(*(F.corr(F.col(f"`{x}`").cast("double"), F.col(f"`{y}`").cast("double")).alias(f"p{k}") for k, (x, y) in enumerate(pairs))).first()
    left, right = of(a), of(b)
    gaps = [abs(p - q) for p, q in zip(left, right, strict=True) if p is not None and q is not None and p == p and q == q]
    return sum(gaps) / len(gaps) if gaps else 0.0


def fidelity(real: DataFrame, twin: DataFrame, kinds: dict[str, str]) -> dict:
    """kinds: column -> numerical, datetime or categorical."""
    days = lambda df: df.withColumns({c: F.unix_date(F.col(f"`{c}`").try_cast("date")) for c, k in kinds.items() if k == "datetime"})
    x, y = days(real), days(twin)
    numeric = [c for c, k in kinds.items() if k != "categorical"]
    distances = [ks_statistic(x, y, c).withColumnRenamed("ks", "distance") for c in numeric] + [tvd(x, y, c).withColumnRenamed("tvd", "distance") for c in kinds if c not in numeric]
    found = {r["column"]: round(r["distance"], 4) for r in reduce(DataFrame.unionByName, distances).collect()} if distances else {}
    return {"distance": found, "mean_distance": round(sum(found.values()) / len(found), 4) if found else None, "correlation_difference": round(correlation_difference(x, y, numeric), 4)}


def _binned(df: DataFrame, kinds: dict[str, str], ends: dict[str, tuple[float, float]]) -> DataFrame:
    """(side columns) as texts: categories as they are, numbers and days by BINS equal ranges of the real values; null is a value."""
    def of(c: str) -> Column:
        v = F.col(f"`{c}`")
        if kinds[c] == "categorical":
            return F.coalesce(v.cast("string"), F.lit("\0"))
        low, high = ends[c]
        at = F.floor((v.cast("double") - low) / ((high - low) or 1.0) * BINS)
        return F.coalesce(F.least(F.greatest(at, F.lit(0)), F.lit(BINS - 1)).cast("string"), F.lit("\0"))

    return df.select(*(of(c).alias(c) for c in kinds))


def quality_scores(real: DataFrame, twin: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(property, a, b, score): how alike columns and pairs of columns are, each from 0 to 1.

    shape: of a number or day 1 less the largest distance of the distributions, of a category 1 less half the summed distance
    of the frequencies.  trend: of two numbers 1 less half the difference of their correlations, of other pairs 1 less half
    the summed distance of the two contingency tables, numbers in BINS equal ranges of the real values.  All contingency tables are
    counted in one pass over each side, which explodes a row's pairs of columns and sums them up before it shuffles.
    """
    days = lambda df: df.withColumns({c: F.unix_date(F.col(f"`{c}`").try_cast("date")).cast("double") for c, k in kinds.items() if k == "datetime"})
    x, y = days(real), days(twin)
    numeric = [c for c, k in kinds.items() if k != "categorical"]
    row = lambda prop, a, b: (F.lit(prop).alias("property"), F.lit(a).alias("a"), F.lit(b).cast("string").alias("b"))
    parts = [ks_statistic(x, y, c).select(*row("shape", c, None), (1 - F.col("ks")).alias("score")) for c in numeric]
    parts += [tvd(x, y, c).select(*row("shape", c, None), (1 - F.col("tvd")).alias("score")) for c in kinds if c not in numeric]
    both = [(a, b) for k, a in enumerate(numeric) for b in numeric[k + 1 :]]
    if both:
        of = lambda df, side: df.agg(*(F.corr(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")).alias(f"{side}{k}") for k, (a, b) in enumerate(both)))
        pairs = of(x, "x").crossJoin(of(y, "y"))  # a row each
        parts.append(pairs.select(F.explode(F.array(*(F.struct(*row("trend", a, b), (1 - F.abs(F.col(f"x{k}") - F.col(f"y{k}")) / 2).alias("score")) for k, (a, b) in enumerate(both)))).alias("p")).select("p.*"))
    names = list(kinds)
    mixed = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :] if (a, b) not in both]
    if mixed:
        found = x.agg(F.lit(1), *(f(F.col(f"`{c}`").cast("double")).alias(f"{n}{k}") for k, c in enumerate(numeric) for n, f in (("low", F.min), ("high", F.max)))).first()
        ends = {c: (found[f"low{k}"] or 0.0, found[f"high{k}"] or 0.0) for k, c in enumerate(numeric)}
        cells = lambda df, side: _binned(df, kinds, ends).select(F.lit(side).alias("side"), F.explode(F.array(*(F.struct(F.lit(k).alias("pair"), F.col(f"`{a}`").alias("va"), F.col(f"`{b}`").alias("vb")) for k, (a, b) in enumerate(mixed)))).alias("p")).select("side", "p.*")
        counts = cells(x, "x").unionByName(cells(y, "y")).groupBy("pair", "va", "vb").agg(F.count_if(F.col("side") == "x").alias("nx"), F.count_if(F.col("side") == "y").alias("ny"))
        counts = written(counts, "contingency")
        totals = counts.groupBy(F.col("pair").alias("of")).agg(F.sum("nx").alias("tx"), F.sum("ny").alias("ty"))  # a row for each pair
        gap = F.abs(F.coalesce(F.try_divide("nx", "tx"), F.lit(0.0)) - F.coalesce(F.try_divide("ny", "ty"), F.lit(0.0)))
        scored = counts.join(F.broadcast(totals), F.col("pair") == F.col("of")).groupBy("pair").agg((1 - F.sum(gap) / 2).alias("score"))
        told = F.array(*(F.struct(*row("trend", a, b)) for a, b in mixed))
        parts.append(scored.select(F.element_at(told, F.col("pair") + 1).alias("p"), "score").select("p.*", "score"))
    return reduce(DataFrame.unionByName, parts)


def quality(real: DataFrame, twin: DataFrame, kinds: dict[str, str]) -> dict:
    """The mean of the two properties, each the mean of its scores; a score that is no number counts nowhere."""
    rows = [r for r in quality_scores(real, twin, kinds).collect() if r["score"] is not None and r["score"] == r["score"]]  # a row for each pair of columns
    of = {p: [r["score"] for r in rows if r["property"] == p] for p in ("shape", "trend")}
    means = {p: round(sum(x) / len(x), 4) for p, x in of.items() if x}
    return {"score": round(sum(means.values()) / len(means), 4) if means else None, "shapes": means.get("shape"), "trends": means.get("trend"), "pairs": len(of["trend"])}


def eta_squared(df: DataFrame, categories: list[str], numbers: list[str]) -> DataFrame:
    """(category, number, eta2): the share of a number's variance between a category's values, on logs if all are positive."""
    parts = []
    least = df.agg(*(F.min(F.col(f"`{n}`").cast("double")).alias(f"m{k}") for k, n in enumerate(numbers))).first() if numbers else {}
    for c in categories:
        for k, n in enumerate(numbers):
            value = F.col(f"`{n}`").cast("double")
            value = F.log(value) if (least[f"m{k}"] or 0) > 0 else value
            groups = df.select(F.col(f"`{c}`").alias("g"), value.alias("x")).filter("x IS NOT NULL AND g IS NOT NULL").groupBy("g")
            sums = groups.agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.coalesce(F.var_pop("x"), F.lit(0.0)).alias("var"))
            total = sums.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("var")).alias("within"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("square"))
            between = F.col("square") - F.col("n") * F.col("mean") * F.col("mean")
            parts.append(total.select(F.lit(c).alias("category"), F.lit(n).alias("number"), F.coalesce(F.try_divide(between, between + F.col("within")), F.lit(0.0)).alias("eta2")))
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- usefulness


def parse_target(text: str) -> tuple[str, str, float | None]:
    """label = column > p90: (label, column, 0.9); a plain column name: (column, column, None)."""
    m = re.fullmatch(r"\s*(\w+)\s*=\s*(\w+)\s*>\s*p(\d{1,2})\s*", text)
    return (m[1], m[2], int(m[3]) / 100) if m else (text.strip(), text.strip(), None)


def with_target(frames: dict[str, DataFrame], target: str) -> tuple[dict[str, DataFrame], str, str]:
    """(frames with the target as 0/1 in `target`, its name, the column it comes from); a quantile is the train set's."""
    label, column, quantile = parse_target(target)
    value = F.col(f"`{column}`").cast("double")
    if quantile is not None:
        cut = exact_percentiles(frames["train"].select(F.lit("").alias("g"), value.alias("v")), [quantile]).get("", {}).get(quantile)
        flag = (value > cut).cast("double")
    else:
        flag = (value > 0).cast("double")
    return {k: df.withColumn("target", flag).filter("target IS NOT NULL") for k, df in frames.items()}, label, column


def _model(kinds: dict[str, str], classifier) -> Pipeline:
    numeric, words = [c for c, k in kinds.items() if k != "categorical"], [c for c, k in kinds.items() if k == "categorical"]
    steps = []
    if words:
        steps += [StringIndexer(inputCols=words, outputCols=[f"i_{c}" for c in words], handleInvalid="keep"), OneHotEncoder(inputCols=[f"i_{c}" for c in words], outputCols=[f"v_{c}" for c in words])]
    if numeric:
        steps += [VectorAssembler(inputCols=numeric, outputCol="numbers", handleInvalid="keep"), StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True)]
    steps.append(VectorAssembler(inputCols=[*["scaled"] * bool(numeric), *(f"v_{c}" for c in words)], outputCol="features"))
    return Pipeline(stages=[*steps, classifier])


def utility(train: DataFrame, twin: DataFrame, holdout: DataFrame, kinds: dict[str, str], target: str, trees: int = 200) -> dict:
    """Models trained on real and on twin rows, both tested on the holdout: AUC, F1 and how much the twin loses."""
    frames, label, column = with_target({"train": train, "twin": twin, "holdout": holdout}, target)
    used = {c: k for c, k in kinds.items() if c != column}
    def ready(df: DataFrame) -> DataFrame:
        cast = {c: F.coalesce(F.unix_date(F.col(f"`{c}`").try_cast("date")).cast("double") if k == "datetime" else F.col(f"`{c}`").cast("double"), F.lit(0.0)) if k != "categorical" else F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c, k in used.items()}
        return df.select("target", *(v.alias(c) for c, v in cast.items()))

    frames = {k: ready(df).cache() for k, df in frames.items()}
    if any(df.select("target").distinct().count() < 2 for df in frames.values()):
        return {"status": "NOT_RUN", "reason": "the target has one class only", "target": label}
    area, f1 = BinaryClassificationEvaluator(labelCol="target"), MulticlassClassificationEvaluator(labelCol="target", metricName="fMeasureByLabel", metricLabel=1.0)
    out: dict = {"status": "RUN", "target": label, "models": {}}
    for name, make in (("logistic", lambda: LogisticRegression(labelCol="target", maxIter=50)), ("forest", lambda: RandomForestClassifier(labelCol="target", numTrees=trees, minInstancesPerNode=5, maxDepth=8, seed=0))):
        scores = {}
        for side in ("train", "twin"):
            tested = _model(used, make()).fit(frames[side]).transform(frames["holdout"])
            scores[side] = {"auc": round(area.evaluate(tested), 4), "f1": round(f1.evaluate(tested), 4)}
        out["models"][name] = scores | {"auc_drop": round(scores["train"]["auc"] - scores["twin"]["auc"], 4)}
    for df in frames.values():
        df.unpersist()
    return out | {"max_auc_drop": max(m["auc_drop"] for m in out["models"].values())}


# ---------------------------------------------------------------- distance to the closest record


def _values(df: DataFrame, column: str) -> list[str]:
    found = [r[0] for r in df.select(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))).distinct().limit(MAX_VALUES + 1).collect()]
    if len(found) > MAX_VALUES:
        raise ValueError(f"{column} has more than {MAX_VALUES} values and is no category")
    return sorted(found)


def encoded(frames: dict[str, DataFrame], kinds: dict[str, str], by: str = "train") -> dict[str, DataFrame]:
    """(id, vector) of each frame: numbers scaled to the range of `by`, categories of `by` as zeros and one."""
    numeric, words = [c for c, k in kinds.items() if k != "categorical"], [c for c, k in kinds.items() if k == "categorical"]
    number = lambda c: F.unix_date(F.col(f"`{c}`").try_cast("date")).cast("double") if kinds[c] == "datetime" else F.col(f"`{c}`").cast("double")
    ends = frames[by].agg(F.lit(1), *(f(number(c)).alias(f"{n}{k}") for k, c in enumerate(numeric) for n, f in (("low", F.min), ("high", F.max)))).first()
    values = {c: _values(frames[by], c) for c in words}
    parts = []
    for k, c in enumerate(numeric):
        low, high = ends[f"low{k}"] or 0.0, ends[f"high{k}"] or 0.0
        parts.append(F.coalesce((number(c) - low) / (high - low if high > low else 1.0), F.lit(0.0)).cast("double"))
    for c in words:
        text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        parts += [(text == v).cast("double") for v in values[c]]
    vector = F.array(*parts) if parts else F.array().cast("array<double>")
    return {name: df.select(vector.alias("vector")) for name, df in frames.items()}


@dataclass
class _Cells:
    """A tree of halved regions: of each node the column and the bound at which it is split, its children, and at a leaf its cell."""

    column: np.ndarray
    bound: np.ndarray
    below: np.ndarray
    above: np.ndarray
    cell: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while len(inner := np.flatnonzero(self.cell[node] < 0)):
            at = node[inner]
            node[inner] = np.where(x[inner, self.column[at]] <= self.bound[at], self.below[at], self.above[at])
        return self.cell[node]


def _halved(sample: np.ndarray, cells: int) -> _Cells:
    """The sample's regions, halved at the median of the column that varies most, until there are so many."""
    rows: list[tuple] = []
    n_cells = 0

    def split(x: np.ndarray, cells: int) -> int:
        nonlocal n_cells
        at, spread = len(rows), x.var(axis=0) if x.shape[1] else np.zeros(1)
        rows.append(())
        k = int(spread.argmax())
        if cells > 1 and spread[k] > 0:
            low, high = x[:, k].min(), x[:, k].max()
            bound = np.median(x[:, k])
            # a bound between two values, so that columns of zeros and ones are parted
            low, high = x[x[:, k] <= bound, k].max(initial=low), x[x[:, k] > bound, k].min(initial=high)
            bound = low + (high - low) / 2 if low < high else x[x[:, k] < bound, k].max(initial=-np.inf)
            under = x[:, k] <= bound
            if under.any() and not under.all():
                share = min(max(round(cells * under.mean()), 1), cells - 1)
                rows[at] = (k, bound, split(x[under], share), split(x[~under], cells - share), -1)
                return at
        rows[at] = (0, 0.0, 0, 0, n_cells)
        n_cells += 1
        return at

    split(sample, cells)
    column, bound, below, above, cell = map(np.array, zip(*rows, strict=True))
    return _Cells(column, bound.astype(float), below, above, cell)


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return np.asarray(vectors.flatten(), float).reshape(len(vectors), -1)


def _assigner(cells: _Cells):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(vector, ...) -> the same with its cell."""
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.of(_matrix(batch.column(0))).astype(np.int32))], names=[*batch.schema.names, "cell"])

    return assign


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (vector, cell): of each cell of a partition the least and the greatest value of each column, and its points."""
    seen: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
    for batch in batches:
        x, cell = _matrix(batch.column(0)), batch.column(1).to_numpy()
        order = np.argsort(cell, kind="stable")
        x, (found, first, n) = x[order], np.unique(cell[order], return_index=True, return_counts=True)
        for c, low, high, k in zip(found.tolist(), np.minimum.reduceat(x, first), np.maximum.reduceat(x, first), n.tolist(), strict=True) if len(x) else ():
            old = seen.get(c, (low, high, 0))
            seen[c] = np.minimum(low, old[0]), np.maximum(high, old[1]), old[2] + k
    kinds = {"low": pa.list_(pa.float64()), "high": pa.list_(pa.float64())}
    columns = [pa.array(list(seen), pa.int32()), *(pa.array([x[k].tolist() for x in seen.values()], kinds[name]) for k, name in enumerate(kinds)), pa.array([x[2] for x in seen.values()], pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, names=["cell", "low", "high", "n"])


def _merged_boxes(table: pa.Table) -> pa.Table:
    low, high = _matrix(table["low"]).min(axis=0), _matrix(table["high"]).max(axis=0)
    return pa.table({"cell": table["cell"][:1], "low": pa.array([low.tolist()], pa.list_(pa.float64())), "high": pa.array([high.tolist()], pa.list_(pa.float64())), "n": pa.array([pc.sum(table["n"]).as_py()], pa.int64())})


def _closest(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Of each x the distance to the closest of some points; columns in which all points agree are read once."""
    out = np.full(len(x), np.inf)
    if not len(points):
        return out
    vary = points.min(axis=0) < points.max(axis=0)
    step = max(1, NUMBERS_AT_ONCE // len(points))
    for k in range(0, len(x), step):
        some = x[k : k + step]
        square = np.repeat(((some[:, ~vary] - points[0, ~vary]) ** 2).sum(axis=1)[:, None], len(points), axis=1)
        for c in np.flatnonzero(vary):
            square += (some[:, c, None] - points[:, c]) ** 2
        out[k : k + step] = np.sqrt(square.min(axis=1))
    return out


def nearest_distances(queries: DataFrame, points: DataFrame, seed: int = 0) -> DataFrame:
    """(vector, n, nearest): each distinct query vector, how many rows have it, and its distance to the closest point.

    Exact, by cells: a bounded sample halves the space until a cell holds about CELL_ROWS points (more beyond MAX_CELLS cells);
    which points are in the sample changes the work and not the result.  A query meets points of its own cell first, and then only
    the cells whose box is closer than what it has found.  Points meet in blocks of about BLOCK_ROWS with at most about as many
    queries, each read once for all of these, so that a task's memory has a bound however many there are.
    """
    distinct = written(points.select("vector").distinct(), "distinct")
    n = distinct.count()
    if not n:
        return queries.groupBy("vector").agg(F.count(F.lit(1)).alias("n")).withColumn("nearest", F.lit(None).cast("double"))
    wanted = min(-(-n // CELL_ROWS), MAX_CELLS)
    taken = min(1.0, max(wanted, 2) * SAMPLE_PER_CELL / n)
    sample = distinct.filter(F.pmod(F.xxhash64("vector", F.lit(seed)), F.lit(1 << 30)) < int(taken * (1 << 30))) if wanted > 1 else distinct.limit(1)
    some = _matrix(sample.toArrow()["vector"])  # SAMPLE_PER_CELL * MAX_CELLS rows
    cells = _halved(some, wanted) if len(some) else _halved(np.zeros((1, 1)), 1)
    place = _assigner(cells)
    placed = written(distinct.mapInArrow(place, "vector array<double>, cell int"), "points")
    boxes = placed.mapInArrow(_boxes, "cell int, low array<double>, high array<double>, n long").groupBy("cell").applyInArrow(_merged_boxes, "cell int, low array<double>, high array<double>, n long").toArrow()  # MAX_CELLS rows
    box_cell, low, high = boxes["cell"].to_numpy(), _matrix(boxes["low"]), _matrix(boxes["high"])
    blocks = -(-boxes["n"].to_numpy() // BLOCK_ROWS)
    spark = distinct.sparkSession
    split = spark.createDataFrame([(int(c), int(b)) for c, b in zip(box_cell, blocks, strict=True)], "of int, blocks long")
    # a part: a block of a cell
    parts = placed.join(F.broadcast(split), F.col("cell") == F.col("of")).select((F.col("cell").cast("long") * PARTS + F.pmod(F.xxhash64("vector"), "blocks")).alias("part"), "vector")
    asked = queries.groupBy("vector").agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id())
    asked = written(asked.mapInArrow(place, "vector array<double>, n long, id long, cell int"), "queries")

    def chunked(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """pairs (id, vector, part) in chunks of about BLOCK_ROWS to a part, and the points of each chunk."""
        sizes = pairs.groupBy(F.col("part").alias("of")).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("chunks"))
        sizes = written(sizes, "chunks")
        asking = pairs.join(F.broadcast(sizes), F.col("part") == F.col("of")).withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks")).drop("of", "chunks")
        held = parts.join(F.broadcast(sizes.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))), F.col("part") == F.col("of"))
        return asking.groupBy("part", "chunk"), held.select("part", "chunk", "vector").groupBy("part", "chunk")

    def own(asking: pa.Table, held: pa.Table) -> pa.Table:
        """(id, vector, near, open): the closest point of the first block of a query's cell, and the parts that may hold a closer one."""
        x = _matrix(asking["vector"]) if len(asking) else np.zeros((0, low.shape[1]))
        near = _closest(x, _matrix(held["vector"]) if len(held) else np.zeros((0, low.shape[1])))
        left: list[list[int]] = []
        if len(x):
            gap = np.maximum(np.maximum(low - x.max(axis=0), x.min(axis=0) - high), 0.0)
            about = np.flatnonzero((gap**2).sum(axis=1) < near.max() ** 2)
            mine = asking["part"][0].as_py()
            step = max(1, NUMBERS_AT_ONCE // max(len(about), 1))
            for k in range(0, len(x), step):
                part = x[k : k + step]
                square = np.zeros((len(part), len(about)))
                for c in range(x.shape[1]):
                    square += np.maximum(np.maximum(low[about, c] - part[:, c, None], part[:, c, None] - high[about, c]), 0.0) ** 2
                for row in np.sqrt(square) < near[k : k + step, None]:
                    left.append([p for j in about[row] for p in range(int(box_cell[j]) * PARTS, int(box_cell[j]) * PARTS + int(blocks[j])) if p != mine])
        return pa.table({"id": asking["id"], "vector": asking["vector"], "near": pa.array(near), "open": pa.array(left, pa.list_(pa.int64()))})

    def other(asking: pa.Table, held: pa.Table) -> pa.Table:
        near = _closest(_matrix(asking["vector"]), _matrix(held["vector"])) if len(asking) and len(held) else np.full(len(asking), np.inf)
        return pa.table({"id": asking["id"], "near": pa.array(near)})

    asking, held = chunked(asked.select("id", "vector", (F.col("cell").cast("long") * PARTS).alias("part")))
    first = written(asking.cogroup(held).applyInArrow(own, "id long, vector array<double>, near double, open array<long>"), "near-own")
    asking, held = chunked(first.select("id", "vector", F.explode("open").alias("part")))
    rest = asking.cogroup(held).applyInArrow(other, "id long, near double")
    near = first.select("id", "near").union(rest).groupBy(F.col("id").alias("i")).agg(F.min("near").alias("nearest"))
    return asked.join(near, F.col("id") == F.col("i")).select("vector", "n", "nearest")


def weighted_median(distances: DataFrame) -> float | None:
    """The median of nearest over rows (n each)."""
    return exact_percentiles(distances.select(F.lit("").alias("g"), F.col("nearest").alias("v"), "n"), [0.5]).get("", {}).get(0.5)


def distance_to_closest(train: DataFrame, twin: DataFrame, holdout: DataFrame, kinds: dict[str, str], seed: int = 0, strata: str | None = None) -> dict:
    """Are twin rows no closer to training rows than unseen rows are?  Passed if their median distance is no smaller.

    per_stratum has a verdict for each of the MAX_CATEGORIES values of `strata` with most twin rows, ties by value;
    strata tells how many values there are.  The verdict over all rows covers every stratum.
    """
    frames = encoded({"train": train, "twin": twin, "holdout": holdout}, kinds)
    to_train = {k: written(nearest_distances(frames[k], frames["train"], seed), f"dcr-{k}") for k in ("twin", "holdout")}
    n_train, n_hold = frames["train"].count(), frames["holdout"].count()
    part = frames["train"].withColumn("u", F.rand(seed)).orderBy("u").limit(min(n_train, n_hold)).drop("u") if n_train > n_hold else frames["train"]
    near_part = nearest_distances(frames["twin"], written(part, "dcr-part"), seed).select(F.col("vector").alias("v"), F.col("nearest").alias("to_part"))
    near_hold = nearest_distances(frames["twin"], frames["holdout"], seed).join(near_part, F.col("vector") == F.col("v"))
    closer = near_hold.agg((F.sum(F.when(F.col("to_part") < F.col("nearest"), F.col("n")).otherwise(0)) / F.sum("n")).alias("x")).first()["x"]
    medians = {k: weighted_median(d) for k, d in to_train.items()}
    zero = to_train["twin"].filter(F.col("nearest") < ZERO).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    out = {
        "median_dcr_twin_to_train": round(medians["twin"], 5), "median_dcr_holdout_to_train": round(medians["holdout"], 5), "passed": medians["twin"] >= medians["holdout"],
        "share_twin_closer_to_train_than_holdout": round(closer, 4), "share_ideal": 0.5, "twin_rows_at_distance_zero": zero, "columns": list(kinds), "strata": 0, "per_stratum": None,
    }
    if strata and kinds.get(strata) == "categorical":
        out["per_stratum"] = {}
        sizes = twin.groupBy(F.col(f"`{strata}`").cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n")).filter("v IS NOT NULL")
        out["strata"] = sizes.count()
        for v in sorted(r["v"] for r in sizes.orderBy(F.col("n").desc(), "v").limit(MAX_CATEGORIES).collect()):
            parts = encoded({"train": train, "twin": twin.filter(F.col(f"`{strata}`") == v), "holdout": holdout.filter(F.col(f"`{strata}`") == v)}, kinds)
            pair = [weighted_median(nearest_distances(parts[k], parts["train"], seed)) for k in ("twin", "holdout")]
            if None not in pair:
                out["per_stratum"][v] = {"median_dcr_twin_to_train": round(pair[0], 5), "median_dcr_holdout_to_train": round(pair[1], 5), "passed": pair[0] >= pair[1]}
    return out


def robustness(results: list[dict]) -> dict:
    """Over several splits: how many pass, and the margin's mean, deviation and range (information only)."""
    margins = np.array([r["median_dcr_twin_to_train"] - r["median_dcr_holdout_to_train"] for r in results])
    return {"runs": len(results), "passed": sum(r["passed"] for r in results), "margin_mean": round(float(margins.mean()), 5), "margin_std": round(float(margins.std()), 5), "margin_min": round(float(margins.min()), 5), "margin_max": round(float(margins.max()), 5)}
