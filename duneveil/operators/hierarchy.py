"""Synthetic twins of several tables at once: children are summed up on their parents, modelled there, and drawn again level by level.

Fitting goes from the leaves up.  A table's columns become normal scores; what its rows add up to on a parent row is their
number and, for each column, the mean of their scores.  A mean is the parent's own effect and an error that shrinks with the
number of children; variances inside parents tell how large the error is, and it is taken out of all covariances.  Numbers and
effects join the parent's own columns, so that one copula over a root holds the correlations across all levels below it.
Sampling goes down again: a parent row's drawn numbers say how many children it has, its drawn effects about what they spread.

Fitting takes aggregates only, grouped by parent key with partial sums, so that a parent with very many rows is no burden.
Sampling makes rows where Spark makes them, CHUNK children of a parent at a time; a row's numbers come from its own place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .synthesis import Marginals, _gauss, lower_factor, marginals, normal_score, typed_columns, uniforms
from .tables import ROW, ForeignKey, numbered, written

#: Children of one parent that are drawn at a time.
CHUNK = 4096


def summaries(rows: DataFrame, parent: str, columns: list[str]) -> DataFrame:
    """(parent, n, mean_k ...): how many rows each parent has and the means of the columns, nulls left out."""
    means = [F.avg(F.col(f"`{c}`")).alias(f"mean_{k}") for k, c in enumerate(columns)]
    return rows.filter(F.col(f"`{parent}`").isNotNull()).groupBy(F.col(f"`{parent}`").alias("parent")).agg(F.count(F.lit(1)).alias("n"), *means)


@dataclass
class Spread:
    """Of a child's scores: means of the parents' effects, their standard deviations, the covariance inside parents, and the
    mean of 1/n over parents and over rows."""

    mean: np.ndarray
    effect: np.ndarray
    inside: np.ndarray
    per_parent: float
    per_row: float


def spread(rows: DataFrame, sums: DataFrame, parent: str, columns: list[str]) -> Spread:
    """An analysis of variance: parents weigh as many as their rows.  Each pair of columns counts the rows that have both."""
    pairs = [(a, b) for a in range(len(columns)) for b in range(a + 1)]
    both = rows.join(sums.withColumnRenamed("parent", "of"), F.col(f"`{parent}`") == F.col("of"))
    off = [F.col(f"`{c}`") - F.col(f"mean_{k}") for k, c in enumerate(columns)]
    inner = both.agg(*(f(off[a] * off[b]).alias(f"{n}{k}") for k, (a, b) in enumerate(pairs) for n, f in (("p", F.sum), ("n", F.count)))).first() if pairs else {}
    facts = []
    for k in range(len(columns)):
        mean = F.col(f"mean_{k}")
        n = F.when(mean.isNotNull(), F.col("n"))
        facts += [F.sum(n).alias(f"n{k}"), F.sum(n * n).alias(f"s{k}"), F.sum(n * mean).alias(f"m{k}"), F.sum(n * mean * mean).alias(f"v{k}"), F.count(mean).alias(f"g{k}")]
    outer = sums.agg(F.avg(1 / F.col("n")).alias("per"), (F.count(F.lit(1)) / F.sum("n")).alias("row"), *facts).first()
    inside, mean, effect = np.zeros((len(columns), len(columns))), np.zeros(len(columns)), np.full(len(columns), 1e-3)
    for k, (a, b) in enumerate(pairs):
        inside[a, b] = inside[b, a] = (inner[f"p{k}"] or 0.0) / max(inner[f"n{k}"] - min(outer[f"g{a}"], outer[f"g{b}"]), 1)
    for k in range(len(columns)):
        n, groups = outer[f"n{k}"] or 0, outer[f"g{k}"]
        if groups > 1:
            mean[k] = outer[f"m{k}"] / n
            between = (outer[f"v{k}"] - n * mean[k] ** 2) / (groups - 1)
            effect[k] = np.sqrt(max((between - inside[k, k]) / ((n - outer[f"s{k}"] / n) / (groups - 1)), 1e-6))
    return Spread(mean, effect, inside, outer["per"] or 0.0, outer["row"] or 0.0)


@dataclass
class Level:
    """What is known of a table."""

    table: str
    key: str | None
    #: The key it is drawn through, and others, whose parents are drawn evenly.
    link: ForeignKey | None
    others: list[ForeignKey]
    #: Own columns and the numbers of children, and the effects on children, which are scores as they are.
    kinds: dict[str, str]
    effects: list[str] = field(default_factory=list)
    model: Marginals | None = None
    #: A factor of the covariance of all scores, of a child inside its parent, and there the parents' effects.
    factor: np.ndarray | None = None
    spread: Spread | None = None
    middle: np.ndarray | None = None
    effect: np.ndarray | None = None
    #: Mean and deviation of its effects over all parents, where those of parents with children are 0 and 1.
    shift: np.ndarray | float = 0.0
    #: Variances of the parent's scores as its effects weigh them.
    seen: np.ndarray | None = None
    scale: np.ndarray | float = 1.0
    children: list[str] = field(default_factory=list)


def _number(child: str) -> str:
    return f"{child}#rows"


def _mean(child: str, column: str) -> str:
    return f"{child}#{column}"


def scored(df: DataFrame, model: Marginals, effects: list[str], parent: str | None) -> DataFrame:
    """(parent, z0, z1 ...): the scores of a table's columns; then its effects, which are scores."""
    names = list(model.kinds)
    shared = df.sparkSession.sparkContext.broadcast(model)  # quantile tables and categories, both bounded

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            z = [mean_scores(m, c, batch.column(k + 1)) for k, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *z, *batch.columns[len(names) + 1 :]], names=["parent", *(f"z{k}" for k in range(len(names) + len(effects)))])

    own = F.col(f"`{parent}`").cast("string") if parent else F.lit(None).cast("string")
    rows = df.select(own.alias("parent"), *(F.col(f"`{c}`") for c in [*names, *effects]))
    return rows.mapInArrow(scores, ", ".join(["parent string", *(f"z{k} double" for k in range(len(names) + len(effects)))]))


def _correlation_factor(matrix: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """A factor of the nearest covariance that has one, with these variances."""
    scale = np.sqrt(np.maximum(variances, 1e-12))
    correlation = np.clip(matrix / np.outer(scale, scale), -0.99, 0.99)
    np.fill_diagonal(correlation, 1.0)
    return lower_factor(correlation) * scale[:, None] if len(scale) else np.zeros((0, 0))


def _factor_with_own(matrix: np.ndarray, own: int, variances: np.ndarray | None = None) -> np.ndarray:
    """A factor of a covariance near a matrix, with these variances (1): what is seen between the first, own columns stays as it is, and
    only the effects, which are estimates, give way where no covariance has them all."""
    variances = np.ones(len(matrix)) if variances is None else variances
    if own in (0, len(matrix)):
        return _correlation_factor(matrix, variances)
    scale = np.sqrt(np.maximum(variances, 1e-12))
    matrix = matrix / np.outer(scale, scale)
    head = _correlation_factor(matrix[:own, :own], np.ones(own))
    link = np.linalg.lstsq(head, np.clip(matrix[:own, own:], -0.99, 0.99), rcond=None)[0]
    link *= np.minimum(1.0, 0.99 / np.maximum(np.sqrt((link**2).sum(axis=0)), 1e-12))
    tail = _correlation_factor(matrix[own:, own:] - link.T @ link, 1 - (link**2).sum(axis=0))
    return np.block([[head, np.zeros((own, len(matrix) - own))], [link.T, tail]]) * scale[:, None]


def mean_scores(m: Marginals, column: str, values: pa.Array) -> pa.Array:
    """Normal scores; of equal values the mean over their share of all rows; null for null."""
    if m.kinds[column] == "categorical":
        words, up_to = m.words[column]
        low = np.append(np.append(0.0, up_to[:-1]), 0.0)
        high = np.append(up_to, 1.0)
        place = {w: k for k, w in enumerate(words)}
        at = np.array([place.get(v, len(words)) for v in values.to_pylist()], np.int64)
        low, high = low[at], high[at]
        missing = at == len(words)
    else:
        x = values.to_numpy(zero_copy_only=False).astype(float)
        missing = np.isnan(x)
        q, grid = m.quantiles[column], np.linspace(0, 1, max(len(m.quantiles[column]), 1))
        if not len(q):
            return pa.nulls(len(x), pa.float64())
        first, last = np.searchsorted(q, x, "left"), np.searchsorted(q, x, "right")
        p = np.interp(np.nan_to_num(x), q, grid)
        tied = last - first > 1
        half = 0.5 / (len(q) - 1) if len(q) > 1 else 0.5  # a value on two points of the table may reach half way to the next
        low = np.where(tied, np.maximum(grid[np.minimum(first, len(q) - 1)] - half, 0.0), p)
        high = np.where(tied, np.minimum(grid[np.minimum(last, len(q)) - 1] + half, 1.0), p)
    a, b = normal_score(low), normal_score(high)
    density = lambda z: np.exp(-z * z / 2) / np.sqrt(2 * np.pi)
    wide = high - low > 1e-6
    z = np.where(wide, (density(a) - density(b)) / np.where(wide, high - low, 1.0), a)
    return pa.array(z, mask=missing)


class HierarchicalCopula:
    """Several tables tied by keys.  A table with several parents is drawn through the first of them that is modelled."""

    name = "hierarchical_copula"

    def __init__(self, keys: dict[str, str | None], foreign: list[ForeignKey]):
        self.keys, self.foreign, self.levels, self.sizes = keys, foreign, {}, {}

    def _plan(self, tables: list[str]) -> list[str]:
        """Parents first; a key that would close a circle draws evenly and ties nothing."""
        links, placed = {}, []
        usable = [f for f in self.foreign if f.child_table in tables and f.parent_table in tables and f.child_table != f.parent_table and self.keys.get(f.parent_table) == f.parent_column]
        while len(placed) < len(tables):
            ready = [t for t in tables if t not in placed and all(f.parent_table in placed for f in usable if f.child_table == t)]
            ready = ready or [next(t for t in tables if t not in placed)]
            for t in ready:
                own = [f for f in usable if f.child_table == t and f.parent_table in placed]
                links[t] = own[0] if own else None
                placed.append(t)
        for t in placed:
            others = [f for f in self.foreign if f.child_table == t and f is not links[t] and f.parent_table in tables]
            self.levels[t] = Level(t, self.keys.get(t), links[t], others, {})
            if links[t]:
                self.levels[links[t].parent_table].children.append(t)
        return placed

    def fit(self, tables: dict[str, DataFrame], kinds: dict[str, dict[str, str]]) -> None:
        """tables with ROW; kinds: of each table the modelled columns, none of them a key."""
        self.spark = next(iter(tables.values())).sparkSession
        order, found = self._plan(list(tables)), {}
        for t in reversed(order):
            level, df = self.levels[t], tables[t]
            keys = {f"#key{k}": F.col(f"`{c}`").cast("string") for k, c in enumerate([level.key, level.link and level.link.child_column]) if c}
            rows = df.select(ROW, *(v.alias(n) for n, v in keys.items()), *typed_columns(kinds[t]))
            level.kinds = dict(kinds[t])
            noise: list[np.ndarray] = []
            for child in level.children:
                below, sums = self.levels[child], found.pop(child)
                x, names = below.spread, [_mean(child, c) for c in [*below.kinds, *below.effects]]
                effect = [((F.col(f"mean_{k}") - F.lit(float(x.mean[k]))) / F.lit(float(x.effect[k]))).alias(c) for k, c in enumerate(names)]
                rows = rows.join(sums.select("parent", F.col("n").cast("double").alias(_number(child)), *effect), F.col("`#key0`") == F.col("parent"), "left").drop("parent")
                rows = rows.withColumn(_number(child), F.coalesce(F.col(f"`{_number(child)}`"), F.lit(0.0)))
                level.kinds[_number(child)] = "numerical"
                level.effects += names
                noise.append(x.inside * (x.per_parent if level.link else x.per_row) / np.outer(x.effect, x.effect))
            rows = written(rows, f"level-{order.index(t)}")
            level.model = marginals(rows, level.kinds)
            self.sizes[t] = level.model.n
            scores = written(scored(rows, level.model, [*level.effects, *map(_number, level.children)], "#key1" if level.link else None), "scores")
            names = [f"z{k}" for k in range(len(level.kinds) + len(level.effects))]
            error, at = np.zeros((len(names), len(names))), len(level.kinds)
            for part in noise:
                error[at : at + len(part), at : at + len(part)] = part
                at += len(part)
            weights = [None] * len(level.kinds) + [f"z{len(names) + k}" for k, child in enumerate(level.children) for _ in self.levels[child].spread.mean]
            whole = _covariances(scores, names, [None if level.link else w for w in weights])
            lost = self._unselected(level, scores, names, weights)
            # a tie's score is the mean of its share, so that covariances with it are smaller by this mean's variance than those of what it stands for
            ties = np.append(np.clip(np.diag(whole)[: len(level.kinds)], 0.05, 1.0), np.ones(len(level.effects)))
            if level.link is None:
                ties[len(level.kinds) :] = [x for child in level.children for x in np.broadcast_to(self.levels[child].scale, self.levels[child].spread.mean.shape)]
                joint, at = (whole - error + lost) / np.outer(ties, ties), len(level.kinds)
                for child in level.children:  # but for the number itself, correlations are those that are seen
                    block, below = slice(at, at + len(self.levels[child].spread.mean)), self.levels[child]
                    at = block.stop
                    joint[block, block] = (whole - error)[block, block]
                    if below.seen is not None:
                        rest = [k for k, c in enumerate(level.kinds) if c != _number(child)]
                        joint[rest, block] = whole[rest, block] / np.sqrt(ties[rest] * np.maximum(below.seen[rest], 1e-6))[:, None]
                        joint[block, rest] = joint[rest, block].T
                level.factor = _factor_with_own(joint, len(level.kinds))
                continue
            found[t] = written(summaries(scores, "parent", names), "sums")
            level.spread = spread(scores, found[t], "parent", names)
            level.middle, level.effect = level.spread.mean / ties, np.minimum(level.spread.effect / ties, 0.99)
            level.middle[len(level.kinds) :] = 0.0  # effects are drawn as scores of all rows
            inside = np.maximum(np.diag(level.spread.inside), 1e-6)
            share = inside / (inside + level.spread.effect**2)
            inner = (level.spread.inside - error + lost * np.outer(share, share)) / np.outer(ties, ties)
            level.factor = _factor_with_own(inner, len(level.kinds), 1 - level.effect**2)

    def _unselected(self, level: Level, scores: DataFrame, names: list[str], weights: list[str | None]) -> np.ndarray:
        """What covariances lose as effects are seen on parents with children only, and the more the more these have: the number of
        children selects, and slopes on it are the same on all parents (Pearson and Lawley).  Effects so get a mean and a scale."""
        lost, kinds, at = np.zeros((len(names), len(names))), list(level.kinds), len(level.kinds)
        for child in level.children:
            below = self.levels[child]
            block = list(range(at, at + len(below.spread.mean)))
            at += len(block)
            if not block:
                continue
            number = F.col(names[kinds.index(_number(child))])
            some = scores.filter(F.col(names[block[0]]).isNotNull())
            for weight in (F.col(weights[block[0]]), F.lit(1.0))[: 2 if level.link else 1]:
                mean = lambda v: F.sum(weight * v) / F.sum(F.when(v.isNotNull(), weight))  # noqa: B023, E731
                r = some.agg(mean(number).alias("m"), mean(number * number).alias("q"), *(x for k, c in enumerate(names) for x in (mean(F.col(c)).alias(f"a{k}"), mean(F.col(c) * number).alias(f"b{k}"), mean(F.col(c) * F.col(c)).alias(f"q{k}")))).first()
                v = (r["q"] or 0.0) - (r["m"] or 0.0) ** 2
                if v <= 1e-9:
                    break
                slope = np.array([((r[f"b{k}"] or 0.0) - (r[f"a{k}"] or 0.0) * r["m"]) / v for k in range(len(names))])
                more = max(scores.agg(F.var_pop(number)).first()[0] - v, 0.0)
                gone = np.outer(slope, slope) * more
                below.seen = np.array([(r[f"q{k}"] or 0.0) - (r[f"a{k}"] or 0.0) ** 2 for k in range(len(names))])
                if isinstance(below.shift, float):
                    below.shift, below.scale = -slope[block] * r["m"], np.sqrt(1 + slope[block] ** 2 * more)
            else:
                mask = np.zeros(len(names), bool)
                mask[block] = True
                lost += np.where(mask[:, None] | mask, gone, 0.0)
        return lost

    def sample(self, scale: float = 1.0, seed: int = 0) -> dict[str, DataFrame]:
        """Tables with ROW, new keys (numbers from 0 as text), foreign keys into them, and the modelled columns."""
        made: dict[str, DataFrame] = {}
        for k, (t, level) in enumerate(self.levels.items()):
            if level.link is None:
                rows = self._roots(level, max(1, round(self.sizes[t] * scale)), seed + 101 * k)
            else:
                rows = self._children(level, made[level.link.parent_table], seed + 101 * k)
            made[t] = written(rows, f"drawn-{k}")
        sizes = {t: df.count() for t, df in made.items()}
        return {t: self._finished(self.levels[t], df, sizes, seed) for t, df in made.items()}

    def _roots(self, level: Level, n: int, seed: int) -> DataFrame:
        model, factor, names = level.model, level.factor, [*level.kinds, *level.effects]
        middle, even = self._moments(n, len(names), seed)

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                z = (np.column_stack([_gauss(ids, k, seed) for k in range(len(names))]) - middle) @ even.T @ factor.T if names else np.zeros((len(ids), 0))
                yield pa.RecordBatch.from_arrays([batch.column(0), *_valued(model, z, ids, seed)], names=[ROW, *names])

        return self.spark.range(n).mapInArrow(make, _schema(ROW, level))

    def _moments(self, n: int, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(means, matrix) that make the drawn numbers of n roots uncorrelated, with mean 0 and variance 1: roots are few, so that chance
        would move their correlations.  Sums are taken where numbers are drawn; too few rows are left as they are."""
        if not width or n < 10 * width:
            return np.zeros(width), np.eye(width)
        pairs = [(a, b) for a in range(width) for b in range(a + 1)]

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                g = np.column_stack([_gauss(ids, k, seed) for k in range(width)])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + len(pairs), dtype=np.int32)), pa.array([*g.sum(axis=0), *(float(g[:, a] @ g[:, b]) for a, b in pairs)])], names=["k", "v"])

        found = {r["k"]: r["v"] for r in self.spark.range(n).mapInArrow(sums, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
        mean, cross = np.array([round(found[k] / n, 9) for k in range(width)]), np.zeros((width, width))  # rounded, as sums may come in any order
        for k, (a, b) in enumerate(pairs):
            cross[a, b] = cross[b, a] = round(found[width + k] / n, 9)
        return mean, np.linalg.inv(np.linalg.cholesky(cross - np.outer(mean, mean)))

    def _children(self, level: Level, parents: DataFrame, seed: int) -> DataFrame:
        model, factor, middle, names = level.model, level.factor, level.middle, [*level.kinds, *level.effects]
        shift, scale = middle + level.effect * level.shift, level.effect * level.scale
        number = F.greatest(F.col(f"`{_number(level.table)}`"), F.lit(0.0)).cast("long")
        asked = parents.select(F.col(ROW).alias("parent"), number.alias("n"), *(F.col(f"`{_mean(level.table, c)}`").alias(f"m{k}") for k, c in enumerate(names))).filter("n > 0")
        asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
        asked = asked.repartition("parent", "chunk")

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first in range(0, batch.num_rows, 256):
                    some = batch.slice(first, 256)
                    parent, n, chunk = (some.column(c).to_numpy() for c in ("parent", "n", "chunk"))
                    size = np.minimum(n - chunk * CHUNK, CHUNK)
                    at = np.repeat(np.arange(len(n)), size)
                    place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) + chunk[at] * CHUNK
                    with np.errstate(over="ignore"):
                        ids = parent[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)
                    z = np.zeros((len(at), len(names)))
                    if names:
                        effect = np.column_stack([some.column(f"m{k}").to_numpy() for k in range(len(names))])
                        z = np.column_stack([_gauss(ids, k, seed) for k in range(len(names))]) @ factor.T + (shift + scale * effect)[at]
                    yield pa.RecordBatch.from_arrays([pa.array(parent[at]), pa.array(ids.view(np.int64)), *(pa.array(z[:, k]) for k in range(len(names)))], names=["#parent", "#id", *names])

        # drawn numbers of children weigh effects anew, so that scores are set to mean 0 and variance 1 before they become values
        scores = written(asked.mapInArrow(make, ", ".join(["`#parent` long", "`#id` long", *(f"`{c}` double" for c in names)])), "drawn-scores")
        own = list(level.kinds)
        r = scores.agg(F.count(F.lit(1)).alias("n"), *(f(F.col(f"`{c}`")).alias(f"{n}{k}") for k, c in enumerate(own) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
        middle, scale = np.array([r[f"m{k}"] or 0.0 for k in range(len(own))]), np.array([r[f"s{k}"] or 1.0 for k in range(len(own))])

        def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                z = np.column_stack([batch.column(k + 2).to_numpy() for k in range(len(names))]) if names else np.zeros((batch.num_rows, 0))
                z[:, : len(own)] = (z[:, : len(own)] - middle) / scale
                yield pa.RecordBatch.from_arrays([batch.column(0), *_valued(model, z, batch.column(1).to_numpy().view(np.uint64), seed)], names=["#parent", *names])

        return numbered(scores.mapInArrow(value, _schema("#parent", level)))

    def _finished(self, level: Level, rows: DataFrame, sizes: dict[str, int], seed: int) -> DataFrame:
        """Own columns, the key, and foreign keys: through the link to the parent, through others to any row alike."""
        keys = {level.key: F.col(ROW).cast("string")} if level.key else {}
        for k, f in enumerate(level.others):
            keys[f.child_column] = F.pmod(F.xxhash64(ROW, F.lit(seed + k)), F.lit(max(sizes[f.parent_table], 1))).cast("string")
        if level.link:
            keys[level.link.child_column] = F.col("`#parent`").cast("string")
        own = [c for c in level.kinds if "#" not in c]
        return rows.select(ROW, *(v.alias(c) for c, v in keys.items()), *(F.col(f"`{c}`") for c in own if c not in keys))


def _covariances(scores: DataFrame, names: list[str], weights: list[str | None]) -> np.ndarray:
    """Covariances of scores, of each pair over the rows that have both, weighed by the later one's weight or else alike."""
    pairs = [(a, b) for a in range(len(names)) for b in range(a + 1)]
    out = np.zeros((len(names), len(names)))
    facts = []
    for k, (a, b) in enumerate(pairs):
        x, y, w = F.col(names[a]), F.col(names[b]), F.col(weights[a]) if weights[a] else F.lit(1.0)
        total = F.sum(F.when(x.isNotNull() & y.isNotNull(), w))
        of = lambda v: F.sum(F.when(x.isNotNull() & y.isNotNull(), w * v)) / total  # noqa: B023, E731
        facts.append((of(x * y) - of(x) * of(y)).alias(f"p{k}"))
    if pairs:
        r = scores.agg(*facts).first()
        for k, (a, b) in enumerate(pairs):
            out[a, b] = out[b, a] = r[f"p{k}"] or 0.0
    return out


def _valued(model: Marginals, z: np.ndarray, ids: np.ndarray, seed: int) -> list[pa.Array]:
    own = [model.values(c, z[:, k], uniforms(ids, 1_000 + k, seed)) for k, c in enumerate(model.kinds)]
    return own + [pa.array(z[:, k]) for k in range(len(own), z.shape[1])]


def _schema(first: str, level: Level) -> str:
    return ", ".join([f"`{first}` long", *(f"`{c}` {'string' if k == 'categorical' else 'double'}" for c, k in level.kinds.items()), *(f"`{c}` double" for c in level.effects)])
