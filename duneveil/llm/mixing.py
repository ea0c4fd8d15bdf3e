"""Mixing sources to target weights by Pareto order sampling (DataFrame operations only).

Each source gets a target number of words.  Inside a source a document is expected in so many copies as its own
weight, the number of bits of its size, says: level x weight, max_copies at most, with the level at which the
expected words add up to the target.  So longer documents are likelier than shorter ones.  The whole part of the
expected copies is taken for certain, and the rest of the target is filled by documents in the order of

    (u / (1 - u)) / (p / (1 - p)),     u: a uniform number hashed from the document's id
                                       p: the fraction of a copy that is left, its inclusion probability

until the words left for the source are used up.  The cut is found from sums over equal slices of that order, then
over slices of the slice that holds it, and only the last one's few rows are ordered one by one: no source passes
through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, private, saved

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SLICES = 4096
SEED = "mix-1"


def uniform(id_col: Column, text_col: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from 52 bits of md5(seed:id); a null id is replaced by the md5 of its text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.md5(text_col.cast("string")), F.lit("null")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def weight_of(size: Column) -> Column:
    """The bits of a size: the weight of a document inside its source."""
    return F.length(F.bin(size)).cast("long")


def source_targets(sized: DataFrame, source_col: str, weights=WEIGHTS, share: float = 1.0, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target): share of all words, by weight, none above max_copies x its source.

    Sources by code point, null last, take the weights in turn.  Those that reach their ceiling are a prefix in
    the order of size / weight, so resharing the excess until none is above has a closed form: `level` words per
    unit of weight for all behind that prefix.
    """
    totals = sized.groupBy(source_col).agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col(source_col).asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * max_copies)
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col(source_col).asc_nulls_last())
    everything = Window.partitionBy()
    left = (F.sum("source_size").over(everything) * F.lit(share)).cast("double") - F.coalesce(F.sum("ceiling").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    behind = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.withColumn("place", F.row_number().over(order)).withColumn("level", left / behind)
    levels = levels.withColumn("fits", F.col("level") * F.col("weight") <= F.col("ceiling"))
    first = F.min(F.when(F.col("fits"), F.col("place"))).over(everything)
    level = F.min(F.when(F.col("place") == F.col("first"), F.col("level"))).over(everything)
    levels = levels.withColumn("first", first).withColumn("level", level)
    target = F.when(F.col("first").isNull() | (F.col("place") < F.col("first")), F.col("ceiling").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return levels.select(source_col, F.col("source_size").cast("long"), target.alias("target"))


def expected_copies(sized: DataFrame, targets: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, weight, source_size, target, whole, p, rest): what each weight of each source gets.

    Weights that reach max_copies are the heaviest ones, so the level behind them has a closed form, as in
    source_targets.  rest: the words of the target that the certain copies leave.
    """
    sums = sized.filter("size > 0").groupBy("source", F.col("weight")).agg(F.sum("size").alias("words"))
    t = targets.withColumnRenamed("source", "of")
    rows = sums.join(t, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    heavy = Window.partitionBy("source").orderBy(F.col("weight").desc())
    full = F.coalesce(F.sum("words").over(heavy.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * max_copies
    behind = F.sum(F.col("weight") * F.col("words")).over(heavy.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("target") - full) / behind)
    rows = rows.withColumn("fits", F.col("level") * F.col("weight") <= max_copies)
    every = Window.partitionBy("source")
    level = F.max(F.when(F.col("fits"), F.struct("weight", "level"))).over(every)
    rows = rows.withColumn("at", level)
    expected = F.when(F.col("weight") <= F.col("at.weight"), F.col("at.level") * F.col("weight")).otherwise(F.lit(float(max_copies)))
    rows = rows.withColumn("expected", expected).withColumn("whole", F.floor("expected").cast("long"))
    rows = rows.withColumn("rest", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(every))
    return rows.select("source", "weight", "source_size", "target", "whole", (F.col("expected") - F.col("whole")).alias("p"), "rest")


def _ranked(rows: DataFrame, plan: DataFrame, slices: int) -> DataFrame:
    """rows (source, weight, u, ...) with their plan and `rank`, the ratio of odds brought into 0 to 1, and its slice."""
    t = plan.withColumnsRenamed({"source": "of", "weight": "bits"})
    rows = rows.join(t, F.col("source").eqNullSafe(F.col("of")) & (F.col("weight") == F.col("bits"))).drop("of", "bits")
    ratio = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    rows = rows.withColumn("rank", F.when(F.col("p") > 0, ratio / (1 + ratio)))
    return rows.withColumn("slice", F.floor(F.col("rank") * (slices * slices)).cast("long"))


def _cut(ranked: DataFrame, slices: int) -> DataFrame:
    """(source, cut, before): the slice in which each source's rest is used up, and the words of the slices before it.

    A rest that is never used up has the cut after all slices.
    """
    open_ = ranked.filter("rank IS NOT NULL")
    by_slice = saved(open_.groupBy("source", "slice").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")), "mix-slices")
    coarse = by_slice.groupBy("source", F.expr(f"slice DIV {slices}").alias("part")).agg(F.sum("words").alias("words"), F.first("rest").alias("rest"))
    order = Window.partitionBy("source")
    coarse = coarse.withColumn("before", F.sum("words").over(order.orderBy("part")) - F.col("words"))
    held = coarse.filter("before < rest AND before + words > rest").select(F.col("source").alias("of"), F.col("part").alias("at"), F.col("before").alias("start"))
    fine = by_slice.join(held, F.col("source").eqNullSafe(F.col("of")) & (F.expr(f"slice DIV {slices}") == F.col("at")))
    fine = fine.withColumn("before", F.col("start") + F.sum("words").over(order.orderBy("slice")) - F.col("words"))
    cuts = fine.filter("before < rest AND before + words > rest").select(F.col("source").alias("of"), F.col("slice").alias("found"), F.col("before").alias("words_before"))
    edges = coarse.groupBy("source").agg(F.max("rest").alias("rest"), F.sum("words").alias("all"), F.max("part").alias("last"))
    # without a slice that holds the cut the rest ends between two parts or two slices, or beyond all of them
    whole = coarse.filter("before + words <= rest").groupBy(F.col("source").alias("w")).agg(F.max("part").alias("done"))
    inner = fine.filter("before + words <= rest").groupBy(F.col("source").alias("x")).agg(F.max("slice").alias("passed"))
    rows = edges.join(cuts, F.col("source").eqNullSafe(F.col("of")), "left").join(whole, F.col("source").eqNullSafe(F.col("w")), "left").join(inner, F.col("source").eqNullSafe(F.col("x")), "left")
    after = F.greatest(F.coalesce(F.col("passed") + 1, F.lit(0)), F.coalesce((F.col("done") + 1) * slices, F.lit(0)))
    return rows.select("source", F.coalesce("found", after).alias("cut"), F.coalesce("words_before", F.lit(0)).alias("before"), F.col("found").isNotNull().alias("inside"))


def _plan(sized: DataFrame, weights, share: float, max_copies: int, slices: int) -> DataFrame:
    """expected_copies of sized (id, source, size, weight, u), with each source's cut."""
    targets = saved(source_targets(sized, "source", weights, share, max_copies), "mix-targets")
    expected = saved(expected_copies(sized, targets, max_copies), "mix-expected")
    cuts = _cut(_ranked(sized.filter("size > 0"), expected, slices), slices).withColumnRenamed("source", "of")
    plan = expected.join(cuts, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    none = targets.select("source", F.lit(0).cast("long").alias("weight"), "source_size", "target", F.lit(0).cast("long").alias("whole"), F.lit(0.0).alias("p"), F.lit(0.0).alias("rest"))
    none = none.withColumns({"cut": F.lit(0).cast("long"), "before": F.lit(0).cast("long"), "inside": F.lit(False)})
    return saved(plan.unionByName(none), "mix-plan")


def _taken(rows: DataFrame, plan: DataFrame, slices: int) -> DataFrame:
    """rows (id, source, size, weight, u, ...) with source_size, target, copies and taken."""
    ranked = _ranked(rows, plan, slices)
    at_cut = F.col("rank").isNotNull() & F.coalesce(F.col("inside"), F.lit(False)) & (F.col("slice") == F.col("cut"))
    order = Window.partitionBy("source").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = ranked.filter(at_cut).withColumn("reached", F.col("before") + F.sum("size").over(order))
    edge = edge.withColumn("more", (F.col("reached") - F.col("size") / 2 <= F.col("rest")).cast("long")).drop("reached")
    clear = ranked.filter(~at_cut).withColumn("more", F.coalesce((F.col("slice") < F.col("cut")).cast("long"), F.lit(0).cast("long")))
    out = clear.unionByName(edge).withColumn("copies", F.col("whole") + F.col("more"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> dict[str, Column]:
    size = n_words(F.col(text_col))
    return {"id": F.col(id_col), "source": F.col(source_col), "size": size, "u": uniform(F.col(id_col), F.col(text_col), seed)}


def _weighed(sized: DataFrame) -> DataFrame:
    """With `weight`, 0 for a text without words."""
    return sized.withColumn("weight", F.when(F.col("size") > 0, weight_of(F.col("size"))).otherwise(F.lit(0)).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.0, max_copies: int = MAX_COPIES, seed: str = SEED, slices: int = SLICES) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for every row of docs.

    size: words of the text, null or empty 0.  taken = copies x size; copies <= max_copies.  A null source is a
    source of its own, the last.  Rows without words are taken 0 times over and never weigh.  A null id draws by its
    text.  Rows of equal id draw the same number; ties are cut in the order of id and size, and repeated rows count
    one by one.  Very long texts count whole.  Other columns are ignored, whatever their names.  An empty table gives
    an empty result.  Reruns agree.
    """
    sized = saved(docs.select(*(c.alias(x) for x, c in _sized(docs, id_col, text_col, source_col, seed).items())), "sized")
    rows = _weighed(sized)
    out = _taken(rows, _plan(rows, weights, share, max_copies, slices), slices)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", "taken")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.0, max_copies: int = MAX_COPIES, seed: str = SEED, slices: int = SLICES) -> DataFrame:
    """All columns of docs, and size, source_size, target, copies and taken as in mix; columns of those names give way.

    Texts meet a plan of a few rows a source, by a broadcast only where the written plan is small.
    """
    parts = _sized(docs, id_col, text_col, source_col, seed)
    rows = _weighed(saved(docs.select(*(c.alias(x) for x, c in parts.items())), "sized"))
    plan = _plan(rows, weights, share, max_copies, slices)
    results = ["size", "source_size", "target", "copies", "taken"]
    (row,) = private("row")
    kept = [x for x in docs.columns if x not in results]
    whole = docs.select(F.struct(*(F.col(f"`{x}`") for x in kept)).alias(row), *(c.alias(x) for x, c in parts.items()))
    return _taken(_weighed(whole), plan, slices).select(*(F.col(f"{row}.`{x}`").alias(x) for x in kept), *results)
