"""MinHash near-dedup: banded candidates, odd sketches to verify them, full sets to confirm them.

1. Each text's set of distinct word shingles is read once.  Equal sets are one node (the smallest id); nodes get
   band keys of BANDS x ROWS MinHash values and an odd sketch: SAMPLES MinHash values folded into a bitmap by
   parity, so that the XOR of two bitmaps counts the samples in which two sets differ.
2. The members of a bucket are paired with one hub of it, never with each other.
3. Pairs whose sketches put the similarity clearly below the threshold go; the rest are held against the full
   sets of shingles.  What is confirmed is an edge; connected components by large-star / small-star steps.
4. Only buckets that hold several components can still add anything.  Those of at most LARGE members give their
   pairs across components.  In larger ones half-alike texts abound, which bands of any length tell apart badly, but
   their rare shingles do: in one order of all shingles, rarest first, two linked sets share one of the shingles that
   come before so many of either set as the link needs.  Members of large buckets get those first shingles as keys,
   and what shares none is out: hubs of these buckets, and then the pairs across components that are left.

A pair of similarity 0.8 shares no band with a probability of 3e-6; first shingles miss none, whatever the order; the
sketch test is over four standard deviations wide.  Nothing is capped: a hub costs a row for each member, small buckets
at most LARGE rows for each member, and first shingles are listed only for members of large buckets that no component
holds together yet.  Every step is a written table, so plans stay short and a lost executor costs no more than a step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .words import Block, blocks, mix, window_starts, windows

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 32, 5
SAMPLES = 256
SKETCH_BITS = 1024
#: Under an estimate of (PERCENT - SLACK) / 100 a pair isn't read in full.
SLACK = 14
#: Members of a bucket that may still meet each other; more meet by their first shingles.  Both ways are exact, so results don't
#: depend on it: pairs of a bucket grow with its size, in each of BANDS bands, and first shingles are rarer than bands.
LARGE = 8
#: Shingles are counted by so many leading bits of their hash, to put rare ones first: a table of 4 MB at any size of the
#: corpus.  Results don't depend on the order, only the number of candidates does.
SLOT_BITS = 20

_MULTIPLIERS = mix(np.arange(SAMPLES, dtype=np.uint64), 7) | np.uint64(1)


def distinct_shingles(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles sorted in each text, where each text's begin): hashes of `size` words, or of all if fewer."""
    words = block.hashes(lower=True)
    doc_word = block.doc_word
    grams = windows(words, size)
    inside = window_starts(doc_word, size) if len(grams) else np.zeros(0, bool)
    values, owners = [grams[inside]], [block.word_doc[: len(grams)][inside]]
    counts = np.diff(doc_word)
    for k in range(1, size):
        docs = np.flatnonzero(counts == k)
        if len(docs):
            values.append(windows(words, k)[doc_word[docs]])
            owners.append(docs)
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    if len(value):
        first = np.ones(len(value), bool)
        first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[first], owner[first]
    return value, np.searchsorted(owner, np.arange(block.n + 1))


def minhashes(value: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A row of SAMPLES values for each set; no set may be empty."""
    out = np.empty((SAMPLES, len(begin) - 1), np.uint64)
    with np.errstate(over="ignore"):
        for k, multiplier in enumerate(_MULTIPLIERS):
            np.minimum.reduceat(value * multiplier, begin[:-1], out=out[k])
    return np.ascontiguousarray(out.T)


def band_keys(hashes: np.ndarray, chosen: np.ndarray, seed: int) -> np.ndarray:
    """A key for each row of `chosen` (columns of a band) in each set; the band's number is part of the key."""
    keys = np.empty((len(hashes), len(chosen)), np.uint64)
    with np.errstate(over="ignore"):
        for band, columns in enumerate(chosen):
            key = np.full(len(hashes), np.uint64(band + 1), np.uint64)
            for column in columns:
                key = mix(key ^ hashes[:, column], seed)
            keys[:, band] = key
    return keys


COARSE = np.arange(BANDS * ROWS).reshape(BANDS, ROWS)


def odd_sketches(hashes: np.ndarray) -> np.ndarray:
    """SKETCH_BITS parities of each row of MinHash values, as packed longs."""
    n = len(hashes)
    with np.errstate(over="ignore"):
        bit = (mix(hashes + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), 3) % np.uint64(SKETCH_BITS)).astype(np.int64)
    counts = np.bincount((bit + np.arange(n)[:, None] * SKETCH_BITS).ravel(), minlength=n * SKETCH_BITS)
    return np.packbits((counts & 1).astype(np.uint8).reshape(n, SKETCH_BITS), axis=1).view(np.int64)


def most_differing_bits(percent: int) -> int:
    """The XOR population count expected at a similarity of percent / 100."""
    return int(np.ceil(SKETCH_BITS / 2 * (1 - np.exp(-2 * (2 * SAMPLES * (1 - percent / 100)) / SKETCH_BITS))))


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel().view(np.int64)))


def _profiler(size: int):
    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                value, begin = distinct_shingles(block, size)
                n = np.diff(begin)
                full = np.flatnonzero(n)
                keys = np.zeros((block.n, BANDS), np.uint64)
                sketch = np.zeros((block.n, SKETCH_BITS // 64), np.int64)
                ids = np.zeros((2, block.n), np.uint64)
                if len(full):
                    starts = np.append(begin[full], len(value))
                    hashes = minhashes(value, starts)
                    keys[full] = band_keys(hashes, COARSE, 5)
                    sketch[full] = odd_sketches(hashes)
                    for k in (0, 1):
                        ids[k, full] = np.add.reduceat(mix(value, 11 + k), starts[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.n), pa.array(n.astype(np.int64)), pa.array(ids[0].view(np.int64)), pa.array(ids[1].view(np.int64)), _lists(keys), _lists(sketch)],
                    names=["id", "n_shingles", "set1", "set2", "bands", "sketch"],
                )

    return profiles


def _set_reader(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                value, begin = distinct_shingles(block, size)
                raw = pa.py_buffer(value.tobytes())
                offsets = pa.py_buffer((begin * 8).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.n), pa.Array.from_buffers(pa.binary(), block.n, [None, offsets, raw])], names=["id", "shingles"]
                )

    return sets


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (shingles): (slot, held), added up by batch: how often a shingle of the slot is in a set."""
    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(0).slice(k, 1024)]
            slot, held = np.unique(_slot(np.concatenate(sets)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(held.astype(np.int64))], names=["slot", "held"])


def first_shingles(value: np.ndarray, begin: np.ndarray, held: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, shingle, rank): each set's first shingles, by the count of their slot and then by hash, where a link can show.

    Linked sets share percent% of either at least, so one of the first n - ceil(percent% of n) + 1 of both.  A shingle
    alone in its slot is in no other set and is left out; the ranks of the others stay.
    """
    n = np.diff(begin)
    owner = np.repeat(np.arange(len(n)), n)
    count = held[_slot(value)]
    order = np.lexsort((value, count, owner))
    rank = np.arange(len(value)) - begin[owner]
    keep = (100 * (n[owner] - rank) >= percent * n[owner]) & (count[order] > 1)
    return owner[keep], value[order][keep], rank[keep]


def _first_keys(held, percent: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From (id, component, shingles): both, the set's size n, what it can share from this key on, and the key."""
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column(2)]
                n = np.array([len(x) for x in sets])
                owner, key, rank = first_shingles(np.concatenate(sets), np.append(0, np.cumsum(n)), held.value, percent)
                columns = [*(part.column(c).take(pa.array(owner)) for c in (0, 1)), pa.array(n[owner]), pa.array(n[owner] - rank), pa.array(key.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "shared", "key"])

    return keys


def _confirmer(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True)) if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return confirm


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for each end of an edge (a, b) the smallest id that it reaches.

    Large-star and small-star steps by turns until nothing moves; every round is a written table, so its plan
    stays short and a lost executor costs no more than the round.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "stars")
    while True:
        roles = now.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("b", F.lit(0), F.lit(1)))
        # done when every node has one link up, or only links from below
        if roles.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up > 0 AND down > 0)").isEmpty():
            return saved(now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b")).distinct(), "components")
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(least.filter("u > m")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        now = saved(small.filter("a <> b").distinct(), "stars")


def _crowds(keys: DataFrame, name: str) -> DataFrame:
    """The rows (id, n, key) of buckets with two members or more, with the bucket's size m."""
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").withColumnRenamed("key", "k")
    return saved(keys.join(sizes, F.col("key") == F.col("k")).drop("k"), name)


def _hub_pairs(rows: DataFrame, percent: int | None = None) -> DataFrame:
    """Pairs of each member of a bucket with its hub, of rows (id, key, m); with percent (see _fits) only those that fit.

    The hub is the member whose buckets are the largest all in all: of many copies of one text, one close to it.
    """
    weight = rows.groupBy(F.col("id").alias("i")).agg(F.sum("m").alias("weight"))
    hubs = rows.join(weight, F.col("id") == F.col("i")).groupBy(F.col("key").alias("x_key"))
    side = [] if percent is None else ["component", "n", "shared"]
    top = F.max(F.struct("weight", F.xxhash64("id").alias("h"), "id", *side))
    hubs = hubs.agg(*(top[x].alias(f"x_{x}") for x in ("id", *side)))
    pairs = rows.join(hubs, (F.col("x_key") == F.col("key")) & (F.col("id") != F.col("x_id") if percent is None else _fits(percent)))
    return pairs.select(F.least("x_id", "id").alias("a"), F.greatest("x_id", "id").alias("b")).distinct()


def _open(rows: DataFrame) -> DataFrame:
    """rows (id, key, component, ...) of buckets that hold several components, with the one of most rows as `main`."""
    shares = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("rows"))
    main = shares.groupBy("key").agg(F.max(F.struct("rows", "component")).alias("main"), F.count(F.lit(1)).alias("parts"))
    main = main.filter("parts > 1").select(F.col("key").alias("k"), F.col("main.component").alias("main"))
    return rows.join(main, F.col("key") == F.col("k")).drop("k")


def _fits(percent: int) -> Column:
    """Can a member and another (x_...) of its bucket be a link across components?

    n: a set's size; shared: what it can share with others at most, having shared nothing before this key.
    """
    sizes = 100 * F.least("x_n", "n") >= percent * F.greatest("x_n", "n")
    enough = (100 + percent) * F.least("x_shared", "shared") >= percent * (F.col("n") + F.col("x_n"))
    return (F.col("x_component") != F.col("component")) & sizes & enough


def _open_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of open buckets (see _open) across components: members outside the main one with all others that fit, each pair once."""
    others = rows.filter("component <> main").select(*(F.col(x).alias(f"x_{x}") for x in ("id", "component", "key", "n", "shared")))
    once = (F.col("component") == F.col("main")) | (F.col("x_id") < F.col("id"))
    pairs = others.join(rows, (F.col("x_key") == F.col("key")) & once & _fits(percent))
    return pairs.select(F.least("x_id", "id").alias("a"), F.greatest("x_id", "id").alias("b")).distinct()


def _with_component(rows: DataFrame, found: DataFrame, id_col: str = "id", name: str = "component") -> DataFrame:
    """rows with the component of an id; an id without a link is its own."""
    both = rows.join(found.select(F.col("id").alias("_i"), F.col("component").alias("_of")), F.col(id_col) == F.col("_i"), "left")
    return both.withColumn(name, F.coalesce("_of", id_col)).drop("_i", "_of")


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """found (id, component) with links (a, b) added: only the components that links join are closed again."""
    ends = _with_component(_with_component(links, found, "a", "x"), found, "b", "y")
    roots = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    moved = found.join(roots.select(F.col("id").alias("r"), F.col("component").alias("to")), F.col("component") == F.col("r"), "left")
    return saved(moved.select("id", F.coalesce("to", "component").alias("component")).union(roots).distinct(), "components")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of docs.

    Words are runs of characters other than ASCII white space, with A-Z folded; a text's set holds its distinct
    runs of `shingle` words, or all its words as one where it has fewer.  Texts are linked where
    100 * intersection >= percent * union; component_id is the smallest id reachable over links; kept is
    id = component_id.  A text that is null or has no words has an empty set, is linked with nothing and is kept.
    Rows of equal id are one node, linked with what any of their texts is; repeated rows give repeated results.
    A null id is linked with nothing: its component is null and it is kept.  Very long texts count with all their
    shingles.  Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    profile = saved(texts.mapInArrow(_profiler(shingle), f"id {id_type}, n_shingles long, set1 long, set2 long, bands array<long>, sketch array<long>"), "profiles")
    some = profile.filter("n_shingles > 0 AND id IS NOT NULL")
    classes = saved(some.groupBy("set1", "set2").agg(F.min("id").alias("node")), "classes")
    same = ["id", "set1", "set2"]
    nodes = saved(some.join(classes.select(F.col("node").alias("id"), "set1", "set2"), same, "left_semi").dropDuplicates(same).select("id", F.col("n_shingles").alias("n"), "bands", "sketch"), "nodes")
    members = _crowds(nodes.select("id", "n", F.explode("bands").alias("key")).distinct(), "buckets")
    sets = saved(texts.join(members.select("id").distinct(), "id", "left_semi").mapInArrow(_set_reader(shingle), f"id {id_type}, shingles binary"), "sets")

    def sides(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
        a, b = (of.select(F.col("id").alias(f"{x}_id"), F.col(column).alias(f"{x}_{column}")) for x in "ab")
        return pairs.join(a, F.col("a") == F.col("a_id")).join(b, F.col("b") == F.col("b_id")).select("a", "b", f"a_{column}", f"b_{column}")

    def confirmed(pairs: DataFrame) -> DataFrame:
        differing = F.aggregate(F.zip_with("a_sketch", "b_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        near = sides(pairs, nodes, "sketch").filter(differing <= most_differing_bits(percent - SLACK)).select("a", "b")
        return saved(sides(near, sets, "shingles").mapInArrow(_confirmer(percent), f"a {id_type}, b {id_type}").distinct(), "links")

    tried = saved(_hub_pairs(members), "hub-pairs")
    links = confirmed(tried)
    torn = saved(some.groupBy("id").agg(F.min("set1").alias("x"), F.max("set1").alias("y")).filter("x <> y").select("id"), "torn")
    if not torn.isEmpty():
        links = links.union(some.join(torn, "id", "left_semi").join(classes, ["set1", "set2"]).select(F.col("id").alias("a"), F.col("node").alias("b")))
    found = components(links)

    placed = saved(_open(_with_component(members, found)), "open-buckets")
    pairs = _open_pairs(placed.filter(F.col("m") <= LARGE).withColumn("shared", F.col("n")), percent).join(tried, ["a", "b"], "left_anti")
    large = placed.filter(F.col("m") > LARGE)
    crowd = saved(large.select("id", "component").distinct().join(sets, "id"), "crowd")
    counts = crowd.select("shingles").mapInArrow(_slot_counts, "slot long, held long").groupBy("slot").agg(F.sum("held").alias("held")).filter("held > 1").toArrow()
    held = np.ones(1 << SLOT_BITS, np.int64)
    held[counts["slot"].to_numpy()] = counts["held"].to_numpy()
    order = docs.sparkSession.sparkContext.broadcast(np.minimum(held, 2**31 - 1).astype(np.int32))
    keys = crowd.select("id", "component", "shingles").mapInArrow(_first_keys(order, percent), f"id {id_type}, component {id_type}, n long, shared long, key long")
    keys = saved(keys, "first-shingles")
    order.destroy()
    firsts = saved(_open(keys), "first-buckets")
    hubs = saved(_hub_pairs(firsts.withColumn("m", F.lit(1)), percent).join(tried, ["a", "b"], "left_anti"), "first-hubs")
    found = _merged(found, confirmed(pairs.union(hubs).distinct()))
    left = _open_pairs(_open(_with_component(firsts.select("id", "n", "shared", "key"), found)), percent).join(tried.union(hubs), ["a", "b"], "left_anti")
    left = saved(left, "last-pairs")
    if not left.isEmpty():
        found = _merged(found, confirmed(left))

    whole = classes.join(found.withColumnRenamed("id", "i"), F.col("node") == F.col("i"), "left")
    whole = whole.select(F.col("set1").alias("s1"), F.col("set2").alias("s2"), F.coalesce("component", "node").alias("of"))
    rows = profile.select("id", "n_shingles", "set1", "set2")
    linked = rows.filter("n_shingles > 0 AND id IS NOT NULL").join(whole, (F.col("set1") == F.col("s1")) & (F.col("set2") == F.col("s2")))
    out = linked.select("id", "n_shingles", F.col("of").alias("component_id")).union(
        rows.filter("n_shingles = 0 OR id IS NULL").select("id", "n_shingles", F.col("id"))
    )
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
