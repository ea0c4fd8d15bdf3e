"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over a run of words: only the positions marked # are hashed, so a hit survives substitutions at
the others.  Test items and training texts are hashed under every mask and joined on the hashes; around each hit
the two are laid over each other, word by word, and the overlap is confirmed with substitutions counted.

Training windows are first held against a bitmap of the test hashes (a fixed 2**FILTER_BITS bits, whatever the
size of the benchmark).  What passes is joined with the test hashes by a shuffle join, so a fuller bitmap costs
rows but changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .words import BASE, blocks, mix

#: Fixed masks, from the longest to the shortest; the shortest span is the shortest item that can be found.
MASKS = ("##.#.##.#.##", "###..#.#.###", "##.##.##.#", "#.###.#.##", "######", "##.###", "###.##", "#####")
#: Words on each side of a hit that are kept to lay it over an item.
REACH = 64
FILTER_BITS = 27
#: An overlap counts from so many equal words on, or so large a share of the item, ...
MIN_EQUAL = 13
MIN_ITEM_SHARE = 0.6
#: ... in a stretch of which so large a share is equal; the share of the item counts over the whole overlay as well.
MIN_STRETCH_SHARE = 0.7


def seed_hashes(words: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The hash of the marked positions of each run of len(mask) words."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(number + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k, mark in enumerate(mask):
            if mark == "#":
                out *= BASE
                out += words[k : k + n]
    return mix(out, 41)


def _inside(doc_word: np.ndarray, span: int, n: int) -> np.ndarray:
    ok = np.ones(n, bool)
    for k in doc_word[1:-1]:
        ok[max(int(k) - span + 1, 0) : min(int(k), n)] = False
    return ok


def _item_reader(masks: tuple[str, ...]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(item, seed, place, words): a row for each seed of each item, with the item's words in the first."""
        for batch in batches:
            for block in blocks(batch.column(1)):
                words = block.hashes(lower=True)
                seeds, places, owners = [], [], []
                for number, mask in enumerate(masks):
                    found = seed_hashes(words, mask, number)
                    at = np.flatnonzero(_inside(block.doc_word, len(mask), len(found)))
                    seeds.append(found[at])
                    places.append(at - block.doc_word[block.word_doc[at]])
                    owners.append(block.word_doc[at])
                seed, place, owner = np.concatenate(seeds), np.concatenate(places), np.concatenate(owners)
                order = np.argsort(owner, kind="stable")
                offsets = pa.array(np.searchsorted(owner[order], np.arange(block.n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, block.n), pa.ListArray.from_arrays(pa.array(block.doc_word.astype(np.int32)), pa.array(words.view(np.int64))),
                        pa.ListArray.from_arrays(offsets, pa.array(seed[order].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(place[order].astype(np.int32))),
                    ],
                    names=["item", "item_words", "seeds", "places"],
                )

    return read


def _scanner(masks: tuple[str, ...], bitmap, reach: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, region, first, words, seeds, places): regions of a text around windows that pass the bitmap."""
        bits = np.frombuffer(bitmap.value, np.uint64)
        shift, low = np.uint64(64 - FILTER_BITS), np.uint64(63)
        for batch in batches:
            for block in blocks(batch.column(1)):
                words = block.hashes(lower=True)
                seeds, places = [], []
                for number, mask in enumerate(masks):
                    found = seed_hashes(words, mask, number)
                    slot = found >> shift
                    at = np.flatnonzero((bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & low)) & np.uint64(1))
                    if len(at):
                        at = at[_inside(block.doc_word, len(mask), len(found))[at]]
                    seeds.append(found[at])
                    places.append(at)
                seed, place = np.concatenate(seeds), np.concatenate(places)
                if not len(place):
                    continue
                order = np.argsort(place, kind="stable")
                seed, place = seed[order], place[order]
                doc = block.word_doc[place]
                new = np.append(True, (doc[1:] != doc[:-1]) | (place[1:] - place[:-1] > reach))
                begin = np.flatnonzero(new)
                end = np.append(begin[1:], len(place))
                first = np.maximum(place[begin] - reach, block.doc_word[doc[begin]])
                last = np.minimum(place[end - 1] + len(max(masks, key=len)) + reach, block.doc_word[doc[begin] + 1])
                sizes = np.append(0, np.cumsum(last - first)).astype(np.int32)
                flat = np.concatenate([words[a:b] for a, b in zip(first, last, strict=True)]).view(np.int64)
                hits = pa.array(np.append(begin, len(place)).astype(np.int32))
                base = block.doc_word[doc[begin]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(doc[begin] + block.first)), pa.array((first - base).astype(np.int64)), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat)),
                        pa.ListArray.from_arrays(hits, pa.array(seed.view(np.int64))), pa.ListArray.from_arrays(hits, pa.array((place - np.repeat(first, end - begin)).astype(np.int32))),
                    ],
                    names=["id", "first", "words", "seeds", "places"],
                )

    return scan


def best_stretch(equal: np.ndarray, share: float) -> tuple[int, int, int]:
    """(begin, end, equal words) of the stretch with the highest score, an equal word +1 and another -share/(1-share)."""
    score = np.where(equal, 1.0, -share / (1 - share))
    total = np.concatenate([[0.0], np.cumsum(score)])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    begin = int(np.argmin(total[: end + 1]))
    return begin, end, int(equal[begin:end].sum())


def _verifier(min_equal: int, item_share: float, stretch_share: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From (id, item, diagonal, first, words, item_words) the overlaps that count."""
        for batch in batches:
            text, item = batch.column("words"), batch.column("item_words")
            rows, begins, ends, equals, sizes = [], [], [], [], []
            for k, (diagonal, first) in enumerate(zip(batch.column("diagonal").to_pylist(), batch.column("first").to_pylist(), strict=True)):
                a, b = np.asarray(text[k].values), np.asarray(item[k].values)
                low, high = max(0, -diagonal), min(len(b), len(a) - diagonal)
                if high <= low:
                    continue
                same = a[low + diagonal : high + diagonal] == b[low:high]
                begin, end, equal = best_stretch(same, stretch_share)
                if (every := int(same.sum())) >= item_share * len(b):
                    at = np.flatnonzero(same)
                    begin, end, equal = int(at[0]), int(at[-1]) + 1, every
                if equal >= min(min_equal, item_share * len(b)):
                    rows.append(k)
                    begins.append(first + diagonal + low + begin)
                    ends.append(first + diagonal + low + end)
                    equals.append(equal)
                    sizes.append(len(b))
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [taken.column("id"), taken.column("item"), pa.array(begins, pa.int64()), pa.array(ends, pa.int64()), pa.array(equals, pa.int64()), pa.array(sizes, pa.int64())],
                names=["id", "item", "first_word", "end_word", "n_equal", "n_item_words"],
            )

    return verify


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    masks: tuple[str, ...] = MASKS, reach: int = REACH, min_equal: int = MIN_EQUAL, item_share: float = MIN_ITEM_SHARE, stretch_share: float = MIN_STRETCH_SHARE,
) -> DataFrame:
    """(id, item, first_word, end_word, n_equal, n_item_words): for each text and item the best confirmed overlap.

    Words are runs of characters other than ASCII white space, with A-Z folded.  Text and item are laid over each
    other so that a seed fits, and the best stretch of that overlay (an equal word scores 1, another
    -stretch_share / (1 - stretch_share)) is a leak if it has min_equal equal words, or item_share of the item's
    words where those are fewer.  An overlay in which item_share of the item's words are equal is a leak however
    they lie, from the first of them to the last.  first_word and end_word count the text's words from 0.  A stretch ends at
    `reach` words from the hits, and is found again from the next ones.
    Null or empty texts and items, and items shorter than the shortest mask, give nothing; rows of equal id are
    one text as far as results go (the best overlap of any); a null id is an id.  Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    kinds = texts.schema["id"].dataType.simpleString(), items.schema["item"].dataType.simpleString()
    items = saved(items.mapInArrow(_item_reader(masks), f"item {kinds[1]}, item_words array<long>, seeds array<long>, places array<int>"), "items")
    items = items.withColumn("item_key", F.xxhash64("item", "item_words"))
    seeds = items.select("item", "item_key", F.explode(F.arrays_zip("seeds", "places")).alias("x")).select("item", "item_key", F.col("x.seeds").alias("seed"), F.col("x.places").alias("item_place"))
    slots = seeds.select(F.shiftrightunsigned("seed", 64 - FILTER_BITS).alias("slot"))
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    cells = slots.groupBy(F.expr("slot DIV 64").alias("cell")).agg(F.expr("bit_or(shiftleft(1L, CAST(slot % 64 AS INT)))").alias("bits"))
    for cell in cells.toLocalIterator():  # at most 2**(FILTER_BITS - 6) rows, whatever the benchmark
        bitmap[cell["cell"]] = np.uint64(cell["bits"] & 0xFFFFFFFFFFFFFFFF)
    shared = spark.sparkContext.broadcast(bitmap.tobytes())

    regions = texts.mapInArrow(_scanner(masks, shared, reach), f"id {kinds[0]}, first long, words array<long>, seeds array<long>, places array<int>")
    regions = saved(regions.withColumn("region", F.xxhash64("id", "first", "words")), "regions")
    shared.destroy()
    hits = regions.select("region", F.explode(F.arrays_zip("seeds", "places")).alias("x")).select("region", F.col("x.seeds").alias("hit"), F.col("x.places").alias("place"))
    laid = hits.join(seeds, F.col("hit") == F.col("seed")).select("region", "item_key", (F.col("place") - F.col("item_place")).alias("diagonal")).distinct()
    pairs = laid.join(items.select(F.col("item_key").alias("k"), "item", "item_words"), F.col("item_key") == F.col("k"))
    pairs = pairs.join(regions.select(F.col("region").alias("r"), "id", "first", "words"), F.col("region") == F.col("r"))
    # of a long region only the words under the item go on, once for each overlay
    begin = F.greatest(F.col("diagonal"), F.lit(0))
    under = F.greatest(F.least(F.size("words"), F.col("diagonal") + F.size("item_words")) - begin, F.lit(0))
    laid_over = ((F.col("diagonal") - begin).alias("diagonal"), (F.col("first") + begin).alias("first"), F.slice("words", begin + 1, under).alias("words"))
    found = pairs.select("id", "item", *laid_over, "item_words").mapInArrow(
        _verifier(min_equal, item_share, stretch_share), f"id {kinds[0]}, item {kinds[1]}, first_word long, end_word long, n_equal long, n_item_words long"
    )
    best = found.groupBy("id", "item").agg(F.max(F.struct("n_equal", (-F.col("first_word")).alias("first"), (-F.col("end_word")).alias("end"), "n_item_words")).alias("x"))
    return best.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), (-F.col("x.first")).alias("first_word"), (-F.col("x.end")).alias("end_word"), F.col("x.n_equal"), F.col("x.n_item_words")
    )
