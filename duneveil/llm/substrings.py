"""Substring dedup: Rabin-Karp hashes of every window of SIZE words, counted in Spark.

A window is repeated if its word sequence starts anywhere else.  Words under repeated windows are removed, as
maximal intervals.  To keep all windows of a corpus from being shuffled, windows are first held apart by anchors:
the smallest hash of ANCHOR words inside a window.  Equal windows have equal anchors, so only windows whose
anchor occurs twice or more can be repeated; those, and only those, are shuffled and counted by their own hash.
Texts with equal word sequences are one text that counts twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .words import BASE, Block, blocks, mix, powers, window_starts, windows

SIZE = 35
ANCHOR = 8
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def sequence_ids(block: Block, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's word sequence; 0 without words."""
    out = []
    full = np.flatnonzero(np.diff(block.doc_word))
    with np.errstate(over="ignore"):
        place = np.arange(len(words)) - block.doc_word[block.word_doc]
        for seed in (31, 32):
            ids = np.zeros(block.n, np.uint64)
            if len(full):
                terms = mix(words, seed) * powers(BASE, int(place.max()) + 1)[place]
                ids[full] = mix(np.add.reduceat(terms, block.doc_word[full]), seed)
            out.append(ids.view(np.int64))
    return out[0], out[1]


def joined(block: Block, keep: np.ndarray | None = None) -> list[bytes]:
    """Each text's kept words, joined by one space."""
    start, end, doc = (block.start, block.end, block.word_doc) if keep is None else (block.start[keep], block.end[keep], block.word_doc[keep])
    marks = np.zeros(len(block.data) + 2, np.int32)
    np.add.at(marks, start, 1)
    np.add.at(marks, end + 1, -1)
    taken = np.cumsum(marks)[: len(block.data)] > 0
    data = block.data.copy()
    data[end] = 32
    flat = data[taken].tobytes()
    lengths = np.bincount(doc, weights=(end - start + 1), minlength=block.n).astype(np.int64)
    stops = np.cumsum(lengths)
    return [flat[a : b - 1] if b > a else b"" for a, b in zip(stops - lengths, stops, strict=True)]


def anchored(block: Block, words: np.ndarray, size: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each window inside a text, the word at which its anchor starts, hashes of runs of `anchor` words)."""
    n = len(words) - size + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    grams = windows(words, anchor)
    starts = np.flatnonzero(window_starts(block.doc_word, size))
    width = size - anchor + 1
    least = sliding_window_view(grams, width).argmin(axis=1)
    return starts, starts + least[starts], grams


def _profiler(size: int, anchor: int):
    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                words = block.hashes()
                seq1, seq2 = sequence_ids(block, words)
                _, at, grams = anchored(block, words, size, anchor)
                at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
                doc = block.word_doc[at]
                offsets = pa.array(np.searchsorted(doc, np.arange(block.n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(block.first, block.n) for c in (0, 1)), pa.array(np.diff(block.doc_word).astype(np.int64)), pa.array(seq1), pa.array(seq2),
                        pa.array([hashlib.sha256(x).hexdigest() for x in joined(block)], pa.string()),
                        pa.ListArray.from_arrays(offsets, pa.array(grams[at].view(np.int64))),
                        pa.ListArray.from_arrays(offsets, pa.array((at - block.doc_word[doc]).astype(np.int32))),
                    ],
                    names=["id", "key", "n_words", "seq1", "seq2", "sha", "anchors", "places"],
                )

    return profiles


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The owners and values of a list column."""
    lengths = np.asarray(lists.value_lengths().fill_null(0))
    return np.repeat(np.arange(len(lists)), lengths), np.asarray(lists.flatten())


def _windower(size: int, anchor: int):
    def doubted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From (key, copies, text, places): (hash, key, start, copies) of windows on those anchors."""
        for batch in batches:
            owner, place = _flat(batch.column("places"))
            for block in blocks(batch.column("text")):
                words = block.hashes()
                starts, at, _ = anchored(block, words, size, anchor)
                a, b = np.searchsorted(owner, [block.first, block.first + block.n])
                wanted = np.zeros(len(words) + 1, bool)
                wanted[np.minimum(block.doc_word[owner[a:b] - block.first] + place[a:b], len(words))] = True
                hit = wanted[at]
                starts = starts[hit]
                doc = block.word_doc[starts]
                rows = pa.array(doc + block.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(windows(words, size)[starts].view(np.int64)), batch.column("key").take(rows), pa.array((starts - block.doc_word[doc]).astype(np.int32)), batch.column("copies").take(rows),
                    ],
                    names=["hash", "key", "start", "copies"],
                )

    return doubted


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie under windows with these starts."""
    marks = np.zeros(n + size + 1, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + size, -1)
    return np.cumsum(marks)[:n] > 0


def _remover(size: int):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From (key, text, starts): the kept text, what was removed, and the intervals of words."""
        for batch in batches:
            owner, start = _flat(batch.column("starts"))
            for block in blocks(batch.column("text")):
                a, b = np.searchsorted(owner, [block.first, block.first + block.n])
                gone = covered(block.doc_word[owner[a:b] - block.first] + start[a:b], size, len(block.start))
                texts = joined(block, ~gone)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
                first, last = edges[0::2], edges[1::2]
                # two removed stretches of neighbouring texts may touch
                inner = block.doc_word[1:-1]
                cut = inner[(inner > 0) & (inner < len(gone))]
                cut = np.unique(cut[gone[cut - 1] & gone[cut]]) if len(cut) else cut
                first, last = np.sort(np.concatenate([first, cut])), np.sort(np.concatenate([last, cut]))
                doc = block.word_doc[first] if len(first) else np.zeros(0, np.int64)
                offsets = pa.array(np.searchsorted(doc, np.arange(block.n + 1)).astype(np.int32))
                pairs = pa.StructArray.from_arrays([pa.array((first - block.doc_word[doc]).astype(np.int64)), pa.array((last - block.doc_word[doc]).astype(np.int64))], names=["first", "end"])
                removed = np.bincount(block.word_doc, weights=gone, minlength=block.n).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").slice(block.first, block.n), pa.array(removed),
                        pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()), pa.ListArray.from_arrays(offsets, pairs),
                    ],
                    names=["key", "n_removed", "sha", "removed"],
                )

    return kept


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, anchor: int = ANCHOR) -> DataFrame:
    """(id, n_words, n_removed, removed, kept_sha256) for every row of docs.

    removed: the maximal intervals [first, end) of removed words, counted from 0.  kept_sha256: of the kept words
    joined by one space.  Words are runs of characters other than ASCII white space, compared as they are.
    A null text has no words; very long texts count whole.  Rows are told apart by a 64-bit hash of id and text, so
    an id may be null or stand for several texts; rows whose texts have the same words are copies of each other, and
    all their windows are repeated.  Windows are compared by a 64-bit hash.  Other columns are ignored, whatever
    their names; an empty table gives an empty result.
    """
    assert size >= anchor > 0
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.select("id", F.xxhash64("id", "text").alias("key"), "text")
    id_type = texts.schema["id"].dataType.simpleString()
    kind = f"id {id_type}, key long, n_words long, seq1 long, seq2 long, sha string, anchors array<long>, places array<int>"
    profile = saved(texts.mapInArrow(_profiler(size, anchor), kind), "sequences")
    long = profile.filter(F.col("n_words") >= size)
    classes = saved(long.groupBy("seq1", "seq2").agg(F.min("key").alias("node"), F.count(F.lit(1)).alias("copies")), "copies")
    one = classes.select(F.col("seq1").alias("s1"), F.col("seq2").alias("s2"), "node", "copies")
    same = (F.col("seq1") == F.col("s1")) & (F.col("seq2") == F.col("s2"))
    nodes = long.join(one, same & (F.col("key") == F.col("node"))).select("key", F.least("copies", F.lit(2)).cast("int").alias("copies"), F.explode(F.arrays_zip("anchors", "places")).alias("x"))
    nodes = nodes.select("key", "copies", F.col("x.anchors").alias("anchor"), F.col("x.places").alias("place"))
    twice = nodes.groupBy("anchor").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.col("anchor").alias("twice"))
    twice = saved(twice, "anchors")  # read back, it meets a common anchor's rows in as many tasks as they need
    doubt = nodes.join(twice, F.col("anchor") == F.col("twice")).groupBy("key", "copies").agg(F.array_sort(F.collect_list("place")).alias("places"))
    told = doubt.withColumnRenamed("key", "k")
    held = saved(texts.join(told, F.col("key") == F.col("k")).select("key", "copies", "text", "places"), "doubted")

    found = held.mapInArrow(_windower(size, anchor), "hash long, key long, start int, copies int")
    counts = found.groupBy("hash").agg(F.sum("copies").alias("n")).filter("n > 1").select(F.col("hash").alias("again"))
    counts = saved(counts, "repeated")
    starts = found.filter("copies = 1").join(counts, F.col("hash") == F.col("again")).groupBy(F.col("key").alias("k")).agg(F.array_sort(F.collect_list("start")).alias("starts"))
    rows = held.filter("copies = 1").join(starts, F.col("key") == F.col("k")).select("key", "text", "starts")
    cut = rows.mapInArrow(_remover(size), "key long, n_removed long, sha string, removed array<struct<first:long,end:long>>")

    copies = one.filter("copies > 1").select("s1", "s2", F.lit(True).alias("copy"))
    out = profile.drop("anchors", "places").join(copies, same & (F.col("n_words") >= size), "left")
    cut = cut.select(F.col("key").alias("k"), F.col("n_removed").alias("cut"), F.col("sha").alias("cut_sha"), "removed")
    out = out.join(cut, F.col("key") == F.col("k"), "left")
    all_words = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_words").alias("end")))
    none = F.expr("CAST(array() AS array<struct<first:bigint,end:bigint>>)")
    return out.select(
        F.col("id").alias(id_col), "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), all_words).otherwise(F.coalesce("removed", none)).alias("removed"),
        F.when(F.col("copy"), F.lit(EMPTY_SHA)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )
