"""Best-fit packing: documents become pieces of token ids, and vector best-fit lays pieces into sequences.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared lengths, what attention within
documents costs).  Pieces come longest first, and each goes to the open sequence where it fits under every capacity and leaves
the least: by the norm of what is left, or by the dot product of what is left with what the piece asks for.
Pieces are dealt evenly into groups of a bounded size that are packed at once, one task each; the few sequences that a group
leaves with room are opened again and packed with those of the other groups.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved
from .words import parts

LIMIT = 4096
END_ID = 1
#: Pieces that one task packs, about.
GROUP = 8192
#: A sequence with more than this share of its tokens free is opened again.
ROOM = 1 / 64
#: Bytes of text that are tokenized at a time; longer texts are cut at blanks.
PART_BYTES = 8 << 20
#: Distinct words that a worker remembers at a time, about.
WORDS = 1_000_000

# ASCII letters and digits, and marks that are never in one token with them nor in a special token.
MARKS = r"([0-9A-Za-z])([.,:;?!]+[ \t\n\v\f\r])"


class WordIds:
    """Token ids of texts by a tokenizer whose splitter never joins what ASCII blanks part: a distinct word is tokenized by the
    library once while it is remembered.  Words that were met since the last half of WORDS new ones stay remembered."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        """Tokenize new words, some hundreds in one text, and tell their tokens apart by where they begin."""
        groups = [words[k : k + 256] for k in range(0, len(words), 256)]
        for group, found in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            first = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)) + 1)
            at = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
            stop = np.searchsorted(at, first)
            raw, begin = np.array(found.ids, "<u4").tobytes(), 0
            for w, end in zip(group, (4 * stop).tolist(), strict=True):
                self.known[w] = raw[begin:end]
                begin = end

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each text's begin in them and where the last one's end)."""
        # marks at the end of an ASCII word are tokens of their own, and words without them are fewer
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, MARKS, r"\1 \2"))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > WORDS // 2:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        new = []
        for w in distinct:
            if w not in known:
                if (ids := old.get(w)) is None:
                    new.append(w)
                else:
                    known[w] = ids
        self._learn(new)
        held = [known[w] for w in distinct]
        size = np.fromiter(map(len, held), np.int64, len(held)) // 4
        first = np.cumsum(size) - size
        values = np.frombuffer(b"".join(held), "<u4")
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        stop = np.concatenate([[0], np.cumsum(size[at])])
        ids = values[np.repeat(first[at] - stop[:-1], size[at]) + np.arange(stop[-1])]
        return ids, stop[np.asarray(words.offsets) - words.offsets[0].as_py()]


_encoders: dict[str, WordIds] = {}


def _encoder(path: str) -> WordIds:
    """A worker's encoder outlives its tasks."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def _piecer(path: str, limit: int, end_id: int):
    end = np.array([end_id], "<u4")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            waiting, began = np.zeros(0, "<u4"), 0  # of the text that goes on: ids not yet in a piece, and ids before them
            for some in parts(batch.column(1).to_pylist(), PART_BYTES):
                ids, at = encode(pa.array([p for _, p, _ in some], pa.large_utf8()))
                rows, starts, cut = [], [], []
                for k, (row, _, last) in enumerate(some):
                    waiting = np.concatenate([waiting, ids[at[k] : at[k + 1]], end] if last else [waiting, ids[at[k] : at[k + 1]]])
                    whole = len(waiting) if last else len(waiting) // limit * limit
                    for x in range(0, whole, limit):
                        rows.append(row)
                        starts.append(began + x)
                        cut.append(waiting[x : min(x + limit, whole)].tobytes())
                    waiting, began = (waiting[:0], 0) if last else (waiting[whole:], began + whole)
                start = np.array(starts, np.int64)
                length = np.fromiter(map(len, cut), np.int64, len(cut)) // 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(start // limit, pa.int32()), pa.array(start), pa.array(length), pa.array(cut, pa.binary())],
                    names=["id", "piece", "start", "length", "ids"],
                )

    return pieces


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, ids) of every row: a text's token ids and end_id, cut after every limit ids.

    tokenizer: a file of the tokenizers library whose splitter parts at ASCII blanks; no special tokens are added.  piece
    counts from 0, start is the number of the row's ids before it, ids are little-endian unsigned 32-bit numbers.  A null or
    empty text is end_id alone.  Texts are tokenized whole, long ones in parts.  Null and repeated ids and repeated rows are
    documents of their own, an empty table gives no pieces, and other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_piecer(tokenizer, limit, end_id), f"id {kind}, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)


def best_fit(length: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces that come longest first; capacity: tokens, documents, attention cost."""
    limits, weight = np.array(capacity, float), np.array(weights, float)
    asked = np.stack([length, np.ones(len(length)), length.astype(float) ** 2], 1) / limits
    if (asked > 1).any():
        raise ValueError("a piece is larger than a sequence")
    asked_least = np.minimum.accumulate(asked[::-1])[::-1]  # what any later piece asks for at least
    left = np.empty((max(len(length), 1), 3))
    name, used = np.empty(len(left), np.int64), np.zeros(len(left), np.int64)
    n, made = 0, 0
    sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    for k, v in enumerate(asked):
        after = left[:n] - v
        fits = (after > -1e-9).all(1)
        if fits.any():
            score = (weight * after**2).sum(1) if rule == "norm" else (weight * left[:n] * v).sum(1)
            x = int(np.where(fits, score, np.inf).argmin())
        else:
            x, n = n, n + 1
            left[x], name[x], used[x] = 1.0, made, 0
            made += 1
        sequence[k], offset[k] = name[x], used[x]
        left[x] -= v
        used[x] += length[k]
        if k + 1 < len(asked) and (left[x] < asked_least[k + 1] - 1e-9).any():  # nothing to come fits
            n -= 1
            left[x], name[x], used[x] = left[n], name[n], used[n]
    return sequence, offset


def _packer(capacity: tuple[float, float, float], weights: tuple[float, float, float], rule: str, turn: int, last: bool, names: list[str]):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        length = rows.column(names[0]).to_numpy().astype(np.int64)
        order = np.argsort(-length, kind="stable")
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        sequence[order], offset[order] = best_fit(length[order], capacity, weights, rule)
        room = np.zeros(len(length), bool)
        if not last:
            room = (capacity[0] - np.bincount(sequence, weights=length) > capacity[0] * ROOM)[sequence]
        sequence += (turn << 60) + (TaskContext.get().partitionId() << 30)
        rows = rows.append_column(names[1], pa.array(sequence, mask=room)).append_column(names[2], pa.array(offset))
        yield from rows.to_batches(10_000)

    return packed


def pack(
    items: DataFrame, length_col: str = "length", capacity: int = LIMIT, max_items: int | None = None, max_attention: float | None = None,
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm", group: int = GROUP, sequence_col: str = "sequence_id", offset_col: str = "offset",
) -> DataFrame:
    """items with sequence_id and offset: where each begins, gapless from 0, in which sequence.

    A sequence holds at most capacity tokens, max_items items and max_attention of squared lengths (None: as many as capacity
    allows).  rule: "norm" or "dot" (see best_fit), over shares of the capacities weighed by weights.  A length is 0 or more; one
    that no sequence can hold is an error.  Sequences without an item don't arise; repeated rows are items of their own, ties go by the
    order of rows, which Spark deals alike each time, and an empty table stays empty.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule}")
    limits = (float(capacity), float(max_items or max(capacity, 1)), float(max_attention or capacity**2))
    names = [length_col, sequence_col, offset_col]
    kinds = T.StructType([*items.schema.fields, T.StructField(sequence_col, T.LongType()), T.StructField(offset_col, T.LongType())])
    left, done = saved(items, "pieces"), None
    for turn in (0, 1):
        groups = math.ceil(left.count() / group)
        last = turn == 1 or groups <= 1
        out = saved(left.repartition(max(groups, 1)).mapInArrow(_packer(limits, weights, rule, turn, last, names), kinds), "packed")
        fixed = out.filter(F.col(sequence_col).isNotNull())
        done = fixed if done is None else done.unionByName(fixed)
        if last:
            break
        left = out.filter(F.col(sequence_col).isNull()).drop(sequence_col, offset_col)
    return done


def assembled(packed: DataFrame, ids_col: str = "ids", length_col: str = "length") -> DataFrame:
    """(sequence_id, ids, lengths) of packed pieces that carry their ids: a sequence's ids, and how many each piece has, in order."""
    held = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", F.col(length_col).alias("n"), F.col(ids_col).alias("ids")))).alias("all"))
    joined = F.aggregate("all", F.lit(b"").cast("binary"), lambda out, x: F.concat(out, x["ids"]))
    return held.select("sequence_id", joined.alias("ids"), F.transform("all", lambda x: x["n"]).alias("lengths"))
