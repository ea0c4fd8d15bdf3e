"""Ranked lexical search by a bit-sliced impact index.

An impact is what one occurrence of a term in a query adds to a document's score, an integer.  Documents stand in blocks; a
block's index holds, for each term, the documents that have it and their impacts bit by bit.  A search turns these into
bitmaps over the block, a word for 64 documents: an item's scores are the bitmaps of its terms, added by bitwise carry
arithmetic for all items at once, and the best documents are found from the most significant slice downwards, by counting
which candidates have the bit.  Nothing is approximated: every document is indexed and every score is whole.

Blocks are independent tasks.  Items come in rounds of a bounded size of text, which the driver reads and broadcasts; a round
is a pass over the documents.  What leaves a task is k rows for each item.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .words import parts

#: Documents in a block at most.
BLOCK = 2048
#: Characters of text that are split at a time, and characters of items in a round.
PART, ROUND = 2 << 20, 4 << 20
#: Items whose scores are added at once.
ITEMS = 128
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _fold_table() -> np.ndarray:
    """A-Z folded, ASCII letters and digits and all other bytes above kept, the rest blank."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[[x for x in range(128) if not chr(x).isalnum()]] = 32
    return table


FOLD = _fold_table()


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(LOWER))


def split_terms(texts: pa.Array) -> pa.Array:
    """The terms of large_utf8 texts as lists; empty ones among them are none."""
    offsets, data = texts.buffers()[1], texts.buffers()[2]
    folded = FOLD[np.frombuffer(data, np.uint8)] if data is not None else np.zeros(0, np.uint8)
    return pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(folded), None, 0, texts.offset))


def _counter(shared, block: int):
    """Blocks of (id, text): document ids in order, their numbers of terms, and the counts of the asked terms."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(shared.value, pa.large_utf8())
        for batch in batches:
            for first in range(0, len(batch), block):
                some = batch.slice(first, block)
                rows, terms, counts, length = [], [], [], np.zeros(len(some), np.int64)
                for held in parts(some.column(1).to_pylist(), PART):
                    words = split_terms(pa.array([p for _, p, _ in held], pa.large_utf8()))
                    flat = words.flatten()
                    of = np.repeat(np.array([r for r, _, _ in held]), np.diff(np.asarray(words.offsets)))
                    length += np.bincount(of, weights=pc.binary_length(flat).to_numpy() > 0, minlength=len(some)).astype(np.int64)
                    found = pc.index_in(flat, value_set=asked).fill_null(-1).to_numpy()
                    pair, n = np.unique(of[found >= 0] * len(asked) + found[found >= 0], return_counts=True)
                    rows.append(pair // max(len(asked), 1))
                    terms.append(pair % max(len(asked), 1))
                    counts.append(n)
                order = pc.sort_indices(some.column(0), null_placement="at_end").to_numpy()
                slot = np.empty(len(some), np.int64)
                slot[order] = np.arange(len(some))
                # the parts of a long text add up
                pair, at = np.unique(np.concatenate(terms) * block + slot[np.concatenate(rows)], return_inverse=True)
                tf = np.bincount(at, weights=np.concatenate(counts), minlength=len(pair)).astype(np.int64)
                held_terms, df = np.unique(pair // block, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x]) for x in ((length > 0).sum(), length.sum())]
                    + [_list(some.column(0).take(pa.array(order))), *(_list(pa.array(x)) for x in (length[order], pair // block, pair % block, tf, held_terms, df))],
                    names=["docs", "all_terms", "ids", "lengths", "term", "slot", "tf", "held", "df"],
                )

    return counted


def _list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def postings(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """A row for each block of documents: (docs with a term, all_terms, ids, lengths, term, slot, tf, held, df), counts of the
    asked terms only; term is a place in terms, slot a place in ids, held and df the terms of the block and in how many of its documents."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    kind, longs = rows.schema["id"].dataType.simpleString(), ", ".join(f"{x} array<long>" for x in ("lengths", "term", "slot", "tf", "held", "df"))
    return rows.mapInArrow(_counter(shared, block), f"docs long, all_terms long, ids array<{kind}>, {longs}")


def _slicer(shared):
    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs, n_terms, weights = shared.value
        for batch in batches:
            for k in range(len(batch)):
                length, term, slot, tf = (batch.column(x)[k].values.to_numpy() for x in ("lengths", "term", "slot", "tf"))
                m = 100 - 75 + (75 * length * n_docs) // max(n_terms, 1)
                impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[slot]))
                term, slot, impact = term[impact > 0], slot[impact > 0], impact[impact > 0]
                bits = int(impact.max()).bit_length() if len(impact) else 0
                slices = np.packbits((impact >> np.arange(bits)[:, None] & 1).astype(np.uint8), axis=1)
                held, start = np.unique(term, return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids").slice(k, 1), pa.array([bits], pa.int32()), _list(pa.array(held)), _list(pa.array(np.append(start, len(term)))), pa.array([slot.astype("<u2").tobytes()]), pa.array([slices.tobytes()])],
                    names=["ids", "bits", "terms", "starts", "slots", "slices"],
                )

    return sliced


def index(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The bit-sliced impact index of all documents for these terms: a row for each block, (ids, bits, terms, starts, slots, slices).

    terms: places in terms, in order; starts: where each term's documents begin in slots, 16-bit places in ids, and where the
    last one's end; slices: for each of bits bits, lowest first, a bit for every entry of slots.
    """
    counts = saved(postings(docs, terms, id_col, text_col, block), "postings")
    n_docs, n_terms = (int(x or 0) for x in counts.agg(F.sum("docs"), F.sum("all_terms")).first())
    df = counts.select(F.explode(F.arrays_zip("held", "df")).alias("x")).groupBy("x.held").agg(F.sum("x.df").alias("df"))
    weights = np.zeros(len(terms) + 1, np.int64)
    for term, n in df.collect():  # a row for each asked term at most
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
    shared = docs.sparkSession.sparkContext.broadcast((n_docs, n_terms, weights))
    kind = counts.schema["ids"].dataType.simpleString()
    return counts.mapInArrow(_slicer(shared), f"ids {kind}, bits int, terms array<long>, starts array<long>, slots binary, slices binary")


def bitmaps(terms: np.ndarray, starts: np.ndarray, slots: np.ndarray, slices: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of a term in terms, word, bits of the word for each slice): the words of the terms' bitmaps that are not empty."""
    owner = np.repeat(np.arange(len(terms)), np.diff(starts))
    word = owner * width + (slots >> 6)
    head = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
    one = np.uint64(1) << (slots & 63).astype(np.uint64)
    held = np.empty((len(head), len(slices)), np.uint64)
    for b, bit in enumerate(slices):
        held[:, b] = np.add.reduceat(np.where(bit, one, np.uint64(0)), head) if len(head) else 0
    return owner[head], word[head] % width, held


def scores(dense: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Bitmaps (slice, item, word) of the items' scores; wanted: (item, step) places of terms in dense (term, slice, word)."""
    n, steps = wanted.shape
    bits = dense.shape[1]
    total = np.zeros((bits + max(steps, 1).bit_length(), n, dense.shape[2]), np.uint64)
    for step in range(steps):
        added = dense[wanted[:, step]]
        carry = np.zeros_like(total[0])
        for s in range(len(total)):
            a = total[s]
            if s < bits:
                b = added[:, s]
                half = a ^ b
                total[s], carry = half ^ carry, (a & b) | (half & carry)
            elif carry.any():
                total[s], carry = a ^ carry, a & carry
            else:
                break
    return total


def best(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, slot, score) of each item's k best slots with a score, those of equal scores by slot."""
    n, width = total.shape[1:]
    candidates = np.bitwise_or.reduce(total, axis=0) if len(total) else np.zeros((n, width), np.uint64)
    sure, need = np.zeros_like(candidates), np.full(n, k)
    for s in range(len(total) - 1, -1, -1):
        have = candidates & total[s]
        count = np.bitwise_count(have).sum(1)
        enough = count >= need
        sure |= np.where(enough[:, None], np.uint64(0), have)
        candidates = np.where(enough[:, None], have, candidates & ~total[s])
        need = np.where(enough, need, need - count)
    spread = lambda x: np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").astype(bool)
    tied = spread(candidates)
    chosen = spread(sure) | (tied & (np.cumsum(tied, axis=1) <= need[:, None]))
    item, slot = np.nonzero(chosen)
    bit = total[:, item, slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)
    return item, slot, (bit.astype(np.int64) << np.arange(len(total))[:, None]).sum(0)


def _searcher(shared, k: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, n_terms = shared.value  # for each item an array of its terms' places, repeats included
        kept: list[list[tuple]] = [[] for _ in items]
        kind = None
        for batch in batches:
            kind = batch.column("ids").type.value_type
            for x in range(len(batch)):
                if not batch.column("bits")[x].as_py():  # no document of the block has an asked term
                    continue
                terms, starts = (batch.column(c)[x].values.to_numpy() for c in ("terms", "starts"))
                slots = np.frombuffer(batch.column("slots")[x].as_py(), "<u2").astype(np.int64)
                bits, ids = batch.column("bits")[x].as_py(), batch.column("ids")[x].values
                packed = np.frombuffer(batch.column("slices")[x].as_py(), np.uint8).reshape(bits, -1)
                slices = np.unpackbits(packed, axis=1, count=len(slots)).astype(bool)
                width = -(-len(ids) // 64)
                owner, word, held = bitmaps(terms, starts, slots, slices, width)
                place = np.full(n_terms, -1)
                place[terms] = np.arange(len(terms))
                for first in range(0, len(items), ITEMS):
                    asked = [place[item] for item in items[first : first + ITEMS]]
                    asked = [a[a >= 0] for a in asked]
                    needed, at = np.unique(np.concatenate(asked), return_inverse=True)
                    local = np.full(len(terms), -1)
                    local[needed] = np.arange(len(needed))
                    dense = np.zeros((len(needed) + 1, bits, width), np.uint64)  # the last term is none
                    mine = local[owner] >= 0
                    dense[local[owner[mine]], :, word[mine]] = held[mine]
                    wanted = np.full((len(asked), max(map(len, asked))), len(needed))
                    stop = 0
                    for row, a in enumerate(asked):
                        wanted[row, : len(a)] = at[stop : stop + len(a)]
                        stop += len(a)
                    item, slot, score = best(scores(dense, wanted), k)
                    names = ids.take(pa.array(slot)).to_pylist()
                    for i, name, value in zip(item.tolist(), names, score.tolist(), strict=True):
                        kept[first + i].append((-value, name is None, name))
                kept = [heapq.nsmallest(k, x) if len(x) > k else x for x in kept]
        rows = [(i, name, -value) for i, x in enumerate(kept) for value, _, name in x]
        if rows:
            item, name, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(name, kind), pa.array(score, pa.int64())], names=["item", "doc", "score"])

    return found


def ranked(indexed: DataFrame, items: list[list[int]], n_terms: int, k: int) -> DataFrame:
    """(item, rank, doc, score) for items given as places of terms, item being the place in items."""
    shared = indexed.sparkSession.sparkContext.broadcast(([np.array(x, np.int64) for x in items], n_terms))
    kind = indexed.schema["ids"].dataType.elementType.simpleString()
    rows = indexed.mapInArrow(_searcher(shared, k), f"item int, doc {kind}, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last()))
    return rows.withColumn("rank", place).filter(F.col("rank") <= k)


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most: int = ROUND, block: int = BLOCK,
) -> DataFrame:
    """(item, rank, doc, score): each item's k best documents of all, equal scores by ascending id, null ids last.

    Terms are runs of letters and digits (and of all characters that are not ASCII), A-Z folded.  A term's weight is
    floor(1000 ln((2N + 2) / (2 df + 1))), N counting the documents with a term; a document's score sums, over an item's terms
    with repeats, weight * (10^9 tf div (1000 tf + 8 m)), m = 25 + 75 n N div L.  Documents of score 0 are not found.
    Null and empty texts have no terms, count nowhere and find nothing.  Repeated documents are found each, repeated items
    answered each; very long texts count whole; without documents or items there are no rows; other columns are ignored,
    whatever their names.  most: characters of items in a round; block: documents in a block, 65,536 at most.
    """
    spark = docs.sparkSession
    item_type, kind = (df.schema[c].dataType.simpleString() for df, c in ((items, item_col), (docs, id_col)))
    answers = []

    def answered(names: list, texts: list[str]) -> None:
        split = [terms_of(t) for t in texts]
        vocabulary = sorted({t for x in split for t in x})
        place = {t: n for n, t in enumerate(vocabulary)}
        found = ranked(index(docs, vocabulary, id_col, text_col, block), [[place[t] for t in x] for x in split], len(vocabulary), k)
        told = spark.createDataFrame(list(enumerate(names)), f"at int, name {item_type}")
        answers.append(found.join(F.broadcast(told), F.col("item") == F.col("at")).select(F.col("name").alias(item_col), "rank", F.col("doc").alias(id_col), "score"))

    names, texts, size = [], [], 0
    for name, text in items.select(item_col, F.col(item_text_col).cast("string")).toLocalIterator():  # a round at a time
        names.append(name)
        texts.append(text or "")
        size += len(text or "")
        if size >= most:
            answered(names, texts)
            names, texts, size = [], [], 0
    if names:
        answered(names, texts)
    out = spark.createDataFrame([], f"{item_col} {item_type}, rank int, {id_col} {kind}, score long")
    for found in answers:
        out = out.unionByName(saved(found, "answers") if len(answers) > 1 else found)
    return out
