"""Token counts by finite-state tokenizer compilation, for byte-level BPE vocabularies.

Two deterministic transducers are compiled from a tokenizer's file:

* the splitter reads classes of code points and marks on its transitions where pretokens start.  It has a dozen
  states, so what a chunk of text does to it is a map from entry states to exit states.  The maps of all chunks
  are taken side by side, composed by a parallel prefix scan, and give each chunk its entry state;
* the merger reads a pretoken's bytes.  Each transition carries the number of tokens by which the count of the
  prefix read so far changes.  Its state is what can still matter: the longest suffix that some token continues,
  with the last token and the count at each place in it.  States are made when first entered.

Between two places of a suffix the last token is decided by compatibility: a token may follow another if the two
together are encoded as just these two, and exactly one token that ends at a place fits what ends where it starts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import INVERSE, mix, powers

LIMIT = 512
CHUNK = 512
BLOCK_CHARS = 1 << 21
CACHE = 1_000_000

# ---------------------------------------------------------------- the splitter

#: Classes of code points.
LETTER, NUMBER, OTHER, BLANK, SPACE, QUOTE, S_T_M_D, R, V, L, E, STOP = range(12)
N_CLASSES = 12


def _split_rule(state: str, kind: int) -> tuple[str, int]:
    """(next state, marks) of one transition; mark 1: a pretoken starts here, mark 2: one starts a character ago.

    States: begin; in a run of letters, number, other; apostrophe that began a pretoken, and that with r, v or l;
    blank1/space1: a white-space character that began a pretoken; blank2/space2: a later one of a run.
    The last white-space character before another belongs to what follows if it is a space.
    """
    letters = (LETTER, S_T_M_D, R, V, L, E)
    if kind == STOP:
        return "begin", 2 * (state in ("quote_r", "quote_v", "quote_l"))
    late = 0
    if state == "quote":
        if kind == S_T_M_D:
            return "begin", 0
        if kind in (R, V, L):
            return {R: "quote_r", V: "quote_v", L: "quote_l"}[kind], 0
        state = "other"
    elif state in ("quote_r", "quote_v", "quote_l"):
        if kind == (L if state == "quote_l" else E):
            return "begin", 0
        state, late = "letter", 2
    if kind in (BLANK, SPACE):
        name = "space" if kind == SPACE else "blank"
        if state in ("blank1", "space1", "blank2", "space2"):
            return name + "2", 0
        return name + "1", late + 1
    run = "letter" if kind in letters else "number" if kind == NUMBER else "other"
    if state == run:
        return run, late
    if state == "space1":
        return run, 0
    if state == "space2":
        return run, 2
    late += 2 * (state == "blank2")
    return ("quote" if kind == QUOTE else run), late + 1


STATES = ("begin", "letter", "number", "other", "quote", "quote_r", "quote_v", "quote_l", "blank1", "space1", "blank2", "space2")
_rules = [[_split_rule(s, k) for k in range(N_CLASSES)] for s in STATES]
NEXT = np.array([[STATES.index(n) for n, _ in row] for row in _rules], np.intp).ravel()
MARKS = np.array([[m for _, m in row] for row in _rules], np.uint8).ravel()


def class_table(pre_tokenizer) -> np.ndarray:
    """The class of each code point, as the given pretokenizer draws the borders of letters, numbers and blanks."""
    table = np.full(0x110001, OTHER, np.uint8)
    for low in range(0, 0x110000, 0x8000):
        points = [c for c in range(low, low + 0x8000) if not 0xD800 <= c < 0xE000]
        if not points:
            continue
        joins = {}
        for probe in "a1#":
            starts = np.zeros(2 * len(points) + 1, bool)
            starts[[a for _, (a, _) in pre_tokenizer.pre_tokenize_str("".join(probe + chr(c) for c in points))]] = True
            joins[probe] = ~starts[1 : 2 * len(points) : 2]
        table[points] = np.where(joins["a"], LETTER, np.where(joins["1"], NUMBER, np.where(joins["#"], OTHER, BLANK)))
    for char, kind in {" ": SPACE, "'": QUOTE, "s": S_T_M_D, "t": S_T_M_D, "m": S_T_M_D, "d": S_T_M_D, "r": R, "v": V, "l": L, "e": E}.items():
        table[ord(char)] = kind
    table[0x110000] = STOP
    return table


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """maps[:, c] takes entry to exit states of chunk c; the result takes those of chunks 0..c, by doubling."""
    done, reach = maps, 1
    while reach < maps.shape[1]:
        done = np.concatenate([done[:, :reach], np.take_along_axis(done[:, reach:], done[:, :-reach], axis=0)], axis=1)
        reach *= 2
    return done


def split_starts(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Where pretokens start in a row of classes, read from the state `begin`."""
    n = len(classes)
    n_chunks = -(-n // chunk)
    padded = np.full(n_chunks * chunk, STOP, np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(n_chunks, chunk).T).astype(np.intp)
    maps = np.repeat(np.arange(len(STATES), dtype=np.intp)[:, None], n_chunks, axis=1)
    left, at = np.arange(n_chunks), 0
    while at < chunk and len(left):  # chunks whose entry states have not met yet
        part = maps[:, left]
        for k in range(at, min(at + 16, chunk)):
            part = NEXT[part * N_CLASSES + columns[k][left]]
        maps[:, left] = part
        at = min(at + 16, chunk)
        met = (part == part[0]).all(axis=0)
        ready = left[met]
        if at < chunk and len(ready):
            state = maps[0, ready]
            for k in range(at, chunk):
                state = NEXT[state * N_CLASSES + columns[k][ready]]
            maps[:, ready] = state
        left = left[~met]
    state = np.concatenate([[0], compose_scan(maps)[0, :-1]])
    marks = np.empty((chunk, n_chunks), np.uint8)
    for k in range(chunk):
        step = state * N_CLASSES + columns[k]
        marks[k] = MARKS[step]
        state = NEXT[step]
    flat = marks.T.ravel()[:n]
    starts = (flat & 1).astype(bool)
    starts[:-1] |= (flat[1:] & 2).astype(bool)
    return starts


# ---------------------------------------------------------------- the merger


def byte_symbols() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 as it is, others from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Merger:
    """The transducer over the bytes of one pretoken."""

    def __init__(self, vocab: list[bytes], merges: dict[tuple[bytes, bytes], int]):
        self.vocab, self.merges = frozenset(vocab), merges
        self.prefixes = frozenset(t[:k] for t in vocab for k in range(1, len(t)))
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.step: dict[int, tuple[int, int]] = {}
        self._state((b"", (None,), (0,)))

    def _state(self, key: tuple) -> int:
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
        return self.numbers[key]

    def _follows(self, left: bytes, right: bytes) -> bool:
        pair = left, right
        if pair not in self.fits:
            if len(self.fits) >= CACHE:
                self.fits.clear()
            self.fits[pair] = self.encode(left + right) == [left, right]
        return self.fits[pair]

    def encode(self, text: bytes) -> list[bytes]:
        """The merge rules, applied as they stand: the lowest rank first, leftmost first."""
        parts = [text[k : k + 1] for k in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.merges.get(pair, 1 << 60), k) for k, pair in enumerate(pairwise(parts)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _make(self, state: int, byte: int) -> tuple[int, int]:
        suffix, last, counts = self.states[state]
        suffix += bytes((byte,))
        n = len(suffix)
        for start in range(n):
            token = suffix[start:]
            if token in self.vocab and (last[start] is None or self._follows(last[start], token)):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        count = counts[start] + 1
        last, counts = (*last, token), (*counts, count)
        keep = next((k for k in range(n) if suffix[k:] in self.prefixes), n)
        made = self._state((suffix[keep:], last[keep:], tuple(c - count for c in counts[keep:]))), count
        self.step[state << 8 | byte] = made
        return made

    def count(self, pretoken: bytes) -> int:
        if len(self.step) > CACHE:
            self.clear()
        state, total, step = 0, 0, self.step
        for byte in pretoken:
            found = step.get(state << 8 | byte)
            state, change = found if found else self._make(state, byte)
            total += change
        return total


class Machine:
    """Both transducers of a tokenizer file; counts the tokens of many texts at once."""

    def __init__(self, spec: bytes, table: bytes):
        model = json.loads(spec)
        symbols = byte_symbols()
        special = {x["content"] for x in model["added_tokens"]}
        raw = lambda x: bytes(symbols[c] for c in x)
        vocab = [raw(x) for x in model["model"]["vocab"] if x not in special]
        pairs = (x.split(" ") if isinstance(x, str) else x for x in model["model"]["merges"])
        self.merger = Merger(vocab, {(raw(a), raw(b)): rank for rank, (a, b) in enumerate(pairs)})
        self.special = sorted(special, key=len, reverse=True)
        self.table = np.frombuffer(table, np.uint8)
        self.known: dict[int, int] = {}

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) < BLOCK_CHARS):
                size += len(texts[last]) + 1
                last += 1
            out[first:last] = self._block(texts[first:last])
            first = last
        return out

    def _block(self, texts: list[str]) -> np.ndarray:
        ends = np.cumsum([len(t) + 1 for t in texts])
        whole = " ".join(texts) + " "
        classes = self.table[points := np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
        classes[ends - 1] = STOP
        found = np.zeros(len(texts), np.int64)
        for token in self.special:
            at = whole.find(token)
            while at >= 0:
                text = int(np.searchsorted(ends, at, "right"))
                if at + len(token) < ends[text] and not (classes[at : at + len(token)] == STOP).any():
                    classes[at : at + len(token)] = STOP
                    found[text] += 1
                at = whole.find(token, at + len(token))
        starts = split_starts(classes)
        edges = np.flatnonzero(starts | (classes == STOP))
        begin, end = edges[:-1], edges[1:]
        real = classes[begin] != STOP
        begin, end = begin[real], end[real]
        if not len(begin):
            return found
        with np.errstate(over="ignore"):
            total = np.zeros(len(points) + 1, np.uint64)
            np.cumsum((points + np.uint64(1)) * powers(np.uint64(0x9E3779B97F4A7C15), len(points)), out=total[1:])
            keys = mix((total[end] - total[begin]) * powers(INVERSE, len(points) + 1)[begin])
        unique, example, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) > CACHE:
            self.known.clear()
        known, counts = self.known, np.empty(len(unique), np.int64)
        for k, (key, at) in enumerate(zip(unique.tolist(), example.tolist(), strict=True)):
            n = known.get(key)
            if n is None:
                n = known[key] = self.merger.count(whole[begin[at] : end[at]].encode("utf-8", "surrogatepass"))
            counts[k] = n
        owner = np.searchsorted(ends, begin, "right")
        return found + np.bincount(owner, weights=counts[inverse.ravel()], minlength=len(texts)).astype(np.int64)


_machines: dict[bytes, Machine] = {}


def _counter(spec, table):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hashlib.sha256(spec.value).digest()
        if key not in _machines:  # a worker that is used again keeps what it has compiled
            _machines.clear()
            _machines[key] = Machine(spec.value, table.value)
        machine = _machines[key]
        for batch in batches:
            texts = batch.column(1).fill_null("")
            sizes = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(machine.counts(texts.to_pylist()))], names=["id", "n_bytes", "n_tokens"])

    return count


@lru_cache(maxsize=4)
def compiled(tokenizer: str) -> tuple[bytes, bytes]:
    """The file and its class table: what the machines on the executors are built from."""
    from tokenizers import Tokenizer

    with open(tokenizer, "rb") as file:
        raw = file.read()
    spec = json.loads(raw)
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError("only byte-level BPE without a normalizer or an added space is compiled")
    return raw, class_table(Tokenizer.from_file(tokenizer).pre_tokenizer).tobytes()


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of docs.

    tokenizer: path of a byte-level BPE file (.json).  Counts are those of the file's own library, without begin,
    end or padding tokens; a special token's string inside a text is one token, as there by default.
    A null text is empty: 0 bytes, 0 tokens.  Null ids and repeated rows pass through.  Other columns are ignored.
    """
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(x) for x in compiled(tokenizer)]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = texts.mapInArrow(_counter(*shared), f"id {texts.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
