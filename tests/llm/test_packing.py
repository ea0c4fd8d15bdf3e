"""Best-fit packing: pieces against the tokenizer library, sequences against their capacities."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from duneveil.llm import packing, queries

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_words_have_the_librarys_ids(library):
    rng, encode = random.Random(1), packing.WordIds(PATH)
    signs = [*"abcZÀé1 ٣۴'’.,:;!?-_<|>… \n\t ́̈각가日😀İẞ\x1c\x85 \x00", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'re", "...", "é"]
    for _ in range(300):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(5)]
        ids, at = encode(pa.array(texts, pa.large_utf8()))
        assert [list(ids[a:b]) for a, b in zip(at, at[1:], strict=False)] == [library.encode(x, add_special_tokens=False).ids for x in texts]


def test_what_a_worker_remembers_is_bounded(library, monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 20)
    encode = packing.WordIds(PATH)
    for k in range(30):
        text = " ".join(f"w{x}" for x in range(k, k + 15))
        assert list(encode(pa.array([text], pa.large_utf8()))[0]) == library.encode(text, add_special_tokens=False).ids
        assert len(encode.known) + len(encode.old) <= 60


def test_long_texts_are_tokenized_in_parts(spark, library, monkeypatch):
    text = "  The quick\nbrown fox, jumps! " * 60 + "x" * 900 + " end "
    for most in (1, 50, 400):
        monkeypatch.setattr(packing, "PART_BYTES", most)
        batch = pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.array([text, None])], names=["id", "text"])
        rows = pa.Table.from_batches(packing._piecer(PATH, 100, 1)(iter([batch]))).to_pylist()
        ids = [int(x) for r in rows if r["id"] == 7 for x in np.frombuffer(r["ids"], "<u4")]
        assert ids == [*library.encode(text, add_special_tokens=False).ids, 1]
        assert [(r["piece"], r["start"]) for r in rows if r["id"] == 7] == [(k, 100 * k) for k in range(-(-len(ids) // 100))]
        assert [(r["length"], r["ids"]) for r in rows if r["id"] == 8] == [(1, b"\x01\0\0\0")]


def laid_out(rows, capacity):
    """Sequences hold gapless pieces up to their capacity."""
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return held


def test_query_equals_the_library_and_packs_tightly(spark, sf_dir, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op12_vector_best_fit(spark, sf_dir).collect()
    want = set()
    for doc_id, text in docs.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for k, start in enumerate(range(0, len(ids), 4096)):
            cut = ids[start : start + 4096]
            want.add((doc_id, k, start, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    assert len(rows) == len(want) and {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    held = laid_out(rows, 4096)
    assert len(held) <= -(-sum(r["length"] for r in rows) // 4096) + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(spark, rule):
    rng = random.Random(3)
    lengths = [rng.choice([1, 2, 5, 60, 100]) if rng.random() < 0.7 else rng.randrange(1, 101) for _ in range(3000)]
    items = spark.createDataFrame([(k, n, "x") for k, n in enumerate(lengths)], "id long, length long, offset_note string")
    rows = packing.pack(items, capacity=100, max_items=4, max_attention=10_500, rule=rule, group=400).collect()
    held = laid_out(rows, 100)
    assert sorted(r["id"] for r in rows) == list(range(3000)) and {r["offset_note"] for r in rows} == {"x"}
    assert all(len(x) <= 4 and sum(n * n for _, n in x) <= 10_500 for x in held.values())
    with pytest.raises(Exception, match="larger than a sequence"):
        packing.pack(items, capacity=50).collect()


def test_groups_lose_few_sequences(spark):
    rng = random.Random(4)
    lengths = [min(4096, max(1, int(rng.lognormvariate(6, 1.2)))) for _ in range(6000)]
    items = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "id long, length long")
    held = laid_out(packing.pack(items, group=500).collect(), 4096)
    assert len(held) <= sum(lengths) / 4096 * 1.005 + 1


def test_pack_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (5, ""), (5, None), (6, "tie"), (7, "tie")], "doc_id long, text string").withColumns({"ids": F.lit(1), "length": F.lit("clash")})
    found = packing.pieces(docs, PATH)
    rows = packing.pack(found).collect()
    assert [r["doc_id"] for r in rows].count(None) == 2 and len(rows) == 6
    assert len(laid_out(rows, 4096)) == 1
    (whole,) = packing.assembled(packing.pack(found)).collect()
    assert len(whole["ids"]) == 4 * sum(r["length"] for r in rows) and sorted(whole["lengths"]) == sorted(r["length"] for r in rows)
    assert packing.pack(packing.pieces(docs.limit(0), PATH)).collect() == []
