"""The ten operators on small fixtures: against plain Python, and on nulls, empty texts, ties and odd columns."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from duneveil.llm import chat, decontaminate, line_dedup, mixing, near_dedup, perplexity, secrets, substrings, token_counts, toxicity
from duneveil.llm.words import blocks, window_starts, windows

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def docs(spark, texts, **more):
    rows = [(k, t, more.get("lang", "en"), f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    return frame(spark, rows)


def invented(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


EDGES = [None, "", "   \t\n", "one", "two words", "Ünï çödé 日本 😀", "x" * 5000, "same text here", "same text here"]


# ------------------------------------------------------------------ words


def test_blocks_hold_the_words_of_any_text():
    texts = [*EDGES, "a\x0bb\x0cc\rd\te\nf", "no\xa0break is one"]
    for most in (1, 40, 1 << 20):
        got, hashes = [], {}
        for block in blocks(pa.array(texts), most):
            found = block.hashes()
            for k in range(block.n):
                part = slice(block.doc_word[k], block.doc_word[k + 1])
                got.append([bytes(block.data[a:b]).decode() for a, b in zip(block.start[part], block.end[part], strict=True)])
                for w, h in zip(got[-1], found[part], strict=True):
                    assert hashes.setdefault(w, h) == h
        assert got == [brute.words(t) for t in texts]
        assert len(set(hashes.values())) == len(hashes)


@pytest.mark.parametrize("size", [1, 4, 16, 17, 35])
def test_equal_windows_have_equal_hashes(size):
    rng = random.Random(size)
    base = invented(rng, 60, 10**9)
    (block,) = blocks(pa.array([" ".join(base), "pre " + " ".join(base)]))
    w = windows(block.hashes(), size)
    ok = window_starts(block.doc_word, size)
    n = 60 - size + 1
    assert (w[:n] == w[61 : 61 + n]).all() and len(set(w[:n])) == n
    assert ok.sum() == n + n + 1


# ------------------------------------------------------------------ 1


def test_leaks_survive_substitutions_and_clean_texts_stay(spark):
    rng = random.Random(1)
    items = [" ".join(invented(rng, n, 10**6)) for n in (30, 50, 16, 12)] + ["too short", None, ""]
    filler = lambda n=200: invented(rng, n, 10**6)
    planted = items[0].split()
    for k in (7, 15, 23):
        planted[k] = "other"
    texts = [
        " ".join([*filler(), *items[0].split(), *filler()]), " ".join([*filler(), *planted, *filler()]), " ".join(filler()), items[3].upper(), items[0][:25],
        " ".join(items[1].split()[10:35]), None, "", "too short",
    ]
    bench = frame(spark, [(k, t, "extra") for k, t in enumerate(items)], "item_id long, text string, source string")
    got = decontaminate.overlaps(docs(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 0), (1, 0), (3, 3), (5, 1)}
    by = {r.doc_id: r for r in got}
    assert (by[0].first_word, by[0].end_word, by[0].n_equal) == (200, 230, 30)
    assert by[1].n_equal == 27


def test_lightly_substituted_items_leak_as_brute_force_says(spark):
    rng = random.Random(16)
    items = [invented(rng, 15 + k % 16, 10**6) for k in range(120)]
    items[0] = items[0][:15]
    texts, want = [], set()
    for k, item in enumerate(items):
        gone = {8, 9, 11} if k == 0 else set(rng.sample(range(len(item)), len(item) // 5))
        laid = [f"x{rng.randrange(10**6)}" if n in gone else w for n, w in enumerate(item)]
        texts.append(" ".join([*invented(rng, rng.randrange(100), 10**9), *laid, *invented(rng, rng.randrange(100), 10**9)]))
        hit = any(all(n + m not in gone for m, mark in enumerate(mask) if mark == "#") for mask in decontaminate.MASKS for n in range(len(item) - len(mask) + 1))
        if hit and len(item) - len(gone) >= decontaminate.MIN_ITEM_SHARE * len(item):
            want.add((k, k, len(item) - len(gone)))
    bench = frame(spark, [(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_equal) for r in decontaminate.overlaps(docs(spark, texts), bench).collect()}
    assert got == want and (0, 0, 12) in want and len(want) > 110


def test_leaks_of_empty_tables(spark):
    bench = frame(spark, [], "item_id long, text string")
    assert decontaminate.overlaps(docs(spark, EDGES), bench).count() == 0
    assert decontaminate.overlaps(frame(spark, []), frame(spark, [(1, "a b c d e f g h")], "item_id long, text string")).count() == 0


# ------------------------------------------------------------------ 2


@pytest.fixture(scope="module")
def bpe():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


PIECES = ["'", "'s", "'re", "'ll", "'v", " ", "  ", "\n", "\t", "a", "b1", "12", "é", "日本", "#", "!!", "don't", "I'LL", "<|endoftext|>", "　", "\xa0", "😀", "the", " The", "x" * 40, "\x85", "՘"]


def test_token_counts_are_the_librarys(spark, bpe):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = [*EDGES, "word " * 3000, *("".join(rng.choices(PIECES, k=rng.randrange(30))) for _ in range(400))]
    rows = {r.doc_id: r for r in token_counts.count_tokens(docs(spark, texts), bpe).collect()}
    want = [len(e.ids) for e in Tokenizer.from_file(bpe).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [rows[k].n_tokens for k in range(len(texts))] == want
    assert [rows[k].n_bytes for k in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows.values())


def test_chunks_compose_to_the_same_splits():
    rng = np.random.default_rng(3)
    classes = rng.integers(0, token_counts.N_CLASSES, 5000).astype(np.uint8)
    whole = token_counts.split_starts(classes, 5000)
    for chunk in (1, 7, 64, 512):
        assert (token_counts.split_starts(classes, chunk) == whole).all()


def test_token_counts_of_an_empty_table(spark, bpe):
    assert token_counts.count_tokens(frame(spark, []), bpe).count() == 0


# ------------------------------------------------------------------ 3


def test_mix_meets_targets_and_reruns_agree(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.randrange(0, 60)), "en", rng.choice(["a", "b", "c", "d", None]), 0) for k in range(3000)]
    table = frame(spark, rows)
    got = mixing.mix(table).collect()
    assert len(got) == 3000 and sorted(got) == sorted(mixing.mix(table.repartition(7)).collect())
    total = sum(r.size for r in got)
    assert abs(sum({r.source: r.target for r in got}.values()) - total) < 1e-6 * total
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert sum(r.size for r in mine) == mine[0].source_size
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 60
        assert mine[0].target <= 3 * mine[0].source_size + 1e-9
    assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in got)


def test_mix_reshares_what_is_above_the_ceiling(spark):
    # a has weight 5 but only 10 words: its target stops at 30, the rest goes to b and c by 2 to 1
    rows = [(1, "w " * 10, "", "a", 0), (2, "w " * 100, "", "b", 0), (3, "w " * 100, "", "c", 0), (4, None, "", None, 0)]
    target = {r.source: r.target for r in mixing.mix(frame(spark, rows)).collect()}
    assert target == {"a": 30.0, "b": 120.0, "c": 60.0, None: 0.0}


def test_mix_of_nothing(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(frame(spark, [(None, None, None, None, None), (None, "", None, None, None)])).collect()] == [0, 0]


# ------------------------------------------------------------------ 4


def test_site_lines_go_and_content_stays(spark):
    rows = [(k, f"Menu\nline {k}\n\n  Menu \nfoot", "en", "site", 0) for k in range(20)] + [(99, "Menu\nfoot", "en", "other", 0), (100, None, "en", "site", 0)]
    out = line_dedup.drop_site_lines(frame(spark, rows), "doc_id", F.col("source"), line_dedup.text_lines(F.col("text")), ratio=0.5)
    got = {r.doc_id: r for r in out.collect()}
    assert got[3].kept_text == "line 3\n" and (got[3].n_lines, got[3].n_dropped) == (4, 3)
    assert got[99].kept_text == "Menu\nfoot" and got[99].n_dropped == 0
    assert got[100].kept_text is None and got[100].n_lines == 0


def test_copies_are_not_frame(spark):
    rows = [(k, "all\nlines\nare\nshared", "en", "s", 0) for k in range(9)]
    table = frame(spark, rows)
    lines = line_dedup.text_lines(F.col("text"))
    assert {r.n_dropped for r in line_dedup.drop_site_lines(table, "doc_id", F.col("source"), lines, max_loss=0.5).collect()} == {0}
    assert {r.n_dropped for r in line_dedup.drop_site_lines(table, "doc_id", F.col("source"), lines).collect()} == {4}


def test_site_lines_of_odd_tables(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "no url", ""), (3, "HTTP://A.b/x", "<p>x<br>y</p>")], "page_id long, url string, html string")
    out = line_dedup.drop_site_lines(pages, "page_id", line_dedup.host_of(F.col("url")), line_dedup.html_lines(F.col("html"))).collect()
    got = {r.page_id: (r.site, r.n_lines, r.kept_text) for r in out}
    assert got == {1: ("", 0, None), 2: ("", 0, ""), 3: ("a.b", 2, "x\ny")}


# ------------------------------------------------------------------ 5


def test_secrets_are_told_from_lookalikes(spark):
    texts = [
        'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "write to reports.archive@mail3.example.com", "card 4785380592391139",
        "plain words only", None, "", "first\nAPI_KEY=8fK2mQ9xZr4TnW7vB3cL6pYhJ5sD1gAe\nlast",
    ]
    got = secrets.scan(docs(spark, texts)).collect()
    assert {r.doc_id: r.is_secret for r in got} == {0: True, 1: False, 2: False, 3: False, 7: True}
    assert {r.line_no for r in got if r.doc_id == 7} == {1}


def test_short_and_broken_secrets_are_candidates(spark):
    secret = ['password = "Tr0ub4dor3"', "db_password=hu!nt#er2$x", "postgres://ann:s3cr3tpw@db.example.com/x", "token=abQwZkLmRtyXabQw", 'passphrase = "correct horse battery staple"']
    texts = [*secret, "a=1, token: '8fK2mQ9x!Zr4', password: 'Qw7#rT2p'", "password: chapter of the report"]
    got = secrets.scan(docs(spark, texts)).collect()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    values = ["Tr0ub4dor3", "hu!nt#er2$x", "s3cr3tpw", "abQwZkLmRtyXabQw", "correct horse battery staple"]
    assert {(r.doc_id, r.digest) for r in got if r.is_secret} == {*((k, digest(v)) for k, v in enumerate(values)), (5, digest("8fK2mQ9x!Zr4")), (5, digest("Qw7#rT2p"))}


def test_neighbours_are_the_lines(spark):
    lines = spark.createDataFrame([("secret 24be64439e3e49cf46b2 and 8fK2mQ9xZr4TnW7vB3cL",), ("x" * 400 + "1" + "abcdefgh" * 40,)], "line string")
    got = {r.candidate: r.left for r in secrets.candidates(lines, F.col("line")).collect()}
    assert got["8fK2mQ9xZr4TnW7vB3cL"] == "secret 24be64439e3e49cf46b2 and "


def test_a_line_of_very_many_candidates_takes_time_in_proportion(spark):
    value = lambda k: hashlib.sha256(str(k).encode()).hexdigest()[:24]
    line = lambda n: spark.createDataFrame([(" ".join(value(k) for k in range(n)),)], "line string")
    found = secrets.candidates(line(300), F.col("line")).orderBy("place").collect()
    whole = " ".join(value(k) for k in range(300))
    assert [r.candidate for r in found] == [value(k) for k in range(300)] and all(whole.split(r.candidate)[0].endswith(r.left[-24:]) for r in found)
    took = []
    for n in (4000, 4000, 16_000):
        began = time.monotonic()
        assert secrets.candidates(line(n), F.col("line")).agg(F.count_if(F.length("left") > 0)).first()[0] == n - 1
        took.append(time.monotonic() - began)
    assert took[2] < 10 * max(took[1], 0.3)


def test_forest_on_held_out_labelled_findings(spark):
    every = secrets.labelled_findings(spark, 3000).withColumn("doc_id", F.monotonically_increasing_id()).cache()
    test = every.filter(F.hash("line") % 4 == 0)
    got = secrets.scan(test.withColumnRenamed("line", "text"), every.filter(F.hash("line") % 4 != 0).select("line", "path", "label"), path_col="path")
    rows = got.join(test.select("doc_id", "label"), "doc_id").collect()
    assert len(rows) > 300
    assert sum(r.is_secret == bool(r.label) for r in rows) / len(rows) > 0.95


def test_secrets_of_an_empty_table(spark):
    assert secrets.scan(frame(spark, [])).count() == 0


# ------------------------------------------------------------------ 6


def edited(rng, base, n):
    w = list(base)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return w


def test_near_groups_equal_brute_force(spark):
    rng = random.Random(6)
    texts = list(EDGES)
    for _ in range(12):
        base = invented(rng, rng.randrange(5, 200))
        texts += [" ".join(base), " ".join(base).upper()] + [" ".join(edited(rng, base, rng.randrange(0, 1 + len(base) // 12))) for _ in range(6)]
    rows = list(enumerate(texts))
    for size in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(docs(spark, texts), shingle=size).collect()}
        assert got == brute.near_groups(rows, size, 80)


def test_a_crowd_of_near_copies_equals_brute_force(spark):
    rng = random.Random(7)
    base = invented(rng, 120)
    texts = [" ".join(edited(rng, base, rng.choice([0, 1, 2, 3, 4, 6, 8]))) for _ in range(260)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(docs(spark, texts), shingle=4).collect()}
    assert got == brute.near_groups(list(enumerate(texts)), 4, 80)


def test_pairs_of_a_bucket_grow_no_faster_than_its_rows(spark, monkeypatch):
    """Half-alike texts fill buckets of ten and more: these meet by first shingles, and small buckets give each pair once."""
    rng = random.Random(12)
    common = invented(rng, 200, 10**6)
    texts = [" ".join([*common, *invented(rng, 42, 10**6)]) for _ in range(30)]
    seen, pairs_of = [], near_dedup._open_pairs

    def watched(rows, percent):
        seen.append((max((r["n"] for r in rows.groupBy("key").agg(F.count("id").alias("n")).collect()), default=0), pairs_of(rows, percent)))
        return seen[-1][1]

    monkeypatch.setattr(near_dedup, "_open_pairs", watched)
    groups = near_dedup.near_groups(docs(spark, texts)).collect()
    assert len(groups) == 30 and all(r["kept"] for r in groups)
    assert seen[0][0] <= 8
    row = "id long, component long, main long, key long, n long, shared long"
    three = frame(spark, [(1, 1, 1, 7, 9, 9), (2, 2, 1, 7, 9, 9), (3, 3, 1, 7, 9, 9)], row)
    assert sorted(map(tuple, pairs_of(three, 80).collect())) == [(1, 2), (1, 3), (2, 3)]


def test_near_groups_of_odd_rows(spark):
    rows = [(5, "a b c d e f", "", "", 0), (5, "g h i j k l", "", "", 0), (2, "g h i j k l", "", "", 0), (None, "a b c d e f", "", "", 0), (7, None, "", "", 0)]
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in near_dedup.near_groups(frame(spark, rows)).collect())
    assert got == [("2", 2, True), ("5", 2, False), ("5", 2, False), ("7", 7, True), ("None", None, True)]
    assert near_dedup.near_groups(frame(spark, [])).count() == 0


def test_linked_sets_share_a_first_shingle_in_any_order():
    rng = np.random.default_rng(17)
    counted, noise = np.ones(1 << near_dedup.SLOT_BITS, np.int64), rng.integers(2, 9, 1 << near_dedup.SLOT_BITS)
    for k in range(400):
        common, a, b = rng.integers(1, 200), rng.integers(0, 30), rng.integers(0, 30)
        value = rng.integers(0, 2**63, common + a + b).astype(np.uint64) * np.uint64(2)
        sets = [np.sort(value[: common + a]), np.sort(np.append(value[:common], value[common + a :]))]
        held = noise if k % 2 else counted + np.bincount(near_dedup._slot(np.concatenate(sets)), minlength=len(counted))
        owner, key, rank = near_dedup.first_shingles(np.concatenate(sets), np.array([0, common + a, 2 * common + a + b]), held, 80)
        shared = [{x: len(sets[s]) - r for o, x, r in zip(owner, key, rank) if o == s} for s in (0, 1)]
        met = any(180 * min(shared[0][x], shared[1][x]) >= 80 * sum(map(len, sets)) for x in shared[0].keys() & shared[1].keys())
        assert met or 100 * common < 80 * (common + a + b)


def test_families_of_one_crowd_that_touch_equal_brute_force(spark):
    rng = random.Random(27)
    base = invented(rng, 90)
    texts = []
    for _ in range(12):  # copies of copies: links that don't pass the base
        parent = edited(rng, base, 5)
        texts += [" ".join(edited(rng, parent, rng.randrange(0, 4))) for _ in range(14)]
    rng.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(docs(spark, texts), shingle=4).collect()}
    assert got == brute.near_groups(list(enumerate(texts)), 4, 80)


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(8)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = a.copy()
    b[:100] = rng.integers(0, 2**63, 100).astype(np.uint64)  # similarity 900 / 1100
    sketch = near_dedup.odd_sketches(near_dedup.minhashes(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 1000, 2000])))
    bits = sum(int(x).bit_count() for x in (sketch[0] ^ sketch[1]).view(np.uint64))
    assert near_dedup.most_differing_bits(90) < bits < near_dedup.most_differing_bits(74)


# ------------------------------------------------------------------ 7


def test_each_participant_is_the_assistant_once(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "<|end|> hey"), (1, 300, "ann", None), (2, 0, "system", "alone"), (None, None, None, None)]
    out = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("block", F.lit(9))).collect()
    got = {(r.conv_id, r.perspective, r.block): r for r in out}
    assert set(got) == {(1, "ann", 0), (1, "ann", 1), (1, "bob", 0), (1, "bob", 1), (None, "unknown", None)}
    ann = got[1, "ann", 0]
    assert ann.rendered == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user bob|>\n< |end|> hey<|end|>\n"
    a, b = map(int, ann.mask.split("-"))
    assert ann.rendered[a:b] == "hi<|end|>"
    assert got[1, "bob", 1].mask == "" and got[1, "bob", 1].rendered == "<|user ann|>\n<|end|>\n"


def test_names_stay_apart_and_blocks_tell_where_they_start(spark):
    rows = [(1, k, x, f"{k} words") for k, x in enumerate(["a|b", "a<b", "a%7Cb", "a\nb", "a_b"] * 3)] + [(1, None, "a|b", "last"), (1, 3, "a<b", "3 words"), (1, 3, "a<b", "3 words")]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "'x' AS start", "1 AS size", "2 AS piece", "3 AS of")
    out = chat.rotate(table, block_turns=4).collect()
    for who in {r.perspective for r in out}:
        blocks_ = sorted((r for r in out if r.perspective == who), key=lambda r: (r.block is None, r.block))
        whole = "".join(r.rendered for r in blocks_)
        learned = [whole[r.start + int(a) : r.start + int(b)] for r in blocks_ if r.mask for a, b in (x.split("-") for x in r.mask.split(","))]
        assert sorted(learned) == sorted(f"{t}<|end|>" for _, _, s, t in rows if s == who)
        assert whole.count("<|assistant|>") == len(learned) and len(set(re.findall(r"<\|user (.*?)\|>", whole))) == 4
        assert sum(r.n_turns for r in blocks_) == len(rows)


def test_rotation_of_an_empty_table(spark):
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


# ------------------------------------------------------------------ 8


def test_quality_counts_equal_plain_python(spark):
    rng = random.Random(9)
    texts = [*EDGES, "a b\nc d\na b\n\n\na b", "# $ % | <>", *("\n".join(" ".join(invented(rng, 7, 30)) for _ in range(rng.randrange(1, 9))) for _ in range(60))]
    got = {r.doc_id: r for r in perplexity.quality(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        r, want = got[k], brute.rules(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_a_text_has_one_score_wherever_it_stands(spark):
    rng = random.Random(17)
    base = ["  The cat sat.\n\nIt ran \t home to eat. ", "The cat sat. It ran home to eat.", "", "\n\n", " x", *(" ".join(invented(rng, 30)) for _ in range(40))]
    seen = {}
    for turn in range(3):
        texts = base[:]
        rng.shuffle(texts)
        table = docs(spark, texts).repartition((1, 8, 3)[turn])
        for r in perplexity.quality(table, most=(10**9, 40, 7)[turn]).collect():
            assert seen.setdefault(texts[r.doc_id].strip(), r.perplexity or 0.0) == pytest.approx(r.perplexity or 0.0, rel=1e-6)
    assert seen[base[0].strip()] == seen[base[1]]


def test_words_out_of_order_and_swapped_cases_fall_out(spark):
    rng = random.Random(18)
    syllables = "ba co di fe gu la me no pi ra se tu vo".split()
    words = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(200)]
    sentence = lambda: " ".join(rng.choices(words, k=rng.randrange(5, 12))).capitalize() + "."
    plain = [" ".join(sentence() for _ in range(12)) for _ in range(400)]
    mixed = [x.split() for x in plain[:40]]
    for x in mixed:
        rng.shuffle(x)
    got = {r.doc_id: r for r in perplexity.quality(docs(spark, [*plain, *(" ".join(x) for x in mixed), *(x.swapcase() for x in plain[40:43])])).collect()}
    assert sum(got[k].kept for k in range(400)) >= 392
    assert sum(got[k].kept for k in range(400, 440)) <= 8 and sum(got[k].kept for k in range(440, 443)) == 0


def test_gibberish_falls_out_of_the_band(spark):
    rng = random.Random(10)
    plain = [" ".join(rng.choices("the cat sat on a mat and then it ran to her house near old trees".split(), k=80)) for _ in range(200)]
    noise = "".join(rng.choices("qzxjvkwpyq", k=400))
    texts = [*plain, " ".join(noise[k : k + 7] for k in range(0, 400, 7))]
    got = {r.doc_id: r for r in perplexity.quality(docs(spark, texts), repeat_percent=100).collect()}
    assert not got[200].kept and got[200].perplexity > 2 * got[0].perplexity
    assert sum(got[k].kept for k in range(200)) == 200


def test_junk_in_a_tenth_of_a_language_does_not_widen_its_band(spark):
    rng = random.Random(15)
    syllables = "ba co di fe gu la me no pi ra se tu vo".split()
    words = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(300)]
    plain = [" ".join(rng.choices(words, k=100)) for _ in range(270)]
    junk = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9))) for _ in range(100)) for _ in range(30)]
    got = {r.doc_id: r.kept for r in perplexity.quality(docs(spark, plain + junk)).collect()}
    assert not any(got[k] for k in range(270, 300))
    assert sum(got[k] for k in range(270)) >= 267


def test_perplexities_equal_brute_force_in_one_shard_and_in_many(spark):
    rng = random.Random(11)
    texts = [*EDGES, "abcd", "Ab  cd\te", *(" ".join(rng.choices("the Cat sat on a mat near Ünï 日本 banana bandana".split(), k=rng.randrange(1, 60))) for _ in range(80))]
    table = docs(spark, [*texts, texts[-1]])
    want, sums = brute.kneser_ney([*texts, texts[-1]])
    assert all(abs(x - 1) < 1e-9 for x in sums)
    for most in (10**9, 100, 9):
        got = {r.doc_id: r.perplexity for r in perplexity.quality(table, most=most).collect()}
        for k, nats in enumerate(want):
            assert (got[k] is None) == (nats is None) and (nats is None or abs(np.log(got[k]) - nats) < 1e-5)


def test_quality_of_an_empty_table(spark):
    assert perplexity.quality(frame(spark, [])).count() == 0


# ------------------------------------------------------------------ 9


def test_repeated_windows_equal_brute_force(spark):
    rng = random.Random(12)
    passage, other = invented(rng, 50), invented(rng, 36)
    texts = [*EDGES, "a " * 80, *(" ".join([*invented(rng, rng.randrange(40)), *rng.choice([passage, other, passage[3:44], []]), *invented(rng, rng.randrange(40))]) for _ in range(60))]
    texts += texts[-3:]
    for size, anchor in ((35, 8), (5, 3), (8, 8)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.repeated_windows(docs(spark, texts), size=size, anchor=anchor).collect()}
        assert [got[k] for k in range(len(texts))] == brute.repeated_windows(list(enumerate(texts)), size)


def test_removed_intervals_are_maximal(spark):
    rng = random.Random(13)
    passage = invented(rng, 40, 10**6)
    texts = [" ".join(["x", *passage, "y"]), " ".join(["p", "q", *passage])]
    got = {r.doc_id: [tuple(x) for x in r.removed] for r in substrings.repeated_windows(docs(spark, texts)).collect()}
    assert got == {0: [(1, 41)], 1: [(2, 42)]}


def test_repeated_windows_of_odd_rows(spark):
    long = " ".join(f"v{k}" for k in range(40))
    rows = [(None, long, "", "", 0), (None, long, "", "", 0), (3, "short", "", "", 0)]
    got = sorted((r.n_words, r.n_removed) for r in substrings.repeated_windows(frame(spark, rows)).collect())
    assert got == [(1, 0), (40, 40), (40, 40)]
    assert substrings.repeated_windows(frame(spark, [])).count() == 0


def test_one_id_with_several_texts_equals_brute_force(spark):
    rng = random.Random(31)
    passage = invented(rng, 45, 10**6)
    shared = [" ".join([*invented(rng, 20, 10**6), *passage[:30], *invented(rng, 20, 10**6)]) for _ in range(2)]
    whole = [" ".join([*invented(rng, 9, 10**6), *passage, *invented(rng, 9, 10**6)]) for _ in range(3)]
    rows = [(1, shared[0]), (1, shared[1]), (None, whole[0]), (None, whole[1]), (None, whole[1]), (2, whole[2]), (2, None), (2, ""), (None, None), (3, "w " * 2000)]
    table = frame(spark, [(i, t, "en", "s", 0, "x", 1) for i, t in rows], SCHEMA + ", key string, copies int")
    got = sorted((r.doc_id is None, r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.repeated_windows(table).collect())
    want = sorted((i is None, i, *x) for (i, _), x in zip(rows, brute.repeated_windows(rows, 35), strict=True))
    assert got == want and (False, 1, 70, 0) in [x[:4] for x in got]


# ------------------------------------------------------------------ 10


def toxic_corpus(n=1200, seed=14):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        w, bad = invented(rng, rng.randrange(8, 60)), rng.random() < 0.3
        for _ in range(2 * bad):
            w[rng.randrange(len(w))] = rng.choice(["grimwort", "sludgeling", "snarkfen", "mudgrub"])
        rows.append((k, " ".join(w), "en", "s", 0))
        labels.append((k, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_labels(spark):
    rows, labels = toxic_corpus()
    rows += [(5000, None, "en", "s", 0), (5001, "", "en", "s", 0), (None, "x", None, None, None)]
    got = {r.doc_id: r for r in toxicity.toxicity(frame(spark, rows).withColumn("score", F.lit("clash")), frame(spark, labels, "doc_id long, toxic int")).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_toxicity_does_not_see_held_out_labels(spark):
    rows, labels = toxic_corpus(400)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    one, other = (sorted((r.doc_id, r.score) for r in toxicity.toxicity(frame(spark, rows), frame(spark, x, "doc_id long, toxic int")).collect()) for x in (labels, flipped))
    assert one == other


def test_toxicity_without_labels(spark):
    none = frame(spark, [], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(docs(spark, EDGES), none).collect()} == {0.0}
    one = frame(spark, [(k, 1) for k in range(9)] + [(3, None)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity(docs(spark, EDGES), one).collect()} == {1}
    assert toxicity.toxicity(frame(spark, []), one).count() == 0
