"""Quality rules with n-gram perplexity: a modified Kneser-Ney model counted in Spark, bands by language.

The model is over the bytes of texts, each word with one blank before it, case and marks as they are: its n-grams have ORDER
bytes, so one is its own 40-bit hash.  What follows a sentence's end, a small word's end or a capital is seen across the
blank, so that words in the wrong order or case cost.  A text's n-grams come from the text alone, wherever it stands.
Every n-gram of every text is counted, whatever the size of the corpus, and the model grows with it.  Counts, continuation
counts, contexts and interpolated probabilities are grouped and joined in Spark, an order at a time, and written as sorted
hash arrays.  As texts are scored by a model that has counted them too, an n-gram that no other text holds is scored by the
shorter ones behind it (leave one out).  The model is cut into shards by ranges of the hash; each shard of at most about
SHARD_GRAMS n-grams is broadcast in turn, and texts add up what they find in it by binary search.  A larger model takes more
passes over the texts and shuffles nothing but a row for each text and pass.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, saved
from .words import BASE, INVERSE, Block, blocks, mix, powers, window_starts, windows

ORDER = 5
#: About so many n-grams, 20 bytes each, are broadcast at a time.
SHARD_GRAMS = 2_000_000
#: A task that has found so many n-grams passes them on and begins anew.
TASK_GRAMS = 4_000_000
MIN_WORDS = 10
REPEAT_PERCENT = 20
#: A band reaches so many times as far from the median as the quartiles do (3.4 standard deviations of a normal spread) ...
REACH = 5.0
#: ... and at least so large a share of the median, where a crowd of near copies leaves hardly any spread.
LEAST_REACH = 0.05
#: A text of so many characters scatters twice as much (in variance) as a very long one.
SHORT = 200

# Symbols of the quality rule.
RULE_SYMBOLS = b"#*$%&|<>"


def symbol_grams(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of ORDER bytes, their texts): a text is its words with one blank before each, whatever stands between or around them."""
    if not len(block.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = block.end - block.start + 1
    stop = np.cumsum(size)
    symbols = np.full(stop[-1], 32, np.int64)
    inside = np.ones(stop[-1], bool)
    inside[stop - size] = False
    solid = np.zeros(len(block.data) + 1, np.int8)
    np.add.at(solid, block.start, 1)
    np.add.at(solid, block.end, -1)
    symbols[inside] = block.data[np.cumsum(solid[:-1]).astype(bool)]
    doc = np.repeat(block.word_doc, size)
    n = len(symbols) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = np.zeros(n, np.int64)
    for k in range(ORDER):
        grams = (grams << 8) | symbols[k : k + n]
    whole = doc[:n] == doc[ORDER - 1 :]
    return grams[whole], doc[:n][whole]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gram, owner = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return gram, np.bincount(owner, weights=np.concatenate([n for _, n in parts]), minlength=len(gram)).astype(np.int64)


def _gram_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flushed(gram: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(gram), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(gram[k : k + 100_000]), pa.array(n[k : k + 100_000])], names=["gram", "n"])

    parts, held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for batch in batches:
        for block in blocks(batch.column(0)):
            parts.append(np.unique(symbol_grams(block)[0], return_counts=True))
            held += len(parts[-1][0])
            if held > TASK_GRAMS:
                parts = [_merged(parts)]
                held = len(parts[0][0])
                if held > TASK_GRAMS // 2:
                    yield from flushed(*parts[0])
                    parts, held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    yield from flushed(*_merged(parts))


def discounts(n1: float, n2: float, n3: float, n4: float) -> list[float]:
    """Modified Kneser-Ney's D for counts 1, 2 and 3 or more, from the numbers of n-grams with counts 1 to 4."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(x, 0.05), k * 0.95) for k, x in enumerate(d, 1)]


def _interpolated(level: DataFrame, lower: DataFrame | None, order: int) -> DataFrame:
    """(gram, c, p, q) of the n-grams (gram, c) of one order; lower: those of the order below.

    p: the probability of the last byte after the others; q: the same as if the n-gram had not been seen, and below the
    highest order only where it was seen once.
    """
    few = {r["c"]: r["n"] for r in level.filter("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows
    d = discounts(*(float(few.get(k, 0)) for k in (1, 2, 3, 4)))
    off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
    rows = level.select("gram", "c", off.alias("off"), F.shiftright("gram", 8).alias("context"))
    contexts = rows.groupBy(F.col("context").alias("of")).agg(F.sum("c").alias("total"), F.sum("off").alias("left"))
    rows = rows.join(contexts, F.col("context") == F.col("of"))
    if lower is None:
        rows = rows.withColumns({"below": F.lit(1.0 / 256), "unseen": F.lit(1.0 / 256)})
    else:
        shorter = F.col("gram").bitwiseAND(F.lit((1 << (8 * (order - 1))) - 1).cast("long"))
        lower = lower.select(F.col("gram").alias("g"), F.col("p").alias("below"), F.col("q").alias("unseen"))
        rows = rows.withColumn("tail", shorter).join(lower, F.col("tail") == F.col("g"))
    share = F.col("left") / F.col("total")
    p = (F.col("c") - F.col("off")) / F.col("total") + share * F.col("below")
    q = F.when(F.col("total") > F.col("c"), share).otherwise(1.0) * F.col("unseen")
    return rows.select("gram", "c", p.alias("p"), (q if order == ORDER else F.when(F.col("c") > 1, p).otherwise(q)).alias("q"))


def train(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, c, log_p, log_q), written in the order of gram: each n-gram of the texts with its count and the natural logs of
    its last byte's probability, as it is and as if the n-gram had not been seen."""
    counts = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_gram_counter, "gram long, n long")
    levels = [saved(counts.groupBy("gram").agg(F.sum("n").alias("c")), "grams-5")]
    for order in range(ORDER - 1, 0, -1):  # a shorter n-gram counts the bytes it is found after
        tail = F.col("gram").bitwiseAND(F.lit((1 << (8 * order)) - 1).cast("long"))
        levels.append(saved(levels[-1].groupBy(tail.alias("gram")).agg(F.count(F.lit(1)).alias("c")), f"grams-{order}"))
    lower = None
    for order, level in enumerate(reversed(levels), 1):
        lower = saved(_interpolated(level, lower, order), f"probabilities-{order}")
    logs = [F.log(x).cast("float").alias(f"log_{x}") for x in ("p", "q")]
    count = F.least("c", F.lit((1 << 31) - 1)).cast("int").alias("c")
    return saved(lower.select("gram", count, *logs).repartitionByRange("gram").sortWithinPartitions("gram"), "model")


def rule_counts(block: Block) -> dict[str, np.ndarray]:
    """Word characters, symbols, repeated lines and words under repeated windows of five, for each text."""
    data, n = block.data, block.n
    text_start = block.text_start[:-1]
    per_text = lambda flags: np.add.reduceat(flags.astype(np.int64), text_start) if n else np.zeros(0, np.int64)
    solid = (data != 32) & ((data < 9) | (data > 13))
    out = {"n_words": np.diff(block.doc_word), "word_chars": per_text(solid & ((data & 0xC0) != 0x80)), "n_symbols": per_text(np.isin(data, np.frombuffer(RULE_SYMBOLS, np.uint8)))}

    is_end = data == 10
    is_end[block.text_start[1:] - 1] = True
    end = np.flatnonzero(is_end)
    start = np.append(0, end[:-1] + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * powers(BASE, len(data)), out=total[1:])
        line = mix((total[end] - total[start]) * powers(INVERSE, len(data) + 1)[start], 61)
    words_up_to = np.concatenate([[0], np.cumsum(solid)])
    real = words_up_to[end] > words_up_to[start]
    doc, line = (np.searchsorted(block.text_start, start, "right") - 1)[real], line[real]
    order = np.lexsort((line, doc))
    again = np.zeros(len(doc), bool)
    again[1:] = (doc[order][1:] == doc[order][:-1]) & (line[order][1:] == line[order][:-1])
    out["n_dup_lines"] = np.bincount(doc[order][again], minlength=n)

    words = block.hashes()
    grams = windows(words, 5)
    covered = np.zeros(len(words), bool)
    if len(grams):
        starts = np.flatnonzero(window_starts(block.doc_word, 5))
        doc, gram = block.word_doc[starts], grams[starts]
        order = np.lexsort((gram, doc))
        same = (doc[order][1:] == doc[order][:-1]) & (gram[order][1:] == gram[order][:-1])
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        marks = np.zeros(len(words) + 6, np.int32)
        np.add.at(marks, starts[order[twice]], 1)
        np.add.at(marks, starts[order[twice]] + 5, -1)
        covered = np.cumsum(marks)[: len(words)] > 0
    out["n_repeat_words"] = np.bincount(block.word_doc[covered], minlength=n)
    return out


RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _own(gram: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of each text: (n-grams, their texts, how often each text holds them)."""
    bits = 8 * ORDER  # and 63 - bits for the text's place in its block
    both, own = np.unique(doc << bits | gram, return_counts=True)
    return both & ((1 << bits) - 1), both >> bits, own


def _scorer(shared, low: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, n, nats) from (key, text): how many n-grams of each text the shard has, and their summed nats."""
        grams, count, log_p, log_q = shared.value
        for batch in batches:
            for block in blocks(batch.column(1)):
                gram, doc = symbol_grams(block)
                gram, doc, own = _own(gram, doc)
                here = (gram >= low) & (gram <= grams[-1])
                gram, doc, own = gram[here], doc[here], own[here]
                at = np.searchsorted(grams, gram)
                value = np.where(count[at] > own, log_p[at], log_q[at]).astype(np.float64)
                n = np.bincount(doc, weights=own, minlength=block.n).astype(np.int64)
                nats = np.bincount(doc, weights=-value * own, minlength=block.n).astype(np.float64)  # whole numbers for none
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n), pa.array(n), pa.array(nats)], names=["key", "n", "nats"])

    return score


def _ruler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, lang, key, rules) from (id, lang, key, text)."""
    for batch in batches:
        for block in blocks(batch.column(3)):
            rules, part = rule_counts(block), batch.slice(block.first, block.n)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), *(pa.array(rules[x].astype(np.int64)) for x in RULES)], names=["id", "lang", "key", *RULES])


def scores(texts: DataFrame, model: DataFrame, most: int = SHARD_GRAMS) -> DataFrame:
    """(id, lang, rules, nats) of texts (id, lang, text): nats is the mean over a text's n-grams, null without one.

    most: about so many n-grams of the model, which is written in the order of gram, are broadcast at a time.
    """
    id_type, kinds = texts.schema["id"].dataType.simpleString(), ", ".join(f"{x} long" for x in RULES)
    context = texts.sparkSession.sparkContext
    keyed = texts.withColumn("key", row_key("id", "lang", "text"))
    rules = keyed.select("id", "lang", "key", "text").mapInArrow(_ruler, f"id {id_type}, lang string, key long, {kinds}")
    passes = max(1, math.ceil(model.count() / most))
    cuts = model.agg(F.percentile_approx("gram", [k / passes for k in range(1, passes)], 20 * passes).alias("at")).first()["at"] if passes > 1 else []
    parts = None
    for low, high in itertools.pairwise([0, *(c + 1 for c in cuts or []), 1 << (8 * ORDER)]):
        shard = model.filter((F.col("gram") >= low) & (F.col("gram") < high)).toArrow().sort_by("gram")
        if not len(shard):
            continue
        shared = context.broadcast(tuple(shard.column(x).to_numpy() for x in ("gram", "c", "log_p", "log_q")))
        found = saved(keyed.select("key", "text").mapInArrow(_scorer(shared, low), "key long, n long, nats double"), "shard-scores")
        shared.destroy()
        parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        return rules.withColumn("nats", F.lit(None).cast("double")).drop("key")
    # repeated rows have one key and add the same several times, which leaves the mean as it is
    sums = parts.groupBy(F.col("key").alias("k")).agg(F.try_divide(F.sum("nats"), F.sum("n").cast("double")).alias("nats"))
    return rules.join(sums, F.col("key") == F.col("k"), "left").select("id", "lang", *RULES, "nats")


def quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = MIN_WORDS, repeat_percent: int = REPEAT_PERCENT, reach: float = REACH,
    most: int = SHARD_GRAMS,
) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, perplexity, base_failed, kept) for each row.

    base_failed: fewer than min_words words, or more than repeat_percent of them in repeated 5-word windows.
    kept: not base_failed and the perplexity (of a byte) inside the language's band.  A band is drawn in nats over
    the language's texts that pass the base rules, texts of one score counted once: median - reach * (median - lower
    quartile) up to median + reach * (upper quartile - median), LEAST_REACH of the median on each side at least.
    Under a quarter of junk moves no quartile out of the clean texts.  A band is wider by sqrt(1 + SHORT / characters)
    for a text, as the mean over few symbols scatters more.  A null language is a language.  A null or empty text has no
    words and fails; its perplexity, and that of a text too short for an n-gram, is null, and no band rejects it.
    Repeated rows are texts of their own, and count in the model as often.  Very long texts count whole, ties don't
    arise, an empty table gives an empty result, and other columns are ignored, whatever their names.
    most: about how many n-grams are broadcast at a time (see scores).
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    scored = saved(scores(texts, train(texts), most), "perplexity")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    at = scored.filter("NOT base_failed AND nats IS NOT NULL").select(F.col("lang").alias("of"), "nats").distinct()
    at = at.groupBy("of").agg(F.percentile_approx("nats", [0.25, 0.5, 0.75], 10000).alias("at"))
    low, middle, high = (F.col("at")[k] for k in range(3))
    side = lambda far: F.greatest(reach * far, LEAST_REACH * middle)
    bands = at.select("of", middle.alias("middle"), side(middle - low).alias("below"), side(high - middle).alias("above"))
    rows = scored.join(bands, F.col("lang").eqNullSafe(F.col("of")), "left")
    wider = F.sqrt(1 + F.lit(SHORT) / F.greatest(F.col("word_chars") + F.col("n_words"), F.lit(1)))
    off = F.col("nats") - F.col("middle")
    inside = F.coalesce(off.between(-F.col("below") * wider, F.col("above") * wider), F.lit(True))
    return rows.select(F.col("id").alias(id_col), *RULES, F.exp("nats").alias("perplexity"), "base_failed", (~F.col("base_failed") & inside).alias("kept"))
