"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Nothing but the text is scored.  A lexicon is learned from labelled texts: words, and stems of a few lengths,
with the numbers of toxic and other texts that hold them.  Features are the densities of lexicon words and stems,
the strongest of them, how often they stand near a second-person word, and the rates of capitals, punctuation and
obfuscation.  For a labelled text the lexicon's counts are taken without that text itself, so that the trees learn
from what the lexicon says about texts it has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .words import BASE, INVERSE, Block, blocks, mix, powers

#: At most about so many labelled rows are learned from (a documented bound; the rows are chosen by hash).
MAX_LABELS = 30_000
#: A lexicon entry stands in so many toxic texts at least, and a leaf of a tree holds so many texts.
MIN_TOXICS, MIN_LEAF = 3, 10
STEMS = (4, 5, 6)
TAILS = (5,)
SEED = 17

# Second-person words of the corpora's languages.
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "euch", "ihr", "sie", "tu", "te", "toi", "ton", "ta", "vous",
    "vos", "votre", "tú", "ti", "tus", "usted", "ustedes", "vosotros", "eres",
)
# What stands for a letter in disguised words.
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

FEATURES = (
    "length", "best_word", "best_stem", "word_hits", "stem_hits", "word_density", "stem_density", "word_sum", "stem_sum", "near_you", "you_rate",
    "capitals", "loud_words", "marks", "punctuation", "obfuscation",
)


def _fold() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    for a, b in DISGUISES.items():
        table[ord(a)] = ord(b)
    return table


FOLD = _fold()
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_WORD = _LETTER.copy()
_WORD[[*range(48, 58), ord("@"), ord("$")]] = True
_DISGUISE = np.zeros(256, bool)
_DISGUISE[[*map(ord, DISGUISES), ord("*"), ord("!"), ord("#")]] = True


class Units:
    """The words of a block as lexicon units: hashes by kind, with the word each belongs to."""

    def __init__(self, block: Block):
        data = block.data
        solid = np.zeros(len(data) + 2, bool)
        solid[1:-1] = _WORD[data]
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        self.start, self.end = edges[0::2], edges[1::2]
        self.doc = np.searchsorted(block.text_start, self.start, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(block.n + 1))
        with np.errstate(over="ignore"):
            self._total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((FOLD[data] + np.uint64(1)) * powers(BASE, len(data)), out=self._total[1:])
            self._inverse = powers(INVERSE, len(data) + 1)
        self.words = self._hash(self.start, self.end, 0)

    def _hash(self, start: np.ndarray, end: np.ndarray, kind: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self._total[end] - self._total[start]) * self._inverse[start], kind)

    def kinds(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(kind, hashes, their words): 0 whole words, then stems and tails of so many bytes."""
        every = np.arange(len(self.start))
        yield 0, self.words, every
        for kind, n in enumerate((*STEMS, *TAILS), 1):
            at = every[self.end - self.start >= n]
            start = self.start[at] if kind <= len(STEMS) else self.end[at] - n
            yield kind, self._hash(start, start + n, kind), at


def _you() -> np.ndarray:
    (block,) = blocks(pa.array([" ".join(SECOND_PERSON)]))
    return np.sort(Units(block).words)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


class Lexicon:
    """Unit hashes in order, with the numbers of labelled texts (other, toxic) that hold each."""

    def __init__(self, units: np.ndarray, others: np.ndarray, toxics: np.ndarray, n_other: int, n_toxic: int):
        order = np.argsort(units)
        self.units, self.others, self.toxics = units[order], others[order].astype(float), toxics[order].astype(float)
        self.n_other, self.n_toxic, self.you = n_other, n_toxic, _you()

    def weight(self, at: np.ndarray, own: np.ndarray | None) -> np.ndarray:
        """Smoothed log odds of the entries; own: the label of the text that asks, which is left out (-1: none)."""
        a, b = self.toxics[at], self.others[at]
        if own is not None:
            a, b = a - (own == 1), b - (own == 0)
        return np.log((a + 0.5) / (self.n_toxic + 1)) - np.log((b + 0.5) / (self.n_other + 1))

    def features(self, block: Block, labels: np.ndarray | None = None) -> np.ndarray:
        """A row of FEATURES for each text of a block."""
        n, units, data = block.n, Units(block), block.data
        count = np.diff(units.first).astype(float)
        words = np.maximum(count, 1)
        out = {"length": np.log1p(count)}
        hits = np.zeros(len(units.start), bool)
        best = {"word": np.zeros(len(units.start)), "stem": np.zeros(len(units.start))}
        for kind, hashes, at in units.kinds():
            found, place = _find(self.units, hashes)
            at, place = at[found], place[found]
            weight = self.weight(place, None if labels is None else labels[units.doc[at]])
            name = "stem" if kind else "word"
            np.maximum.at(best[name], at, weight)
        for name, weight in best.items():
            strong = weight > 1.5
            hits |= strong
            top = np.zeros(n)
            np.maximum.at(top, units.doc, weight)
            number = np.bincount(units.doc, weights=strong, minlength=n)
            total = np.bincount(units.doc, weights=weight * strong, minlength=n)
            out |= {f"best_{name}": top, f"{name}_hits": np.log1p(number), f"{name}_density": number / words, f"{name}_sum": total / np.sqrt(words)}
        you = _find(self.you, units.words)[0]
        up_to = np.concatenate([[0], np.cumsum(you)])
        k = np.arange(len(you))
        near = up_to[np.minimum(k + 6, units.first[units.doc + 1])] - up_to[np.maximum(k - 5, units.first[units.doc])]
        out |= {"near_you": np.log1p(np.bincount(units.doc, weights=hits & (near > 0), minlength=n)), "you_rate": np.bincount(units.doc, weights=you, minlength=n) / words}

        upper = (data >= 65) & (data <= 90)
        owner = np.repeat(np.arange(n), np.diff(block.text_start))
        rate = lambda flags, by: np.bincount(owner, weights=flags, minlength=n) / by
        letters = np.maximum(rate(_LETTER[data], 1), 1)
        uppers = np.concatenate([[0], np.cumsum(upper)])
        size = units.end - units.start
        loud = (size >= 3) & (uppers[units.end] - uppers[units.start] == size)
        marks = (data == 33) | (data == 63)
        solid = (data > 32) & (data < 127) & ~_LETTER[data] & ~((data >= 48) & (data <= 57))
        hidden = np.zeros(len(data), bool)
        hidden[1:-1] = _DISGUISE[data[1:-1]] & _LETTER[data[:-2]] & _LETTER[data[2:]]
        out |= {
            "capitals": rate(upper, letters), "loud_words": np.bincount(units.doc, weights=loud, minlength=n) / words, "marks": rate(marks, words),
            "punctuation": rate(solid, words), "obfuscation": rate(hidden, words),
        }
        return np.column_stack([out[x] for x in FEATURES])


def _unit_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, label): (unit, others, toxics), the texts of a block that hold a unit."""
    for batch in batches:
        label = np.asarray(batch.column(1))
        for block in blocks(batch.column(0)):
            units = Units(block)
            unit, doc = zip(*((h, units.doc[at]) for _, h, at in units.kinds()), strict=True)
            unit, doc = np.concatenate(unit), np.concatenate(doc)
            order = np.lexsort((doc, unit))
            unit, doc = unit[order], doc[order]
            new = np.append(True, (unit[1:] != unit[:-1]) | (doc[1:] != doc[:-1])) if len(unit) else np.zeros(0, bool)
            unit, toxic = unit[new], label[block.first + doc[new]] == 1
            unique, owner = np.unique(unit, return_inverse=True)
            toxics = np.bincount(owner, weights=toxic, minlength=len(unique)).astype(np.int64)
            every = np.bincount(owner, minlength=len(unique)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(every - toxics), pa.array(toxics)], names=["unit", "others", "toxics"])


def _featurer(shared, labelled: bool):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, [label,] features) from (id, text[, label])."""
        lexicon = shared.value
        for batch in batches:
            label = np.asarray(batch.column(2)) if labelled else None
            for block in blocks(batch.column(1)):
                part = slice(block.first, block.first + block.n)
                rows = lexicon.features(block, None if label is None else label[part])
                lists = pa.ListArray.from_arrays(np.arange(block.n + 1, dtype=np.int32) * len(FEATURES), pa.array(rows.ravel()))
                own = [pa.array(label[part].astype(float))] if labelled else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n), *own, lists], names=["id", *["label"] * labelled, "features"])

    return features


def remainder(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id: 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5, F.lit(0).cast("long"))


class Detector:
    """A lexicon, trees and a calibration; or, where labels show one class only, that class's share."""

    def __init__(self, share: float, lexicon=None, trees=None, calibration=None):
        self.share, self.lexicon, self.trees, self.calibration = share, lexicon, trees, calibration

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, score, predicted) for every row of docs; a null text is empty and gets a score like any other."""
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        if self.trees is None:
            return texts.select(F.col("id").alias(id_col), F.lit(self.share).alias("score"), F.lit(int(self.share >= 0.5)).alias("predicted"))
        rows = texts.mapInArrow(_featurer(self.lexicon, False), f"id {texts.schema['id'].dataType.simpleString()}, features array<double>")
        rows = self.calibration.transform(_raw(self.trees, rows))
        # the calibration has steps; inside a step the trees still put texts in order
        score = F.least(F.greatest(0.999 * F.col("calibrated") + 0.001 * F.col("raw"), F.lit(0.0)), F.lit(1.0))
        rows = rows.select(F.col("id").alias(id_col), score.alias("score"))
        return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _raw(trees, rows: DataFrame) -> DataFrame:
    rows = trees.transform(rows.withColumn("vector", array_to_vector("features")))
    return rows.withColumn("raw", vector_to_array("probability")[1]).drop("vector", "rawPrediction", "probability", "prediction")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_labels: int = MAX_LABELS) -> Detector:
    """A detector from those labels whose remainder() is not 0.

    Of more than max_labels labelled ids about so many are taken, by hash.  An id labelled twice is toxic if any
    row says so; null ids and labels are left out, as are labels of ids that docs lacks.
    """
    label = F.col(label_col)
    known = labels.filter(label.isNotNull() & F.col(id_col).isNotNull() & (remainder(F.col(id_col)) != 0)).groupBy(F.col(id_col).alias("of")).agg(F.max(label).cast("int").alias("label"))
    total = known.count()
    share = min(1.0, max_labels / total) if total else 1.0
    known = known.filter(F.pmod(F.xxhash64("of", F.lit(SEED)), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    learned = saved(texts.join(F.broadcast(known), F.col("id") == F.col("of")).select("id", "text", "label"), "labelled")
    n_other, n_toxic = learned.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first()
    if not n_other or not n_toxic:
        return Detector(1.0 if n_toxic else 0.0)

    counts = learned.select("text", "label").mapInArrow(_unit_counter, "unit long, others long, toxics long").groupBy("unit").agg(F.sum("others").alias("others"), F.sum("toxics").alias("toxics"))
    odds = (F.col("toxics") + 0.5) / (n_toxic + 1) / ((F.col("others") + 0.5) / (n_other + 1))
    top = counts.filter((F.col("toxics") >= MIN_TOXICS) & (odds > 2)).toArrow()  # of max_labels texts
    entries = [np.asarray(top.column(k)) for k in range(3)]
    spark = docs.sparkSession
    lexicon = spark.sparkContext.broadcast(Lexicon(entries[0].view(np.uint64), entries[1], entries[2], n_other, n_toxic))

    id_type = texts.schema["id"].dataType.simpleString()
    rows = saved(learned.mapInArrow(_featurer(lexicon, True), f"id {id_type}, label double, features array<double>"), "features")
    aside = F.pmod(F.xxhash64("id", F.lit(SEED + 1)), F.lit(4)) == 0
    fit = rows.filter(~aside).withColumn("vector", array_to_vector("features")).coalesce(4).cache()
    if fit.select("label").distinct().count() < 2:
        fit.unpersist()
        return Detector(n_toxic / (n_toxic + n_other))
    trees = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=20, maxDepth=3, stepSize=0.3, minInstancesPerNode=MIN_LEAF, seed=SEED).fit(fit)
    fit.unpersist()
    tested = _raw(trees, rows.filter(aside)).select("label", "raw")
    if tested.isEmpty():
        tested = _raw(trees, rows).select("label", "raw")
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(tested.coalesce(4))
    return Detector(n_toxic / (n_toxic + n_other), lexicon, trees, calibration)


def toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row of docs, by a detector trained on labels (see train).

    held_out: remainder(id) is 0; such labels are never learned from.  Repeated rows get equal scores.  Without
    labels of both classes the score is the share of toxic ones.  Other columns are ignored.
    """
    scored = train(docs, labels, label_col, id_col, text_col).score(docs, id_col, text_col)
    return scored.select(id_col, (remainder(F.col(id_col)) == 0).alias("held_out"), "score", "predicted")
