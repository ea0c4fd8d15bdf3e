"""A corpus pipeline over documents: toxicity, line dedup, near-dedup, decontamination, mixing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duneveil.llm import decontaminate, line_dedup, mixing, near_dedup, toxicity
from duneveil.llm.common import private, row_key, saved, scratch, shared_dir, table

#: A source is no web host: a line of so many words is its frame if more than this share of its documents, and so many of them, hold it.
LINE_RATIO, MIN_LINE_WORDS, MIN_LINE_DOCS = 0.01, 2, 5


def keyed(docs: DataFrame) -> DataFrame:
    """(key, text): rows told apart by a hash of id and text, for ids may be null or repeated."""
    return docs.select(row_key("doc_id", "text").alias("key"), "text")


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs without the rows whose key is in the one column of keys; the keys are written first, so that a join knows their size."""
    (gone,) = private("gone")
    return docs.join(saved(keys.distinct().toDF(gone), "gone"), row_key("doc_id", "text") == F.col(gone), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the detector, trained on the labels of documents at hand, doesn't call toxic.

    Rows are judged by their own texts, whatever their ids.  A null or empty text is scored like any other.  Without
    labels nothing is toxic.  Repeated rows share their fate; an empty table stays empty.
    """
    found = toxicity.train(docs, table(spark, sf_dir, "labels")).score(keyed(docs), "key")
    return without(docs, found.filter("predicted = 1").select("key"))


def drop_frame_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that frame their source's documents; each stays, whole if it has no other lines.

    A null source is a source; null and empty texts stay as they are.  Repeated rows count once.  No row goes.
    """
    results = private("n_dropped", "kept_text")
    (original,) = private("docs")
    lines = line_dedup.text_lines(F.col("text"))
    whole = docs.select("doc_id", "text", "source", F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias(original))
    out = line_dedup.drop_site_lines(whole, "doc_id", F.col("source"), lines, ratio=LINE_RATIO, min_pages=MIN_LINE_DOCS, min_words=MIN_LINE_WORDS, copies_once=True)
    out = out.withColumnsRenamed({"n_dropped": results[0], "kept_text": results[1]})
    changed = F.col(results[0]) > 0
    new = {"text": F.when(changed, F.col(results[1])), "n_chars": F.when(changed, F.length(results[1]).cast(docs.schema["n_chars"].dataType))}
    return out.select(*(F.coalesce(new[x], F.col(f"{original}.{x}")).alias(x) if x in new else F.col(f"{original}.`{x}`").alias(x) for x in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id; of rows with one id and text one.

    Rows are told apart by id and text, so texts that share an id are compared like others; null ids as well, and
    they come last.  Texts without words are no copies and stay.
    """
    groups = saved(near_dedup.near_groups(keyed(docs), "key"), "near-groups")
    several = saved(groups.filter("NOT kept").select("component_id").distinct(), "groups-of-copies")
    members = groups.join(several, "component_id", "left_semi").select("component_id", "key")
    ranks = docs.select(row_key("doc_id", "text").alias("key"), F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")).alias("rank"))
    members = members.join(ranks, "key").select("component_id", F.struct("rank", "key").alias("row")).distinct()
    first = members.groupBy(F.col("component_id").alias("of")).agg(F.min("row")["key"].alias("first"))
    gone = members.join(first, F.col("component_id") == F.col("of")).filter(F.col("row.key") != F.col("first")).select("row.key")
    gone = saved(gone, "copies")
    left = without(docs, gone)
    again = saved(groups.filter("n_shingles > 0").groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("key"), "repeated-rows")
    if again.isEmpty():
        return left
    key, other, row = private("key", "other", "row")
    repeated = docs.withColumn(key, row_key("doc_id", "text")).join(again.toDF(other), F.col(key) == F.col(other), "left_semi")
    repeated = repeated.join(gone.toDF(other), F.col(key) == F.col(other), "left_anti")
    whole = F.struct(*(F.col(f"`{x}`") for x in docs.columns))  # as text columns of any type have an order
    one = repeated.groupBy(key).agg(F.min_by(whole, F.to_json(whole)).alias(row))
    return without(left, again).unionByName(one.select(*(F.col(f"{row}.`{x}`").alias(x) for x in docs.columns)))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; rows are judged by their own texts, null and empty ones stay."""
    return without(docs, decontaminate.overlaps(keyed(docs), table(spark, sf_dir, "benchmark"), "key").select("key"))


def take_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with the copies and words it takes of each, and their source's size and target.

    See mixing.mixed; documents without words are not taken.
    """
    return mixing.mixed(docs).filter("copies > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_frame_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", take_mix),
]

#: Trained trees and exact similarities over all documents are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            path = f"{shared_dir(spark)}/duneveil/stage-{name}-{uuid.uuid4().hex}"
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
