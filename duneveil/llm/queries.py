"""The thin queries over the test tables: each applies its operator with production parameters to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, line_dedup, mixing, near_dedup, packing, perplexity, repair, search, secrets, substrings, token_counts, toxicity
from .common import saved, table


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = line_dedup.drop_site_lines(pages, "page_id", line_dedup.host_of(F.col("url")), line_dedup.html_lines(F.col("html")))
    return out.select("page_id", F.col("site").alias("host"), "n_lines", "n_dropped", "kept_text")


def op7_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.repeated_windows(table(spark, sf_dir, "documents"), size=35)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op1_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_transducer_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality(table(spark, sf_dir, "documents"))


def op10_gbt_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_forest_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op12_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    # no bound on documents or attention but what 4096 tokens allow: the fewest sequences are asked for
    return packing.pack(found.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    hurt = repair.damaged(turns)
    solved = saved(repair.audits(hurt), "audits")
    facts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    found = solved.join(repair.digests(hurt, solved).withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")))
    found = found.select(F.col("conv_id").alias("c"), *facts, "audit", "sha256")
    every = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    none = {**{x: F.lit(0).cast("long") for x in facts}, "audit": F.lit(""), "sha256": F.sha2(F.lit(""), 256)}
    out = every.select("conv_id", *(F.coalesce(F.col(x), v).alias(x) for x, v in none.items()))
    return out.withColumnRenamed("sha256", "repaired_sha256")


def op11_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
