"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import (byte_bpe, collocations, html_text, languages, mixing, nearest, packing, periodic, quality, secret_scan,
                          text_dedup, vector_dedup, warc)
from linkloom.runtime import cut

QUALITY_THRESHOLD = 0.3


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_tree_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(_table(spark, sf, "pages").select("page_id", "url", "html"), html_text.trained())


def op2_mixture_languages(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    held_out = languages.held_out(4, 2)
    model = languages.learn(docs.filter(F.col("lang").isNotNull() & ~F.coalesce(held_out, F.lit(True))))
    return languages.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)


def op3_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_temperature_mix(spark: SparkSession, sf: str) -> DataFrame:
    counted = cut(mixing.count_tokens(_table(spark, sf, "documents")))
    fitted = mixing.fit(counted)
    return mixing.plan(counted, fitted).select("doc_id", "source", "copy", "n_tokens", "block", "position",
                                               F.round("weight", 9).alias("weight"))


def op5_sorted_projections(spark: SparkSession, sf: str) -> DataFrame:
    return vector_dedup.dedup(_table(spark, sf, "embeddings"))


def op6_subword_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs, held_out = _table(spark, sf, "documents"), languages.held_out(5, 0)
    labels = _table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    learned_from = docs.select("doc_id", "text").join(labels, "doc_id").filter(~F.coalesce(held_out, F.lit(True)))
    scored = quality.score(docs.select("doc_id", "text", held_out.alias("held_out")), quality.learn(learned_from))
    return scored.withColumn("predicted", (F.col("score") >= QUALITY_THRESHOLD).cast("int"))


def op7_seekable_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.read(warc.write(_table(spark, sf, "pages").select("page_id", "url", "html")))


def op8_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return secret_scan.scan(docs, secret_scan.learn_words(docs))


def op9_lsh_forest_join(spark: SparkSession, sf: str) -> DataFrame:
    found = text_dedup.join(_table(spark, sf, "documents"))
    return found.select("doc_id", "class_id", "n_links", "component_id", "kept")


def op10_kd_tree_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return nearest.top_k(nearest.prepared(_table(spark, sf, "embeddings")), F.col("vec_id") % 20 == 0)


def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.mine(_table(spark, sf, "documents").select("lang", "text"))


def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return periodic.digests(periodic.find_runs(periodic.planted(_table(spark, sf, "documents"))))


def op13_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return byte_bpe.digests(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                            public_tokenizers.PATTERN)


QUERIES = {
    "op1_tree_extraction": op1_tree_extraction,
    "op2_mixture_languages": op2_mixture_languages,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_temperature_mix": op4_temperature_mix,
    "op5_sorted_projections": op5_sorted_projections,
    "op6_subword_quality": op6_subword_quality,
    "op7_seekable_warc": op7_seekable_warc,
    "op8_secret_scan": op8_secret_scan,
    "op9_lsh_forest_join": op9_lsh_forest_join,
    "op10_kd_tree_top_k": op10_kd_tree_top_k,
    "op11_collocations": op11_collocations,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_byte_bpe": op13_byte_bpe,
}
ORACLE: dict[str, str] = {
    "op4_temperature_mix": mixing.ORACLE_SQL,
    "op5_sorted_projections": vector_dedup.ORACLE_SQL,
    "op7_seekable_warc": warc.ORACLE_SQL,
    "op10_kd_tree_top_k": nearest.ORACLE_SQL,
    "op11_collocations": collocations.ORACLE_SQL,
}
