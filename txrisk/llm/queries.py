"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from txrisk.llm import (
    centroids,
    classes,
    conversations,
    decontaminate,
    exact,
    html,
    jaccard,
    language,
    packing,
    phrases,
    quality,
    suffixes,
    toxicity,
)
from txrisk.llm.common import read


def op1_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify(read(spark, sf, "documents"), read(spark, sf, "labels"))


def op2_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf, "documents"), packing.Settings(tokenizer_path())).drop("cost")


def op3_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = exact.deduplicate(spark, f"{sf}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.classify(read(spark, sf, "documents"), read(spark, sf, "labels"))


def op5_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html.extract(read(spark, sf, "pages"))


def op6_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(read(spark, sf, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.join_components(read(spark, sf, "documents"))


def op8_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.leaks(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "n_equal", "n_compared", "best_window")


def op9_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffixes.remove_repeats(read(spark, sf, "documents"))


def op10_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.remove_repeats(read(spark, sf, "documents")).drop("n_spans")


def op11_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.repair_report(conversations.damage(read(spark, sf, "conversations")))


def op12_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return classes.score_texts(read(spark, sf, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf: str) -> DataFrame:
    return centroids.cluster(read(spark, sf, "embeddings"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_packing, op3_exact_dedup, op4_toxicity, op5_html_extraction,
        op6_language_id, op7_ngram_jaccard_join, op8_decontamination,
        op9_suffix_array_dedup, op10_substring_dedup,
        op11_conversation_repair, op12_lm_scoring, op13_centroid_clustering,
    )
}

TWINS: dict[str, str] = {
    "op3_exact_dedup": r"""
    WITH n AS (
      SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
      row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
    FROM n WINDOW w AS (PARTITION BY t ORDER BY doc_id NULLS LAST)""",
    "op11_conversation_repair": conversations.twin(),
    "op13_centroid_clustering": centroids.twin(),
}
