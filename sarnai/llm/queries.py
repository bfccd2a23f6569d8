"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sarnai.llm import chat, html_extract, langid, licenses, media, mixing, packing, quality, simhash, toxicity
from sarnai.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(toxicity.training_rows(documents, table(spark, sf_dir, "labels")))
    return toxicity.score_toxicity(documents, model)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure_quality(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversation_digests(chat.with_probe(table(spark, sf_dir, "conversations")))


def chat_typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's operator over conversations whose turns hold images, sounds and documents beside their text."""
    found = chat.conversation_digests(chat.with_parts(table(spark, sf_dir, "conversations")), parts=True)
    return found.select("conv_id", "n_turns", "n_attachments", "expanded_tokens", "references_sha256")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return langid.predict_language(documents, langid.train(langid.training_rows(documents)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_quality_rules, op3_html_extraction, op4_license_scan, op5_chat_formatting, op6_media_columns, op7_simhash, op8_packing,
        op9_mixing, op10_language_id, chat_typed_parts,
    )
}
ORACLES: dict[str, str] = {"op9_mixing": mixing.SQL, "chat_typed_parts": chat.PARTS_SQL}
