"""One query for each operator, over whole tables, with production parameters; SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, fingerprints, html_text, importance, jaccard_join, language_id, manifest, mixing, packing, pii, quality, token_output
from .common import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op2_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op3_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_along_curve(table(spark, sf_dir, "documents"))


def op4_pruned_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op5_canonical_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op8_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), keep=["doc_id", "source"])


def op9_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_languages(table(spark, sf_dir, "documents"))


def op10_packed_token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.packed_rows(table(spark, sf_dir, "documents"))


def op11_pooled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predict_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified(table(spark, sf_dir, "documents"), manifest.lowered_thirds())


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_perspective_rotation, op3_curve_packing, op4_pruned_graph_neighbours, op5_canonical_fingerprints,
    op6_personal_data, op7_main_text, op8_pfair_mixing, op9_string_kernel_language, op10_packed_token_rows,
    op11_pooled_quality, op12_importance_resampling, op13_merkle_manifest,
)}

ORACLES = {"op2_perspective_rotation": chat.ORACLE, "op8_pfair_mixing": mixing.ORACLE, "op12_importance_resampling": importance.ORACLE, "op13_merkle_manifest": manifest.ORACLE}
