"""The queries of the training-data operators, over whole tables, with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulith.llm import chat, common, decontaminate, exact_dedup, extraction, jaccard_join, licenses, packing, quality, secrets, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.package_zip(spark)
    return common.table(spark, sf_dir, name)


def op1_weak_label_quality(spark, sf_dir):
    return quality.classify(spark, _read(spark, sf_dir, "documents"))


def op2_bm25_decontamination(spark, sf_dir):
    return decontaminate.find_leaks(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_perspective_rotation(spark, sf_dir):
    return chat.rotate(spark, _read(spark, sf_dir, "conversations"))


def op4_digest_index_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(spark, _read(spark, sf_dir, "documents"))


def op5_block_rule_extraction(spark, sf_dir):
    return extraction.extract_pages(_read(spark, sf_dir, "pages"))


def op6_license_scan(spark, sf_dir):
    return licenses.scan_licenses(spark, _read(spark, sf_dir, "documents"), licenses.TEMPLATES | licenses.SHORT_NOTICES)


def op7_lexical_packing(spark, sf_dir):
    return packing.pack_documents(spark, _read(spark, sf_dir, "documents"))


def op8_subword_toxicity(spark, sf_dir):
    return toxicity.score_documents(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_credential_linking(spark, sf_dir):
    return secrets.find_secrets(_read(spark, sf_dir, "documents"))


def op10_multi_order_jaccard(spark, sf_dir):
    return jaccard_join.jaccard_components(spark, _read(spark, sf_dir, "documents"))


def queries() -> dict:
    ops = (op1_weak_label_quality, op2_bm25_decontamination, op3_perspective_rotation, op4_digest_index_dedup, op5_block_rule_extraction,
           op6_license_scan, op7_lexical_packing, op8_subword_toxicity, op9_credential_linking, op10_multi_order_jaccard)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op3_perspective_rotation": chat.ORACLE_SQL, "op4_digest_index_dedup": exact_dedup.ORACLE_SQL}
