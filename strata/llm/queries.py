"""The registered queries of the training-data operators: thin wrappers that
apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    cdc_chunks, decontam, hyperminhash, licenses, merkle, oracle, packing, pii, quality_knn, rule_ledger, secret_scan, suffix_dedup,
    token_counts, whitening,
)
from .common import shipped, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = shipped(fn)
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op6_rule_ledger", oracle.RULE_LEDGER)
def op6_rule_ledger(spark, sf_dir):
    led = rule_ledger.apply_policy(rule_ledger.ledger(table(spark, sf_dir, "documents")), "full-1")
    base = F.col("fail_bits").bitwiseAND(F.lit(rule_ledger.mask(rule_ledger.POLICIES["base-1"])).cast("long")) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      base.alias("base_failed"), "kept", "fail_bits")


@register("op8_token_counts")
def op8_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@register("op1_decontamination", oracle.DECONTAMINATION)
def op1_decontamination(spark, sf_dir):
    return decontam.decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op2_secret_scan", oracle.secret_scan())
def op2_secret_scan(spark, sf_dir):
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


@register("op3_packing")
def op3_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@register("op4_quality_knn")
def op4_quality_knn(spark, sf_dir):
    return quality_knn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op10_hyperminhash", oracle.NEAR_DUPLICATES)
def op10_hyperminhash(spark, sf_dir):
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"))


@register("op5_cdc_chunks")
def op5_cdc_chunks(spark, sf_dir):
    return cdc_chunks.chunk_dedup(table(spark, sf_dir, "documents"))


@register("op9_license_scan", oracle.license_scan())
def op9_license_scan(spark, sf_dir):
    return licenses.license_scan(table(spark, sf_dir, "documents"))


@register("op7_suffix_dedup", oracle.SUBSTRING_DEDUP)
def op7_suffix_dedup(spark, sf_dir):
    return suffix_dedup.substring_dedup(table(spark, sf_dir, "documents"))


@register("op12_merkle_manifest", oracle.MANIFEST)
def op12_merkle_manifest(spark, sf_dir):
    return merkle.dataset_manifest(table(spark, sf_dir, "documents"))


@register("op13_embedding_whitening")
def op13_embedding_whitening(spark, sf_dir):
    return whitening.whitening(table(spark, sf_dir, "embeddings"))


@register("op11_pii_boosting")
def op11_pii_boosting(spark, sf_dir):
    return pii.pii_scan(table(spark, sf_dir, "documents"))
