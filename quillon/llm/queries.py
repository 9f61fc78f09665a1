"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import alignment, decontam, html_extract, langid, license_scan, merkle, mixing, ngram_join, pii, quality, suffix_dedup, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(_table(spark, sf_dir, "documents")).select(*quality.COLUMNS)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), url_filter.rule_table(spark, url_filter.RULES), url_filter.TERMS)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(_table(spark, sf_dir, "documents"))


def op3_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels")))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = mixing.mix_to_targets(docs, mixing.domains_from(docs, _table(spark, sf_dir, "labels")), mixing.target_weight)
    return out.selectExpr("doc_id", "_tokens AS n_tokens", "_domain AS domain", "_rate AS rate", "_copies AS copies")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.mark_contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(langid.rows_of(_table(spark, sf_dir, "pages"), docs), langid.fit_text_model(docs), ["doc_id", "page_id"])


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_components(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_tampered(_table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_toxicity_fm": op3_toxicity_fm,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_mix_sources": op5_mix_sources,
    "op6_quality_rules": op6_quality_rules,
    "op7_url_filter": op7_url_filter,
    "op8_html_extract": op8_html_extract,
    "op9_decontaminate": op9_decontaminate,
    "op10_language_id": op10_language_id,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

ORACLE: dict[str, str] = {
    "op1_license_scan": license_scan.ORACLE_SQL,
    "op6_quality_rules": quality.ORACLE_SQL,
    "op7_url_filter": url_filter.ORACLE_SQL,
    "op11_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op12_merkle_manifest": merkle.ORACLE_SQL,
}
