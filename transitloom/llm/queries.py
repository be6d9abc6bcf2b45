"""One query for each operator: (spark, sf_dir) -> DataFrame, over the whole intended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from transitloom.llm import best_fit, decontaminate, filter_audit, language, line_dedup, ngram_join, packed_ids, prefix_trie, quality, secrets, simhash, sql, suffix_dedup, token_counts


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_ids.packed_ids(_read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(_read(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.judged(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(_read(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_read(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.packed(_read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.report(prefix_trie.trie(_read(spark, sf_dir, "conversations"), rebuild=True))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(_read(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_packed_ids, op2_language_id, op3_ngram_jaccard_join, op4_token_counts, op5_quality_rules, op6_decontamination, op7_suffix_dedup, op8_line_dedup, op9_secret_scan, op10_best_fit_packing, op11_prefix_trie, op12_simhash_near_dedup, op13_filter_audit)}
ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": sql.NGRAM_JACCARD_JOIN,
    "op6_decontamination": sql.DECONTAMINATION,
    "op7_suffix_dedup": sql.SUFFIX_DEDUP,
    "op8_line_dedup": sql.LINE_DEDUP,
    "op11_prefix_trie": sql.PREFIX_TRIE,
    "op13_filter_audit": sql.FILTER_AUDIT,
}
