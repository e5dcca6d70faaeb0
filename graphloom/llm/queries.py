"""Queries of the llm problems; ``SQL`` has those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import abuse, bpe, handwritten, mixing, parsing, terms
from graphloom.llm.sql import SQL
from graphloom.runtime import cut, read_table

__all__ = ["QUERIES", "SQL"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.failing_ids(read_table(spark, sf_dir, "source_files"))


def p1_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.failing_files(read_table(spark, sf_dir, "source_files"))


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.failure_rates(read_table(spark, sf_dir, "source_files"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.most_distinctive(read_table(spark, sf_dir, "search_docs"), read_table(spark, sf_dir, "term_probes"))


def p2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return terms.distinctiveness(read_table(spark, sf_dir, "search_docs")).withColumn("score", F.round("score", 6))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_kinds(spark, sf_dir).select("file_id")


def p6_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.judge(read_table(spark, sf_dir, "source_files"), read_table(spark, sf_dir, "repos"))


def p6_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files each kind of evidence finds, and how many no other one does."""
    from pyspark.sql import functions as F

    kinds = ["by_comment", "by_layout", "by_path", "by_tree"]
    rows = p6_kinds(spark, sf_dir).select(
        F.expr(" + ".join(f"int({k})" for k in kinds)).alias("n"),
        F.explode(F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in kinds]))).alias("evidence"),
    )
    return rows.groupBy("evidence").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("n") == 1).alias("alone"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"))


def _mix(spark: SparkSession, sf_dir: str):
    sizes = cut(bpe.count_tokens(read_table(spark, sf_dir, "documents"), ["doc_id", "source"]))
    return mixing.mix(sizes, read_table(spark, sf_dir, "mix_targets"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the mix with the number of times it is used."""
    return _mix(spark, sf_dir)[0]


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(*_mix(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_failures, p1_rates, p2_found, p2_scores, p6_found, p6_kinds, p6_evidence, p7_ids, p8_mix, p8_report)
}


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.found(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "doc_reviews")).select("doc_id")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "doc_reviews"))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "doc_reviews"))


QUERIES |= {f.__name__: f for f in (p9_found, p9_scores, p9_rates)}
