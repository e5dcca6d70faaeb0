"""How distinctive a term is per record: adjusted correspondence-analysis residuals.

With o the count of a term in a record, r and c the margins of record and term and N the
grand total, the expectation under independence is e = r c / N and the score

    (o - e) / sqrt(e (1 - r/N) (1 - c/N)),

the standardised residual whose variance the margins correct. Terms found everywhere
score near nought, terms that few records share and this one uses often score high.
All of it is DataFrame arithmetic. Only margins are broadcast, and only those of terms
so frequent that there cannot be many of them (:func:`graphloom.runtime.stats_join`).

Nulls and edge cases
* null or empty arrays add nothing; null terms and null or non-positive counts neither;
* a term listed more than once in a record adds up, over its three fields too;
* repeated rows of an id count once (the largest in array order, should they differ);
* a record that is the whole collection, or a term that is all of it, has variance
  nought and score 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import cut, small_side, stats_join

FIELDS = ("name_terms", "signature_terms", "body_terms")


def records(docs: DataFrame) -> DataFrame:
    """(id, terms, size): one row per id, the valid entries of all its fields, their total."""
    empty = F.array().cast("array<struct<term:string,tf:int>>")
    joined = F.concat(*[F.coalesce(F.col(c).cast("array<struct<term:string,tf:int>>"), empty) for c in FIELDS])
    valid = F.filter(joined, lambda t: t["term"].isNotNull() & (t["tf"] > 0))
    one = docs.filter(F.col("id").isNotNull()).select("id", valid.alias("terms")).groupBy("id").agg(F.max("terms").alias("terms"))
    size = F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + t["tf"])
    return one.withColumn("size", size)


def counts(one: DataFrame) -> DataFrame:
    """(id, size, term, o) of every term of every record; grouped where the rows already are."""
    return (
        one.select("id", "size", F.explode("terms").alias("t"))
        .groupBy("id", F.col("t.term").alias("term"))
        .agg(F.sum("t.tf").alias("o"), F.first("size").alias("size"))
    )


def margins(one: DataFrame) -> DataFrame:
    """(term, c, n): total count of a term and the rows that list it."""
    return (
        one.select(F.explode("terms").alias("t"))
        .groupBy(F.col("t.term").alias("term"))
        .agg(F.sum("t.tf").alias("c"), F.count(F.lit(1)).alias("n"))
    )


def _score(joined: DataFrame, total: int) -> DataFrame:
    n = F.lit(float(max(1, total)))
    e = F.col("size") * F.col("c") / n
    variance = e * (1 - F.col("size") / n) * (1 - F.col("c") / n)
    score = F.when(variance > 0, (F.col("o") - e) / F.sqrt(variance)).otherwise(F.lit(0.0))
    return joined.select("id", "term", F.col("o").alias("tf"), score.alias("score"))


def distinctiveness(docs: DataFrame) -> DataFrame:
    """(id, term, tf, score) of every term of every record."""
    one = cut(records(docs))
    total = one.agg(F.sum("size")).first()[0] or 0
    joined = stats_join(counts(one), cut(margins(one)), "term", "n")
    return _score(joined, total)


def most_distinctive(docs: DataFrame, probes: DataFrame) -> DataFrame:
    """(id, term): the highest score of each probed record, equal ones by term.

    Margins come from all records; only the probed ones are scored.
    """
    one = cut(records(docs))
    total = one.agg(F.sum("size")).first()[0] or 0
    asked = counts(one.join(small_side(probes.select("id").distinct()), "id", "left_semi"))
    joined = stats_join(asked, cut(margins(one)), "term", "n")
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("term").alias("term"))).alias("b")
    return _score(joined, total).groupBy("id").agg(best).select("id", "b.term")
