"""Ranked lexical retrieval over symbols, and questions about the call structure."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.runtime import cut

#: Fixed values of the ranking.
NAME, PATH, SIGNATURE, BODY_CAP = 5.0, 2.5, 2.0, 3
TEST_FACTOR, POPULARITY, WEAK = 0.65, 0.06, 1.5
TEST_WORDS = {"test", "tests", "fixture", "fixtures"}


def structural_subject(query: str) -> tuple[str, bool] | None:
    """(symbol, outgoing) of ``who calls X``, ``what calls X``, ``what does X call``, ``what do X call``."""
    q = query.strip().rstrip("?.")
    m = re.match(r"(?i:who|what) (?i:calls) (.+)", q)
    if m:
        return m.group(1).strip(), False
    m = re.match(r"(?i:what) (?i:does|do) (.+) (?i:call)\Z", q)
    return (m.group(1).strip(), True) if m else None


def term_frequencies(docs: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(key, field, term, tf) of the named text columns, one explode and one partial aggregation."""
    def part(field: str, column: str):
        return F.transform(T.terms(F.col(column)), lambda t: F.struct(F.lit(field).alias("field"), t.alias("term")))

    parts = [part(f, c) for f, c in fields.items()]
    return (
        docs.select(key, F.explode(F.concat(*parts)).alias("x"))
        .groupBy(key, F.col("x.field").alias("field"), F.col("x.term").alias("term"))
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def document_frequency(tf: DataFrame, key: str) -> DataFrame:
    return tf.select(key, "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _has_any(text: Column, asked: list[str]) -> Column:
    folded = F.lower(F.coalesce(text, F.lit("")))
    out = folded.contains(asked[0])
    for t in asked[1:]:
        out = out | folded.contains(t)
    return out


def rank(docs: DataFrame, query: str, limit: int | None = 8, scope: str | None = None) -> DataFrame:
    """Documents (id, name, path, signature, body, start_line, in_edges) by score.

    One pass over the texts: documents without any term of the question leave by a plain
    substring test before they are cut into terms, the others become one small row per term
    with all that ranking needs, kept once. From then on only those rows are read; the
    document frequencies of the few terms come to the driver. ``limit`` None: all scored
    documents.
    """
    wanted = T.query_terms(query, docs.sparkSession)
    docs = docs.filter(T.in_scope(F.col("path"), scope))
    if not wanted:
        return docs.limit(0).select("id", "name", "path", "start_line", F.lit(0.0).alias("score"))
    total = max(1, docs.count())
    asked = sorted(set(wanted))
    fields = {"name": "name", "path": "path", "signature": "signature", "body": "body"}
    # A term is a stretch of the folded text. Only for ASCII terms is folding sure not to look around.
    plain = all(t.isascii() for t in asked)

    def counted(column: str):
        terms = T.terms(F.col(column))
        return F.filter(terms, lambda t: t.isin(asked)) if not plain else F.when(_has_any(F.col(column), asked), F.filter(terms, lambda t: t.isin(asked)))

    if plain:
        docs_hit = docs.filter(F.greatest(*[_has_any(F.col(c), asked) for c in fields.values()]))
    else:
        docs_hit = docs
    keep = ["id", "start_line", "in_edges", F.col("name").alias("__name"), F.col("path").alias("__path")]
    slim = docs_hit.select(*keep, *[counted(c).alias(f"__t_{f}") for f, c in fields.items()])
    tf = lambda f: F.coalesce(F.size(F.filter(f"__t_{f}", lambda t: t == F.col("term"))), F.lit(0))
    per = slim.select("id", "start_line", "in_edges", "__name", "__path", F.explode(F.array(*map(F.lit, asked))).alias("term"), *[f"__t_{f}" for f in fields])
    per = per.select("id", "start_line", "in_edges", "__name", "__path", "term", *[F.greatest(tf(f), F.lit(0)).alias(f) for f in fields])
    hit = cut(per.filter((F.col("name") + F.col("path") + F.col("signature") + F.col("body")) > 0))
    df = {r["term"]: r["n"] for r in hit.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    # A term of the question counts as often as it is there.
    idf = {t: math.log((total + 1.0) / (df.get(t, 0) + 1.0)) + 1.0 for t in asked}
    possible = sum(idf[t] * wanted.count(t) for t in asked)
    weight = F.element_at(F.create_map(*[x for t in asked for x in (F.lit(t), F.lit(idf[t] * wanted.count(t)))]), F.col("term"))
    amount = NAME * F.col("name") + PATH * F.col("path") + SIGNATURE * F.col("signature") + F.least("body", F.lit(BODY_CAP))
    strong = F.when(F.col("name") + F.col("path") + F.col("signature") > 0, weight).otherwise(0.0)
    out = (
        hit.groupBy("id")
        .agg(
            F.sum(weight * amount).alias("score"), F.sum(strong).alias("strong"), F.first("__name").alias("name"),
            F.first("__path").alias("path"), F.first("start_line").alias("start_line"), F.first("in_edges").alias("in_edges"),
        )
        .filter((F.col("score") > 0) & ~((F.col("strong") == 0) & (F.col("score") < WEAK * possible)))
    )
    if not TEST_WORDS & set(wanted):
        out = out.withColumn("score", F.when(T.is_test_path(F.col("path")), F.col("score") * TEST_FACTOR).otherwise(F.col("score")))
    out = out.withColumn("score", F.col("score") * (1 + POPULARITY * F.log(F.coalesce("in_edges", F.lit(0)) + 1.0)))
    out = out.select("id", "name", "path", "start_line", "score")
    return out if limit is None else out.orderBy(F.desc("score"), "path", "start_line", "id").limit(max(1, limit))


def interleave(ranked: DataFrame, repo: str, order: list[str], limit: int = 8) -> DataFrame:
    """Round robin over repositories: all first places, then all second ones, in the given order."""
    w = Window.partitionBy(repo).orderBy(F.desc("score"), "path", "start_line", "id")
    places = F.create_map(*[x for i, r in enumerate(order) for x in (F.lit(r), F.lit(i))])
    turn = ranked.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= limit)
    picked = turn.withColumn("place", F.element_at(places, F.col(repo))).orderBy("turn", "place").limit(max(1, limit))
    over = Window.orderBy("turn", "place")  # over at most ``limit`` rows
    return picked.withColumn("rank", F.row_number().over(over)).drop("turn", "place")
