"""Exhaustive search with each hit attributed to its innermost enclosing definition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T

#: Lines of one bucket of the interval join.
BIN = 64


def matching_lines(
    files: DataFrame, pattern: str, fixed: bool = False, ignore_case: bool = False, scope: str | None = None
) -> DataFrame:
    """(file_id, path, line, text): matching lines, trimmed, from 1. No shuffle.

    A file without any match is dropped before its lines are opened.
    """
    p = T.pattern(pattern, fixed, ignore_case)
    wanted = files.filter(T.path_in_scope(F.col("path"), scope)).filter(F.col("text").isNotNull())
    if fixed and not ignore_case:
        wanted = wanted.filter(F.col("text").contains(pattern))
    found = wanted.select("file_id", "path", F.posexplode(T.lines(F.col("text"))).alias("at", "text"))
    hit = F.col("text").contains(pattern) if fixed and not ignore_case else F.col("text").rlike(p)
    return found.filter(hit).select("file_id", "path", (F.col("at") + 1).cast("long").alias("line"), F.trim("text").alias("text"))


def matches_by_file(files: DataFrame, pattern: str, fixed: bool = False, ignore_case: bool = False, scope: str | None = None) -> DataFrame:
    """(file_id, path, lines): one row per file that could be read, its matching lines in an array, maybe none."""
    p = T.pattern(pattern, fixed, ignore_case)
    wanted = files.filter(T.path_in_scope(F.col("path"), scope)).filter(F.col("text").isNotNull())
    hit = (lambda t: t.contains(pattern)) if fixed and not ignore_case else (lambda t: t.rlike(p))
    numbered = F.transform(T.lines(F.col("text")), lambda t, i: F.struct((i + 1).cast("long").alias("line"), t.alias("text")))
    lines = F.transform(F.filter(numbered, lambda x: hit(x["text"])), lambda x: F.struct(x["line"].alias("line"), F.trim(x["text"]).alias("text")))
    return wanted.select("file_id", "path", lines.alias("lines"))


def attribute(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds ``symbol`` (id or null): the narrowest span around the line, equal ones by id.

    An equi join on file and bucket of lines with the range as residual: the bucket keeps a
    file with very many lines and spans from becoming one pair-wise comparison. Spans are
    entered in every bucket they touch.
    """
    s = spans.select(
        "file_id", "id", "start_line", "end_line",
        F.explode(F.sequence((F.col("start_line") / BIN).cast("long"), (F.greatest("start_line", "end_line") / BIN).cast("long"))).alias("bin"),
    )
    h = hits.withColumn("bin", (F.col("line") / BIN).cast("long"))
    joined = h.join(s, ["file_id", "bin"], "left").withColumn(
        "fits", F.col("line").between(F.col("start_line"), F.col("end_line"))
    )
    key = F.when(F.col("fits"), F.struct((F.col("end_line") - F.col("start_line")).alias("w"), F.col("id").alias("id")))
    # A line is known by its file and number; its text travels but is no key.
    one = joined.groupBy("file_id", "line").agg(F.first("path").alias("path"), F.first("text").alias("text"), F.min(key)["id"].alias("symbol"))
    return one.select("file_id", "path", "line", "text", "symbol")


def grouped(hits: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Hits by file and symbol in line order, with the symbol's degree; total counts lines."""
    from graphloom.operators.rank import in_degree, real

    owned = attribute(hits, real(symbols).select("file_id", "id", "start_line", "end_line"))
    groups = owned.groupBy("file_id", "path", "symbol").agg(
        F.count(F.lit(1)).alias("hits"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("lines")
    )
    info = symbols.select(F.col("id").alias("symbol"), "name", "kind", "start_line")
    degree = in_degree(edges).withColumnRenamed("id", "symbol")
    return groups.join(info, "symbol", "left").join(degree, "symbol", "left").fillna(0, ["in_edges"])
