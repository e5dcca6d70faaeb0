"""Degrees, hubs, hotspots, maps, counts and outlines over a symbol graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators.graph import NODE_KINDS


def real(symbols: DataFrame) -> DataFrame:
    return symbols.filter(~F.col("kind").isin(*NODE_KINDS))


def in_degree(edges: DataFrame, kind: str | None = None) -> DataFrame:
    """(id, in_edges): edges that end in a node, of all kinds or of one. One partial aggregation."""
    e = edges if kind is None else edges.filter(F.col("kind") == kind)
    return e.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_edges"))


def with_degree(symbols: DataFrame, edges: DataFrame, kind: str | None = None) -> DataFrame:
    return symbols.join(in_degree(edges, kind), "id", "left").fillna(0, ["in_edges"])


def hubs(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols that are called, with how often."""
    return with_degree(real(symbols), edges, "calls").filter(F.col("in_edges") > 0)


def hotspots(symbols: DataFrame, edges: DataFrame, top: int = 12) -> DataFrame:
    """The most called symbols, equal ones by name; rank in a column."""
    best = hubs(symbols, edges).orderBy(F.desc("in_edges"), "name", "id").limit(max(1, top))
    w = Window.orderBy(F.desc("in_edges"), "name", "id")  # over at most ``top`` rows
    return best.withColumn("rank", F.row_number().over(w))


def directories(files: DataFrame, symbols: DataFrame, edges: DataFrame, hubs_per_dir: int = 3) -> DataFrame:
    """(dir, files, symbols, hubs) per top-level folder; folders without symbols count too.

    Two partial aggregations and a per-folder top-k that Spark limits before its shuffle.
    """
    f = files.select("file_id", "path", T.top_dir(F.col("path")).alias("dir"))
    counts = f.groupBy("dir").agg(F.countDistinct("path").alias("files"))
    placed = real(symbols).join(f.select("file_id", "dir", "path"), "file_id")
    syms = placed.groupBy("dir").agg(F.count(F.lit(1)).alias("symbols"))
    w = Window.partitionBy("dir").orderBy(F.desc("in_edges"), "name", "id")
    top = (
        hubs(symbols, edges).join(f.select("file_id", "dir"), "file_id")
        .withColumn("k", F.row_number().over(w)).filter(F.col("k") <= hubs_per_dir)
        .groupBy("dir").agg(F.array_sort(F.collect_list(F.struct("k", "name", "in_edges"))).alias("hubs"))
    )
    out = counts.join(syms, "dir", "left").join(top, "dir", "left")
    return out.select("dir", "files", F.coalesce("symbols", F.lit(0)).alias("symbols"), "hubs")


def repo_map(files: DataFrame, symbols: DataFrame, edges: DataFrame, top: int = 12) -> dict:
    """Totals, the largest folders, how many were left out, and hotspots: a small driver-side answer."""
    per_dir = directories(files, symbols, edges)
    chosen = per_dir.orderBy(F.desc("symbols"), "dir").limit(max(1, top)).collect()
    n = per_dir.count()
    return {
        "files": files.count(), "symbols": real(symbols).count(), "edges": edges.count(),
        "dirs": [
            {"dir": r["dir"], "files": r["files"], "symbols": r["symbols"], "hubs": [{"name": h["name"], "in_degree": h["in_edges"]} for h in r["hubs"] or []]}
            for r in chosen
        ],
        "dropped_dirs": max(0, n - len(chosen)),
        "hotspots": [
            {"name": r["name"], "kind": r["kind"], "in_degree": r["in_edges"]}
            for r in hotspots(symbols, edges, top).orderBy("rank").collect()
        ],
    }


def status(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts per repository; symbols include file and module nodes here."""
    n = lambda df, name: df.groupBy("repo_id").agg(F.count(F.lit(1)).alias(name))
    out = n(files, "files").join(n(symbols, "symbols"), "repo_id", "left").join(n(edges, "edges"), "repo_id", "left")
    return out.fillna(0, ["symbols", "edges"])


def outline(symbols: DataFrame, files: DataFrame, path: str | None = None) -> DataFrame:
    """Definitions in reading order (rank from 1), of one file or of all."""
    f = files.select("file_id", "path") if path is None else files.filter(F.col("path") == path).select("file_id", "path")
    rows = real(symbols).join(f, "file_id")
    w = Window.partitionBy("file_id").orderBy("start_line", F.desc("end_line"), "id")
    return rows.select(
        "file_id", "path", F.row_number().over(w).alias("rank"), "name", "kind", "start_line", "end_line",
        F.coalesce("signature", F.lit("")).alias("signature"), "container",
    )


def outline_path(files: DataFrame, wanted: str) -> str | None:
    """The path itself, or the only path with that file name."""
    import re

    wanted = re.sub(r"^(?:\./)+", "", wanted)
    if files.filter(F.col("path") == wanted).limit(1).count():
        return wanted
    if "/" in wanted:
        return None
    named = files.filter(F.substring_index("path", "/", -1) == wanted).select("path").distinct().limit(2).collect()
    return named[0]["path"] if len(named) == 1 else None
