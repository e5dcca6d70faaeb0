"""Breadth-first closure over the graph: who depends on a symbol, what it depends on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.runtime import cut


_FOLD = str.maketrans(T.UPPER, T.LOWER)
#: Nodes up to which a frontier is a list of ids that a scan can be filtered by.
FEW = 500


def split_name(symbol: str) -> tuple[str | None, str]:
    """(container, name): split at the last dot unless the symbol is a path."""
    if "." in symbol and "/" not in symbol:
        container, name = symbol.rsplit(".", 1)
        return container, name
    return None, symbol


def seeds(symbols: DataFrame, symbol: str) -> DataFrame:
    """Symbols of that name (A-Z folded), of that container or its last part if qualified."""
    container, name = split_name(symbol)
    out = symbols.filter((F.col("kind") != "module") & (T.ascii_lower(F.col("name")) == T.ascii_lower(F.lit(name))))
    if container is not None:
        tail = container.rsplit(".", 1)[-1]
        held = T.ascii_lower(F.col("container"))
        out = out.filter(held.isin(*(x.translate(_FOLD) for x in (container, tail))))
    return out


def reach(
    edges: DataFrame, start: DataFrame, outgoing: bool = False, depth: int | None = 1, skip: tuple[str, ...] = ("contains",)
) -> DataFrame:
    """(id, depth, kind) of every node other than the start reached over edges of other kinds.

    A frontier of at most ``FEW`` nodes is a filter on the edges, which passes below unions
    and distincts to their scans; a larger one is joined. What was visited is taken out by an
    anti join. Every level but the last is kept in the shared checkpoint folder, until
    nothing new comes or ``depth`` is reached. The kind is that of the first arrival: least
    id of the frontier, then least kind.
    """
    near, far = ("src", "dst") if outgoing else ("dst", "src")
    steps = edges.filter(~F.col("kind").isin(*skip)).select(F.col(near).alias("near"), F.col(far).alias("id"), "kind")
    frontier = start.select("id").distinct()
    visited, found, level = None, [], 0
    while depth is None or level < depth:
        ids = [r["id"] for r in frontier.limit(FEW + 1).collect()]
        if not ids:
            break
        level += 1
        few = len(ids) <= FEW
        if visited is None:
            frontier = steps.sparkSession.createDataFrame([(i,) for i in ids], frontier.schema) if few else cut(frontier)
            visited = frontier
        near_by = steps.filter(F.col("near").isin(ids)) if few else steps.join(frontier.select(F.col("id").alias("near")), "near")
        met = near_by.groupBy("id").agg(F.min_by("kind", F.struct("near", "kind")).alias("kind"))
        met = met.filter(~F.col("id").isin(ids)) if few and level == 1 else met.join(visited, "id", "left_anti")
        met = met.withColumn("depth", F.lit(level))
        if level != depth:
            met = cut(met)
        found.append(met)
        frontier = met.select("id")
        visited = visited.unionByName(frontier)
        if level % 8 == 0:
            visited = cut(visited)
    empty = start.limit(0).select("id", F.lit(None).cast("string").alias("kind"), F.lit(0).alias("depth"))
    for f in found:
        empty = empty.unionByName(f.select("id", "kind", "depth"))
    return empty


def callers(
    symbols: DataFrame, edges: DataFrame, files: DataFrame, symbol: str, outgoing: bool = False, depth: int | None = 1,
    scope: str | None = None,
) -> DataFrame:
    """Nodes reached from the seeds of a name, with path and depth.

    The scope restricts seeds and results; the walk passes through anything. From depth 2 on
    a file among the seeds stands for its members too.
    """
    where = files.select("file_id", "path")
    start = seeds(symbols, symbol).join(where, "file_id").filter(T.path_in_scope(F.col("path"), scope))
    if depth is None or depth > 1:
        whole = start.filter(F.col("kind") == "file").select("file_id")
        members = symbols.filter(~F.col("kind").isin("file", "module")).join(whole, "file_id", "left_semi")
        start = start.select("id").unionByName(members.select("id"))
    got = reach(edges, start, outgoing, depth)
    return got.withColumnRenamed("kind", "edge_kind").join(
        symbols.select("id", "file_id", "name", "kind", "start_line"), "id"
    ).join(where, "file_id").filter(T.path_in_scope(F.col("path"), scope)).drop("file_id")
