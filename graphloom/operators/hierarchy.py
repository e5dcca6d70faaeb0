"""Parent-child rows to full hierarchies by pointer doubling.

Only nodes that are somebody's parent take part in the rounds. Each has a pointer to its
parent; a round joins each open node to the node it points at and takes over that node's
pointer, so the distance covered doubles: a tree of depth d is resolved after about log2(d)
rounds, whatever its shape. A node still open when the covered distance exceeds the number
of nodes of its group can never reach a root: it is in a cycle or hangs below one. At the
end every node takes root, depth and path from its parent in one join.

Nulls and edge cases
* a null parent, or one that is no node of the group, makes the node a root;
* rows with a null id or group are left out; of repeated (group, id) one is kept (the
  one with the smallest parent);
* a node on or below a cycle has root null, depth -1 and no path;
* an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import BROADCAST_ROWS, cut


def resolve(
    nodes: DataFrame,
    group: str,
    node: str,
    parent: str,
    segment: str | None = None,
    max_group: int | None = None,
    checked: bool = False,
) -> DataFrame:
    """(group, node, parent, root, depth[, chain, path]) for every node.

    ``segment``: the column with the path segment of a node; then ``path`` is the array
    of segments from the root to the node and ``chain`` the array of ids along it.
    ``max_group``: a bound on the nodes of one group, counted here if not given.
    ``checked``: nodes are known to be distinct, without nulls, and their parents nodes.
    """
    cols = [F.col(group).alias("g"), F.col(node).alias("id"), F.col(parent).alias("p")]
    if segment:
        cols.append(F.coalesce(F.col(segment).cast("string"), F.lit("")).alias("s"))
    base = nodes.select(*cols)
    if not checked:
        agg = [F.min("p").alias("p")] + ([F.min_by("s", F.struct("p", "s")).alias("s")] if segment else [])
        base = base.filter(F.col("g").isNotNull() & F.col("id").isNotNull()).groupBy("g", "id").agg(*agg)
    base = cut(base)
    if not checked:
        # A parent that is no node is none.
        ids = base.select("g", F.col("id").alias("p"), F.lit(True).alias("known"))
        base = base.join(ids, ["g", "p"], "left").withColumn("p", F.when(F.col("known"), F.col("p"))).drop("known")
    if max_group is None:
        max_group = base.groupBy("g").count().agg(F.max("count")).first()[0] or 1

    # The inner nodes with pointers of distance one.
    held = base.filter(F.col("p").isNotNull())
    inner = held.select("g", F.col("p").alias("id")).distinct()
    extra = ["path", "chain"] if segment else []
    own = [F.array("s").alias("path"), F.array("id").alias("chain")] if segment else []
    solved, open_, left = None, None, 0
    state = cut(
        base.join(inner, ["g", "id"], "left_semi").select(
            "g", "id", F.coalesce("p", "id").alias("to"), F.col("p").isNotNull().cast("long").alias("d"), F.col("p").isNull().alias("done"), *own
        )
    )
    solved, open_ = state.filter("done"), state.filter("not done")
    left = open_.count()
    for _ in range(max(1, math.ceil(math.log2(max(2, max_group))) + 1)):
        if not left:
            break
        table = solved.unionByName(open_).select(
            "g", F.col("id").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"),
            F.col("done").alias("done2"), *[F.col(c).alias(f"{c}2") for c in extra],
        )
        # With few open nodes left they travel to the table and not the table to them.
        few = left <= BROADCAST_ROWS
        moved = table.join(F.broadcast(open_) if few else open_, ["g", "to"]).select(
            "g", "id", F.col("to2").alias("to"), (F.col("d") + F.col("d2")).alias("d"),
            F.col("done2").alias("done"), *[F.concat(f"{c}2", c).alias(c) for c in extra],
        )
        # The join has the table's partitions, of which few then hold a row.
        moved = cut(moved.repartition(8) if few else moved)
        solved, open_ = solved.unionByName(moved.filter("done")), moved.filter("not done")
        left = open_.count()
    endless = open_.select(
        "g", "id", F.lit(None).cast(state.schema["to"].dataType).alias("to"), F.lit(-1).cast("long").alias("d"),
        F.lit(True).alias("done"), *[F.lit(None).cast(state.schema[c].dataType).alias(c) for c in extra],
    )
    above = (solved.unionByName(endless) if left else solved).select(
        "g", F.col("id").alias("p"), F.col("to").alias("root"), F.col("d").alias("d2"), *[F.col(c).alias(f"{c}2") for c in extra]
    )
    zero = F.lit(0).cast("long")
    roots = base.filter(F.col("p").isNull()).select("g", "id", "p", F.col("id").alias("root"), zero.alias("depth"), *own)
    below = held.join(above, ["g", "p"]).select(
        "g", "id", "p", "root", F.when(F.col("d2") < 0, F.lit(-1)).otherwise(F.col("d2") + 1).cast("long").alias("depth"),
        *[F.concat(f"{c}2", F.array(x)).alias(c) for c, x in zip(extra, ("s", "id"))],
    )
    return roots.unionByName(below).select(
        F.col("g").alias(group), F.col("id").alias(node), F.col("p").alias("parent"), "root", "depth", *extra
    )


def descendants(resolved: DataFrame, group: str, node: str) -> DataFrame:
    """(group, ancestor, node, distance): all strict descendants of every node, as rows.

    Needs the ``chain`` of :func:`resolve`. Rows, not arrays: a root with millions of
    descendants stays spread over the tasks that hold them.
    """
    return (
        resolved.filter(F.col("depth") > 0)
        .select(group, node, "depth", F.posexplode("chain").alias("at", "ancestor"))
        .filter(F.col("at") < F.col("depth"))
        .select(group, "ancestor", node, (F.col("depth") - F.col("at")).alias("distance"))
    )


#: Kinds whose name a container may name (fixed values of the task's data).
CONTAINER_KINDS = ("class", "struct", "trait", "interface", "enum", "type")


def latest_extracts(extracted: DataFrame) -> DataFrame:
    """One row per file: its latest extraction, without what the tree does not need.

    Ties in ``extracted_at`` go to the larger arrays in Spark's ordering. Signatures
    and line numbers are pruned before the shuffle.
    """
    slim = extracted.filter(F.col("file_id").isNotNull()).select(
        "file_id",
        F.struct(
            "extracted_at",
            F.transform("symbols", lambda s: F.struct(s["name"].alias("name"), s["kind"].alias("kind"))).alias("symbols"),
            F.col("parents"),
            F.col("containers"),
        ).alias("x"),
    )
    return slim.groupBy("file_id").agg(F.max("x").alias("x")).select("file_id", "x.symbols", "x.parents", "x.containers")


def symbol_parents(extracted: DataFrame) -> DataFrame:
    """(file_id, ordinal, name, kind, parent) of every symbol of the latest extractions.

    The parent is ``parents[ordinal]`` if that is an ordinal of the file; where it is
    null, missing or points outside, it is the symbol of a container kind whose name
    equals ``containers[ordinal]`` (the first such symbol, if a name repeats). A null
    symbol counts as a symbol without name and kind.
    """
    latest = latest_extracts(extracted)
    rows = latest.select(
        "file_id", F.size("symbols").alias("n"), "parents", "containers", F.posexplode("symbols").alias("ordinal", "s")
    )
    # F.get is null outside the array and on a null array: short arrays need no case.
    listed = F.get("parents", F.col("ordinal"))
    rows = rows.select(
        "file_id",
        F.col("ordinal").cast("long").alias("ordinal"),
        F.col("s.name").alias("name"),
        F.col("s.kind").alias("kind"),
        F.when((listed >= 0) & (listed < F.col("n")), listed).cast("long").alias("listed"),
        F.get("containers", F.col("ordinal")).alias("container"),
    )
    named = (
        rows.filter(F.col("kind").isin(*CONTAINER_KINDS) & F.col("name").isNotNull())
        .groupBy("file_id", F.col("name").alias("container"))
        .agg(F.min("ordinal").alias("by_name"))
    )
    # Whoever has a listed parent asks for no name: a null key meets nothing in the join.
    rows = rows.withColumn("container", F.when(F.col("listed").isNull(), F.col("container")))
    return rows.join(named, ["file_id", "container"], "left").select(
        "file_id", "ordinal", "name", "kind", F.coalesce("listed", "by_name").alias("parent")
    )


def symbol_trees(extracted: DataFrame, paths: bool = False) -> DataFrame:
    """The hierarchy of the symbols of every file; see :func:`resolve`."""
    rows = symbol_parents(extracted)
    return resolve(rows, "file_id", "ordinal", "parent", segment="name" if paths else None, checked=True)
