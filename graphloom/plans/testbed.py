"""Views that cast the test tables into files, symbols and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.hierarchy import latest_extracts
from graphloom.runtime import cut, read_table, small_side, spread
from graphloom.schema import SYMBOLS_PER_FILE


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as symbols: path from source and language, signature the first line, body the text."""
    # Cutting texts into terms is bound by CPU.
    d = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "author"))
    text = F.coalesce("text", F.lit(""))
    return d.select(
        F.col("doc_id").alias("id"),
        F.coalesce("author", F.lit("")).alias("name"),
        F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string")).alias("path"),
        F.substring_index(text, "\n", 1).alias("signature"),
        text.alias("body"),
        F.lit(1).cast("long").alias("start_line"),
        F.lit(0).cast("long").alias("in_edges"),
    )


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file: file_id, repo_id, path, lang, text, size, hash."""
    s = read_table(spark, sf_dir, "source_files")
    place = [F.col("_metadata.file_path").alias("__f"), F.col("_metadata.row_index").alias("__r")]
    # Repeated rows are told by their other columns (the content hash among them) and left out
    # by their place: texts are neither read for it nor moved.
    cols = ["file_id", "repo_id", "rel", "lang", "size", "hash"]
    w = Window.partitionBy(*cols).orderBy("__f", "__r")
    keys = s.select(*cols, *place)
    again = cut(keys.withColumn("__k", F.row_number().over(w)).filter("__k > 1").select("__f", "__r"))
    rows = s.select("file_id", "repo_id", F.col("rel").alias("path"), "lang", "text", "size", "hash", *place)
    return rows.join(small_side(again), ["__f", "__r"], "left_anti").drop("__f", "__r")


def source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same columns, repeated rows and all: for what is made distinct by its small results."""
    s = read_table(spark, sf_dir, "source_files")
    return s.select("file_id", "repo_id", F.col("rel").alias("path"), "lang", "text", "size", "hash")


def current_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, repo_id, path, lang, size, hash of the latest scan that has a hash."""
    f = read_table(spark, sf_dir, "files").filter(F.col("hash").isNotNull())
    m = F.max(F.struct("scanned_at", "repo_id", "path", "lang", "size", F.lower("hash").alias("hash"))).alias("m")
    return f.groupBy("file_id").agg(m).select("file_id", "m.repo_id", "m.path", "m.lang", "m.size", "m.hash")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of the latest extraction of each file, with ids by file and ordinal."""
    x = read_table(spark, sf_dir, "extracted")
    slim = F.transform("symbols", lambda s: F.struct(s["name"], s["kind"], s["start_line"], s["end_line"], s["signature"]))
    latest = x.groupBy("file_id").agg(F.max(F.struct("extracted_at", slim.alias("symbols"), "containers")).alias("m"))
    return latest.select("file_id", "m.containers", F.posexplode("m.symbols").alias("ordinal", "s")).select(
        "file_id",
        (F.col("file_id") * SYMBOLS_PER_FILE + F.col("ordinal") + 1).alias("id"),
        "ordinal", F.col("s.name").alias("name"), F.col("s.kind").alias("kind"), F.col("s.start_line").alias("start_line"),
        F.col("s.end_line").alias("end_line"), F.col("s.signature").alias("signature"),
        F.get("containers", F.col("ordinal")).alias("container"),
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code names in documents as calls: (src, callee), one row per mention."""
    d = read_table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    return d.select(
        F.col("doc_id").alias("src"), F.explode(F.regexp_extract_all("text", F.lit("`([A-Za-z_]+)`"), 1)).alias("callee")
    )


# Ranges of ids of the tables in the graph of keys.
NATION, CUSTOMER, ORDER, PART, SUPPLIER = 1_000, 1_000_000, 1_000_000_000, 10_000_000_000, 20_000_000_000


def key_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region contains nation contains customer; customer imports order; order calls part; part imports supplier."""
    t = lambda n: read_table(spark, sf_dir, n)
    edge = lambda df, a, b, kind: df.select(a.cast("long").alias("src"), b.cast("long").alias("dst"), F.lit(kind).alias("kind"))
    c = F.col
    li = t("lineitem")
    return (
        edge(t("nation"), c("n_regionkey"), c("n_nationkey") + NATION, "contains")
        .unionByName(edge(t("customer"), c("c_nationkey") + NATION, c("c_custkey") + CUSTOMER, "contains"))
        .unionByName(edge(t("orders"), c("o_custkey") + CUSTOMER, c("o_orderkey") + ORDER, "imports"))
        .unionByName(edge(li, c("l_orderkey") + ORDER, c("l_partkey") + PART, "calls"))
        .unionByName(edge(li, c("l_partkey") + PART, c("l_suppkey") + SUPPLIER, "imports"))
        .distinct()
    )


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between successive event types of a user: a graph with cycles."""
    from pyspark.sql import Window

    e = read_table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return (
        e.select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"))
        .filter(F.col("dst").isNotNull()).distinct().withColumn("kind", F.lit("calls"))
    )


__all__ = [
    "current_files", "documents", "key_edges", "latest_extracts", "mentions", "source_rows", "symbols", "transitions",
]
