"""Queries of the general training-data problems (3, 4, 5) and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import hierarchy, incremental, snapshots
from graphloom.runtime import checkpoint_dir, read_table

CURRENT_STAMP = "xg-6"


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: read_table(spark, sf_dir, n)
    work = incremental.extraction_work(t("files"), t("file_extracts"), t("index_runs"), CURRENT_STAMP)
    return work.select("file_id")


def p3_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target after two runs with a failing one between: (file_id, hash, run that made it).

    The first run sees the scans of the first half of the time, the second all of them; the
    one between writes its rows and dies before it publishes.
    """
    root = f"{checkpoint_dir(spark)}/p3-target-{uuid.uuid4().hex[:8]}"
    target = incremental.VersionedTarget(spark, root, "file_id", order="scanned_at")
    scans = (
        read_table(spark, sf_dir, "files")
        .filter(F.col("hash").isNotNull() & F.col("scanned_at").isNotNull())
        .select("file_id", F.lower("hash").alias("version"), "scanned_at")
    )
    low, high = scans.agg(F.min(F.unix_micros(F.col("scanned_at").cast("timestamp"))), F.max(F.unix_micros(F.col("scanned_at").cast("timestamp")))).first()
    early = scans if low is None else scans.filter(F.unix_micros(F.col("scanned_at").cast("timestamp")) <= low + (high - low) // 2)
    target.publish(target.pending(early).withColumn("run", F.lit(1)))

    class Lost(Exception):
        pass

    def dies(_entry):
        raise Lost

    target._commit, commit = dies, target._commit
    try:
        target.publish(target.pending(scans).withColumn("run", F.lit(9)))
    except Lost:
        target._commit = commit
    target.publish(target.pending(scans).withColumn("run", F.lit(2)))
    target.publish(target.pending(scans).withColumn("run", F.lit(3)))  # finds nothing left
    return target.current().select("file_id", F.col("version").alias("hash"), "run")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = hierarchy.symbol_trees(read_table(spark, sf_dir, "extracted"))
    return trees.filter(F.col("parent").isNotNull()).select(
        "file_id", "ordinal", F.coalesce("root", F.lit(-1).cast("long")).alias("root_ordinal"), "depth"
    )


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol with its full path; links that never reach a root have none."""
    trees = hierarchy.symbol_trees(read_table(spark, sf_dir, "extracted"), paths=True)
    return trees.select(
        "file_id", "ordinal", "parent", "root", "depth", F.array_join("path", "/").alias("path")
    )


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = hierarchy.symbol_trees(read_table(spark, sf_dir, "extracted"), paths=True)
    return hierarchy.descendants(trees, "file_id", "ordinal")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.changes(
        read_table(spark, sf_dir, "file_snapshots"), read_table(spark, sf_dir, "snapshot_deliveries")
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir)


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.summary(_changes(spark, sf_dir))


def p5_stepwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same changes from one delivery at a time, each against the kept state of the one before."""
    files, deliveries = read_table(spark, sf_dir, "file_snapshots"), read_table(spark, sf_dir, "snapshot_deliveries")
    numbers = [r[0] for r in deliveries.select("snapshot_no").dropna().distinct().orderBy("snapshot_no").collect()]
    state, out = None, spark.createDataFrame([], snapshots.CHANGES)
    blocks = max(1, -(-files.count() // (snapshots.BLOCK_ROWS * max(1, len(numbers)))))
    for n in numbers:
        part = files.filter(F.col("snapshot_no") == n)
        changed, state = snapshots.apply_delivery(state, part, deliveries.filter(F.col("snapshot_no") <= n), n, blocks)
        out = out.unionByName(changed)
    return out


QUERIES = {
    f.__name__: f for f in (p3_found, p3_target, p4_found, p4_paths, p4_descendants, p5_found, p5_counts, p5_stepwise)
}

_TREE = """
with recursive latest as (
  select file_id, max(struct_pack(extracted_at := extracted_at, symbols := symbols, parents := parents,
                                  containers := containers)) as x
  from extracted where file_id is not null group by file_id
), flat as (
  select file_id, unnest(range(len(x.symbols))) as ordinal, x.symbols as symbols, x.parents as parents,
         x.containers as containers, len(x.symbols) as n
  from latest
), nodes as (
  select file_id, cast(ordinal as bigint) as ordinal, symbols[ordinal + 1].name as name,
         symbols[ordinal + 1].kind as kind, n, parents[ordinal + 1] as listed, containers[ordinal + 1] as container
  from flat
), named as (
  select file_id, name as container, min(ordinal) as by_name from nodes
  where kind in ('class', 'struct', 'trait', 'interface', 'enum', 'type') and name is not null group by 1, 2
), links as (
  select s.file_id, s.ordinal, coalesce(s.name, '') as name,
         case when listed >= 0 and listed < n then cast(listed as bigint) else by_name end as parent
  from nodes s left join named m on s.file_id = m.file_id and s.container = m.container
), walk as (
  select file_id, ordinal, ordinal as root, cast(0 as bigint) as depth, name as path, [ordinal] as chain
  from links where parent is null
  union all
  select l.file_id, l.ordinal, w.root, w.depth + 1, w.path || '/' || l.name, list_append(w.chain, l.ordinal)
  from walk w join links l on l.file_id = w.file_id and l.parent = w.ordinal
), trees as (
  select l.file_id, l.ordinal, l.parent, w.root, coalesce(w.depth, -1) as depth, w.path, w.chain
  from links l left join walk w on w.file_id = l.file_id and w.ordinal = l.ordinal
)
"""

_CHANGES = """
with done as (
  select repo_id, snapshot_no from snapshot_deliveries
  where repo_id is not null and snapshot_no is not null
  group by repo_id, snapshot_no having arg_max(status, delivered_at) = 'complete'
), ranked as (
  select *, row_number() over (partition by repo_id order by snapshot_no) as r from done
), rows_ as (
  select repo_id, snapshot_no,
         regexp_replace(regexp_replace(path, '[/\\\\]+', '/', 'g'), '^(\\./)+', '') as path,
         max(struct_pack(at := coalesce(loaded_at, timestamp '0001-01-01'), h := coalesce(lower(hash), ''))).h as h
  from file_snapshots where path is not null group by 1, 2, 3
), have as (
  select s.repo_id, s.path, k.r, s.h from rows_ s join ranked k using (repo_id, snapshot_no)
), changes as (
  select k.snapshot_no, k.repo_id, coalesce(a.path, b.path) as path,
         case when b.path is null then 'added' when a.path is null then 'deleted' else 'modified' end as change
  from (select * from have where r > 1) a
  full join (select h.repo_id, h.path, h.r + 1 as r, h.h from have h
             join (select repo_id, max(r) as last from ranked group by 1) m on m.repo_id = h.repo_id and h.r < m.last) b
    on a.repo_id = b.repo_id and a.r = b.r and a.path = b.path
  join ranked k on k.repo_id = coalesce(a.repo_id, b.repo_id) and k.r = coalesce(a.r, b.r)
  where a.path is null or b.path is null or a.h is distinct from b.h
)
"""

SQL = {
    "p3_found": """
        with cur as (
          select file_id, arg_max(lower(hash), scanned_at) as h from files where hash is not null group by file_id
        ), done as (
          select file_id, arg_max(lower(hash), extracted_at) as h, arg_max(extractor_stamp, extracted_at) as s
          from file_extracts where error is null and run_id in (select run_id from index_runs where status = 'ok')
          group by file_id
        )
        select c.file_id from cur c left join done d using (file_id)
        where d.file_id is null or d.h <> c.h or d.s is distinct from 'xg-6'
    """,
    "p3_target": """
        with scans as (
          select file_id, lower(hash) as h, scanned_at as seen from files where hash is not null and scanned_at is not null and file_id is not null
        ), cut as (
          select min(epoch_us(seen)) + (max(epoch_us(seen)) - min(epoch_us(seen))) // 2 as t from scans
        ), last as (select file_id, max(struct_pack(seen := seen, h := h)).h as h from scans group by 1),
        early as (select file_id, max(struct_pack(seen := seen, h := h)).h as h from scans, cut where epoch_us(seen) <= t group by 1)
        select l.file_id, l.h as hash, case when l.h = e.h then 1 else 2 end as run from last l left join early e using (file_id)
    """,
    "p4_found": _TREE
    + "select file_id, ordinal, coalesce(root, -1) as root_ordinal, depth from trees where parent is not null",
    "p4_paths": _TREE + "select file_id, ordinal, parent, root, depth, path from trees",
    "p4_descendants": _TREE
    + """select file_id, chain[i] as ancestor, ordinal, depth - i + 1 as distance
         from trees, unnest(range(1, depth + 1)) as u(i) where depth > 0""",
    "p5_found": _CHANGES + "select snapshot_no, repo_id, path, change from changes",
    "p5_stepwise": _CHANGES + "select snapshot_no, repo_id, path, change from changes",
    "p5_counts": _CHANGES
    + """select repo_id, snapshot_no, count(*) filter (change = 'added') as added,
                count(*) filter (change = 'modified') as modified, count(*) filter (change = 'deleted') as deleted
         from changes group by 1, 2""",
}
