"""Session, checkpoint and size-checked broadcast helpers shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast after it was counted.
BROADCAST_ROWS = 50_000


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests, bench and the command line."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("graphloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's folder (``spark.checkpoint.dir``); invent one only in local mode.

    A machine-local folder is never used on a cluster: executors could not read it
    after one of them is lost.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
        return
    master = sc.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-checkpoint-"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for what has to outlive an executor."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise into the shared checkpoint folder and cut the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``max_rows`` rows, else leave the
    join strategy to the planner (sort-merge with AQE skew handling).

    The count stops at ``max_rows + 1`` rows.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def spread(scan: DataFrame) -> DataFrame:
    """Give a CPU-bound map over a scan at least one task per core.

    A scan of few splits would run in few tasks; its rows are then dealt out by one
    round-robin shuffle. A scan with as many splits as cores, as any large one has, is
    left alone. ``scan`` may filter and project but not shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores)


def stats_join(rows: DataFrame, stats: DataFrame, key: str, weight: str, hot_rows: int = 20_000) -> DataFrame:
    """Join ``rows`` to one-row-per-key ``stats`` without sending a hot key to one task.

    ``weight`` is the column of ``stats`` that says how many rows carry the key. The
    few keys above a threshold (the total of ``weight`` over ``hot_rows``, so there
    are at most ``hot_rows`` of them) travel by broadcast, the rest by a shuffle join.
    """
    total = stats.agg(F.sum(weight)).first()[0] or 0
    limit = max(1, total // hot_rows)
    values = [c for c in stats.columns if c != key]
    hot = stats.filter(F.col(weight) > limit).select(key, *[F.col(c).alias(f"__hot_{c}") for c in values])
    cold = stats.filter(F.col(weight) <= limit).select(F.col(key).alias("__key"), *[F.col(c).alias(f"__cold_{c}") for c in values])
    # The rows are read once. Those of hot keys go through the second join under keys that
    # no row of it has, dealt out evenly.
    marked = rows.join(F.broadcast(hot), key, "left")
    spare = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*rows.columns), F.lit(4096)).cast("string"))
    at = F.when(F.col(f"__hot_{weight}").isNull(), F.col(key).cast("string")).otherwise(spare)
    both = marked.withColumn("__at", at).join(cold, F.col("__at") == F.col("__key").cast("string"), "left")
    out = both.select(*[F.col(c) for c in rows.columns], *[F.coalesce(f"__hot_{c}", f"__cold_{c}").alias(c) for c in values])
    return out.filter(F.col(weight).isNotNull())
