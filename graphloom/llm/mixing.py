"""Mixing sources to target weights by capped water-filling.

Each source may give at most max_repeats times its size. Sources whose share asks for
more are clamped there, and what is missing is spread over the others in proportion to
their weights until nothing has to be clamped. The resulting number of epochs of a source
is realised as whole repetitions of all its documents plus one more of a seeded sample.
The sample is the set of documents whose hash lies under a threshold; thresholds come
from two small histograms of tokens by hash (4,096 cells each per source), so the size is
met to about a 16-millionth of the source or one document, without sorting documents.

Nulls and edge cases
* documents without source, or of sources that are not listed, take no part;
* documents without tokens (null, empty) are never used;
* a listed source without documents reaches share 0 and is reported as short;
* a null or negative share counts as 0, a null max_repeats as 1; repeated targets of a
  source count once (the largest); shares are scaled to sum 1;
* ties in hash fall on one side of a threshold together; repeated rows of a document are
  documents of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 4096
#: Sources that a mix may list; the plan is made on the driver.
MAX_SOURCES = 100_000


@dataclass
class Quota:
    source: str
    share: float
    max_repeats: int
    available: int
    use: float = 0.0
    wanted: float = 0.0

    @property
    def epochs(self) -> float:
        return self.use / self.available if self.available else 0.0


def fill(quotas: list[Quota], total: float) -> None:
    """Set ``use`` of every quota: weights scaled so that the sum is ``total``, each at most its cap.

    If all caps together fall short of ``total``, every source is used up to its cap.
    """
    open_, left = [q for q in quotas if q.share > 0 and q.available > 0], float(total)
    for q in quotas:
        q.use, q.wanted = 0.0, q.share * left
    while open_ and left > 0:
        weight = sum(q.share for q in open_)
        full = [q for q in open_ if left * q.share / weight >= q.available * q.max_repeats]
        if not full:
            for q in open_:
                q.use = left * q.share / weight
            return
        for q in full:
            q.use = float(q.available * q.max_repeats)
            left -= q.use
        open_ = [q for q in open_ if q not in full]


def plan(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> list[Quota]:
    """Quotas per listed source; ``total`` defaults to the tokens that all of them have."""
    share = F.greatest(F.coalesce(F.col("target_share"), F.lit(0.0)), F.lit(0.0))
    wanted = targets.filter(F.col("source").isNotNull()).groupBy("source").agg(
        F.max(share).alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("reps")
    )
    have = sizes.filter(F.col("source").isNotNull()).groupBy("source").agg(F.sum("n_tokens").alias("available"))
    rows = wanted.join(have, "source", "left").orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    scale = sum(r["share"] for r in rows) or 1.0
    quotas = [Quota(r["source"], r["share"] / scale, max(0, r["reps"]), r["available"] or 0) for r in rows]
    fill(quotas, sum(q.available for q in quotas) if total is None else total)
    return quotas


def _nearest(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per source the first cell at which the running sum passes what is wanted, and the sum before it.

    ``cells`` has at most ``CELLS`` rows per source.
    """
    w = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    run = cells.withColumn("upto", F.sum("tokens").over(w)).join(wanted, "source")
    over = run.filter(F.col("upto") > F.col("want"))
    return over.groupBy("source").agg(F.min(F.struct("cell", (F.col("upto") - F.col("tokens")).alias("before"))).alias("m"))


def mix(sizes: DataFrame, targets: DataFrame, key: str = "doc_id", total: int | None = None, seed: int = 17):
    """(chosen, quotas): chosen has key, source, n_tokens and repeats > 0; quotas say how much was planned.

    ``sizes`` is read several times: pass it materialised. Its other columns are ignored.
    """
    spark = sizes.sparkSession
    sizes = sizes.select(key, "source", "n_tokens")
    quotas = plan(sizes, targets, total)
    rows = []
    for q in quotas:
        whole = min(int(q.epochs + 1e-9), q.max_repeats)
        rest = max(0.0, q.use - whole * q.available)
        rows.append((q.source, whole, rest if rest >= 0.5 else 0.0))
    # As many rows as the mix lists sources.
    parts = F.broadcast(spark.createDataFrame(rows, "source string, whole int, want double"))
    h = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(CELLS * CELLS))
    docs = (
        sizes.filter((F.col("n_tokens") > 0) & F.col("source").isNotNull())
        .join(parts, "source")
        .withColumn("h1", (h / CELLS).cast("int"))
        .withColumn("h2", F.pmod(h, F.lit(CELLS)).cast("int"))
    )
    partial = docs.filter(F.col("want") > 0)
    first = _nearest(
        partial.groupBy("source", F.col("h1").alias("cell")).agg(F.sum("n_tokens").alias("tokens")), parts.select("source", "want")
    ).select("source", F.col("m.cell").alias("t1"), F.col("m.before").alias("before"))
    cuts = {r["source"]: (r["t1"], r["before"]) for r in first.collect()}
    edge = [(s, t1, w - cuts[s][1]) for s, _, w in rows if s in cuts for t1 in [cuts[s][0]]]
    edges = F.broadcast(spark.createDataFrame(edge, "source string, t1 int, want2 double"))
    inside = partial.join(edges, "source").filter(F.col("h1") == F.col("t1"))
    cells = inside.groupBy("source", F.col("h2").alias("cell")).agg(F.sum("n_tokens").alias("tokens"))
    w = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    run = cells.withColumn("upto", F.sum("tokens").over(w)).join(edges, "source")
    # The cell whose end is nearest to what is wanted; before the first cell if that is nearer.
    best = run.groupBy("source").agg(
        F.min(F.struct(F.abs(F.col("upto") - F.col("want2")).alias("gap"), F.col("cell"))).alias("m"), F.first("want2").alias("want2")
    )
    ends = {r["source"]: (r["m"]["cell"] if r["m"]["gap"] < r["want2"] else -1) for r in best.collect()}
    limits = [(s, t1, ends.get(s, -1)) for s, t1, _ in edge]
    limit = F.broadcast(spark.createDataFrame(limits, "source string, t1 int, t2 int"))
    more = (F.col("want") > 0) & (
        F.col("t1").isNull() | (F.col("h1") < F.col("t1")) | ((F.col("h1") == F.col("t1")) & (F.col("h2") <= F.col("t2")))
    )
    repeats = F.col("whole") + F.when(more, 1).otherwise(0)
    chosen = (
        docs.join(limit, "source", "left").withColumn("repeats", repeats.cast("int"))
        .filter(F.col("repeats") > 0).select(*sizes.columns, "repeats")
    )
    return chosen, quotas


def report(chosen: DataFrame, quotas: list[Quota]) -> DataFrame:
    """Per listed source: target and actual share, tokens available and used, repeats.

    ``short``: even max_repeats uses of the source fell short of its share of the total.
    """
    spark = chosen.sparkSession
    rows = [(q.source, q.share, q.max_repeats, q.available, q.use < q.wanted - 0.5) for q in quotas]
    planned = F.broadcast(spark.createDataFrame(
        rows, "source string, target_share double, max_repeats int, available_tokens long, short boolean"
    ))
    got = chosen.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"),
        F.count(F.lit(1)).alias("documents"),
        F.max("repeats").alias("most_repeats"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = planned.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", "available_tokens", "short", zero("used_tokens"), zero("documents"), zero("most_repeats")
    )
    everything = joined.agg(F.sum("used_tokens").alias("total_tokens"))
    out = joined.join(F.broadcast(everything))
    actual = F.when(F.col("total_tokens") > 0, F.col("used_tokens") / F.col("total_tokens")).otherwise(0.0)
    return out.select(
        "source", "target_share", actual.alias("actual_share"), "max_repeats", "most_repeats", "documents",
        "available_tokens", "used_tokens", "total_tokens", "short",
    )
