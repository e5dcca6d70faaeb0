"""Differences between what is stored and what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(stored: DataFrame, live: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys, change): added, modified or deleted by hash; one full outer join on the keys.

    Sizes and times make no change. A null hash equals a null hash.
    """
    a = stored.select(*keys, F.col("hash").alias("__old"), F.lit(True).alias("__in_old"))
    b = live.select(*keys, F.col("hash").alias("__new"), F.lit(True).alias("__in_new"))
    change = (
        F.when(F.col("__in_old").isNull(), "added")
        .when(F.col("__in_new").isNull(), "deleted")
        .when(~F.col("__old").eqNullSafe(F.col("__new")), "modified")
    )
    return a.join(b, list(keys), "full_outer").select(*keys, change.alias("change")).filter(F.col("change").isNotNull())


def deleted(stored: DataFrame, live: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    return stored.join(live.select(*keys), list(keys), "left_anti").select(*keys)


def summary(changes: DataFrame, indexed: bool = True, stamp_current: bool = True) -> dict:
    """The lists of a freshness answer and whether it is clean."""
    rows = changes.orderBy("path").collect()
    out = {k: [r["path"] for r in rows if r["change"] == k] for k in ("added", "modified", "deleted")}
    return {"indexed": indexed, "stamp_current": stamp_current, **out, "clean": indexed and stamp_current and not rows}
