"""What changed between full snapshots.

Keys (paths) are mapped to persistent ordinals: a dictionary per block of a group
(repository) to which each delivery appends the keys it is the first to have, so a later
delivery never changes an ordinal. A snapshot of a block is a compressed bitmap
(:mod:`graphloom.operators.bitmaps`) over the ordinals and a vector of values aligned to
them. Two consecutive bitmaps give the added keys by ``new AND NOT old``, the deleted ones
by ``old AND NOT new`` and the common ones by ``AND``, among which the aligned vectors show
the modified ones.

:func:`changes` plays all deliveries from the first; :func:`apply_delivery` takes one new
delivery and the kept state of the one before (dictionary, bitmap, vector), so that earlier
listings are never read again. Both go through :class:`Block`.

Blocks are chosen by a hash of the key, so a group that holds a third of all rows is spread
over as many tasks as its rows need, and all snapshots of one key meet in one block.
Repeated rows of a key in a snapshot are taken together before that, in part before any
shuffle, so a path that is written very often makes no large block.

Nulls and edge cases
* rows with a null group, snapshot number or key are left out;
* of several rows of one key in a snapshot the latest counts, a null time being the
  oldest; of equal times the larger value;
* a null value equals a null value and nothing else;
* snapshots that are not complete, or not delivered, take no part; the first complete
  one of a group gives no changes; a complete one without rows deletes everything;
* two values that differ only in letter case are the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.bitmaps import Bitmap
from graphloom.runtime import cut, small_side

CHANGES = "snapshot_no int, repo_id long, path string, change string"
#: Rows that one block of one repository should hold at most, on average.
BLOCK_ROWS = 40_000


def plain_path(path: Column) -> Column:
    """``/`` as the only separator, none repeated, no leading ``./``."""
    slashed = F.regexp_replace(path, r"[/\\]+", "/")
    return F.regexp_replace(slashed, r"^(?:\./)+", "")


def delivery_order(deliveries: DataFrame) -> DataFrame:
    """(repo_id, snapshot_no, rank, next_no) of the complete deliveries of each group.

    The last word on a (group, snapshot) is its latest delivery row.
    """
    last = (
        deliveries.filter(F.col("repo_id").isNotNull() & F.col("snapshot_no").isNotNull())
        .groupBy("repo_id", "snapshot_no")
        .agg(F.max(F.struct("delivered_at", "status")).alias("m"))
        .filter(F.col("m.status") == "complete")
    )
    w = Window.partitionBy("repo_id").orderBy("snapshot_no")
    return last.select(
        "repo_id",
        "snapshot_no",
        (F.row_number().over(w) - 1).cast("int").alias("rank"),
        F.lead("snapshot_no").over(w).alias("next_no"),
    )


class Block:
    """Keys of one block with their ordinals, and the latest snapshot over them."""

    def __init__(self, paths=(), bitmap: Bitmap | None = None, values=()):
        self.paths = list(paths)
        self.ordinal = {p: i for i, p in enumerate(self.paths)}
        self.bitmap = bitmap or Bitmap()
        self.vector = np.array([*values, *[None] * (len(self.paths) - len(values))], object)

    def step(self, paths: np.ndarray, values: np.ndarray) -> list[tuple[str, np.ndarray]]:
        """Take the next snapshot (distinct keys and their values); what changed, as ordinals by kind."""
        known = self.ordinal
        for p in sorted(p for p in paths if p not in known):
            known[p] = len(self.paths)
            self.paths.append(p)
        at = np.fromiter((known[p] for p in paths), np.int64, len(paths))
        vector = np.full(len(self.paths), None, object)
        vector[at] = values
        old, new = self.bitmap, Bitmap.of(at)
        common = (new & old).members()
        out = [
            ("added", new.and_not(old).members()),
            ("deleted", old.and_not(new).members()),
            ("modified", common[vector[common] != self.vector[common]]),
        ]
        self.bitmap, self.vector = new, vector
        return out

    def named(self, ordinals: np.ndarray) -> np.ndarray:
        return np.array([self.paths[i] for i in ordinals], object)


def _block_changes(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Changes of one block over all its deliveries; its rows are those of a bounded number of keys."""
    block, out = Block(), []
    following = -1
    for rank, part in pdf.groupby("rank", sort=True):
        number, nxt = int(part["snapshot_no"].iloc[0]), part["next_no"].iloc[0]
        if following >= 0 and following != number:
            # Complete snapshots in between have no key of this block.
            out += [(following, kind, block.named(at)) for kind, at in block.step(_NONE, _NONE)]
        got = block.step(part["path"].to_numpy(object), part["value"].astype(object).where(part["value"].notna(), None).to_numpy(object))
        if rank > 0:
            out += [(number, kind, block.named(at)) for kind, at in got]
        following = int(nxt) if nxt == nxt and nxt is not None else -1
    if following >= 0:
        out += [(following, kind, block.named(at)) for kind, at in block.step(_NONE, _NONE)]
    sizes = [len(names) for _, _, names in out]
    return pd.DataFrame(
        {
            "snapshot_no": np.repeat(np.array([n for n, _, _ in out], np.int32), sizes),
            "repo_id": key[0],
            "path": np.concatenate([names for _, _, names in out]) if out else [],
            "change": np.repeat(np.array([kind for _, kind, _ in out], object), sizes),
        }
    )


_NONE = np.zeros(0, object)


def listing(snapshots: DataFrame, blocks: int | Column) -> DataFrame:
    """(repo_id, snapshot_no, path, at, value, block): one row per key and snapshot, the newest."""
    return (
        snapshots.select(
            "snapshot_no", "repo_id", plain_path(F.col("path")).alias("path"), F.lower("hash").alias("value"),
            F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("at"),
        )
        .filter(F.col("path").isNotNull() & F.col("snapshot_no").isNotNull() & F.col("repo_id").isNotNull())
        .groupBy("repo_id", "snapshot_no", "path")
        .agg(F.max(F.struct("at", "value")).alias("m"))
        .select("repo_id", "snapshot_no", "path", "m.at", "m.value", F.pmod(F.xxhash64("path"), F.lit(blocks)).cast("int").alias("block"))
    )


def changes(snapshots: DataFrame, deliveries: DataFrame, blocks: int | None = None) -> DataFrame:
    """(snapshot_no, repo_id, path, change) between consecutive complete snapshots.

    ``blocks``: hash blocks per repository, counted from the table if not given. Any
    number gives the same result.
    """
    if blocks is None:
        blocks = max(1, -(-snapshots.count() // BLOCK_ROWS))
    # One row per delivery: far fewer than files, broadcast only if really few.
    order = small_side(delivery_order(deliveries))
    # Repeated rows go before the blocks, in part before the shuffle: a block has one row per key and snapshot.
    rows = listing(snapshots, blocks).join(order, ["repo_id", "snapshot_no"])
    return rows.groupBy("repo_id", "block").applyInPandas(_block_changes, CHANGES)


#: What is kept of the latest delivery of a block.
STATE = "repo_id long, block int, blocks int, snapshot_no int, paths array<string>, bitmap binary, vector array<string>"
_STEP = f"{STATE}, changes array<struct<path: string, change: string>>"


def _apply(key: tuple, state: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """One block's next snapshot. A state row alone means that the delivery has no key of the block, or,
    without a number to go to, that there is no delivery.
    """
    if len(state):
        s = state.iloc[0]
        if pd.isna(s["next"]):
            return state.drop(columns="next").assign(changes=[[]])
        block = Block(s["paths"], Bitmap.from_bytes(s["bitmap"]), list(s["vector"]))
        blocks, number = int(s["blocks"]), int(s["next"])
    else:
        block, blocks, number = Block(), int(rows["blocks"].iloc[0]), int(rows["snapshot_no"].iloc[0])
    values = rows["value"].astype(object)
    got = block.step(rows["path"].to_numpy(object), values.where(values.notna(), None).to_numpy(object))
    known = bool(len(state)) or bool(rows["later"].iloc[0])
    out = [{"path": p, "change": kind} for kind, at in got for p in block.named(at)] if known else []
    return pd.DataFrame([{
        "repo_id": key[0], "block": key[1], "blocks": blocks, "snapshot_no": number, "paths": block.paths,
        "bitmap": block.bitmap.to_bytes(), "vector": block.vector.tolist(), "changes": out,
    }])


def apply_delivery(state: DataFrame | None, rows: DataFrame, deliveries: DataFrame, number: int, blocks: int = 64) -> tuple[DataFrame, DataFrame]:
    """(changes, new state) of delivery ``number`` against the kept state.

    ``state`` has the schema ``STATE``, or is None before the first delivery; it keeps the
    number of blocks it began with, whatever ``blocks`` says later. ``rows`` are listings of
    the new delivery (others are left out); ``deliveries`` all deliveries so far. Groups
    whose delivery is not complete keep their state. Earlier listings are not read.
    """
    done = delivery_order(deliveries).filter(F.col("snapshot_no") == number)
    # Groups have one row each here: a repository's rank says whether it was delivered before.
    here = small_side(done.select("repo_id", (F.col("rank") > 0).alias("later")))
    spark = rows.sparkSession
    if state is None:
        state = spark.createDataFrame([], STATE)
    began = small_side(state.groupBy("repo_id").agg(F.max("blocks").alias("__b")))
    new = rows.filter(F.col("snapshot_no") == number).join(here, "repo_id").join(began, "repo_id", "left")
    later = new.groupBy("repo_id").agg(F.first("later").alias("later"), F.first(F.coalesce("__b", F.lit(blocks))).alias("blocks"))
    new = listing(new, 1).join(small_side(later), "repo_id").withColumn("block", F.pmod(F.xxhash64("path"), F.col("blocks")).cast("int"))
    going = state.join(here.select("repo_id", F.lit(number).alias("next")), "repo_id", "left")
    stepped = cut(
        going.groupBy("repo_id", "block").cogroup(new.groupBy("repo_id", "block")).applyInPandas(_apply, _STEP)
    )
    changed = stepped.select("snapshot_no", "repo_id", F.explode("changes").alias("c")).select("snapshot_no", "repo_id", "c.path", "c.change")
    return changed, stepped.drop("changes")


def summary(changed: DataFrame) -> DataFrame:
    """Counts per repository and snapshot, as in Freshness: added, modified, deleted."""
    count = lambda c: F.count_if(F.col("change") == c).alias(c)
    return changed.groupBy("repo_id", "snapshot_no").agg(count("added"), count("modified"), count("deleted"))

