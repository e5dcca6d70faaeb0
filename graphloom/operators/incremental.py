"""Processing only new or changed records.

The target is the state: every published row carries the key and the version of the
source record it was made from, so the work of the next run is the source anti-joined
with the target. Nothing else (no high-water mark, no queue) has to survive a crash.
:class:`VersionedTarget` publishes each new target version by creating one small file whose
name is the version's number; a run that dies before that leaves the old version in force
and its work comes up again, a run that dies after it has lost nothing. Of two runs that
start from one version only one can create the next file. A version lists the folders it is
made of: a base and the rows that later runs added, so a run writes what it changed.

Nulls and edge cases
* a source row without key or without version cannot be processed and is left out;
* of repeated source rows the newest counts, of equal times the largest version;
* an empty source gives no work, an empty or missing target makes all of it work;
* extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def newest(df: DataFrame, key: str, order: Column, **values: Column) -> DataFrame:
    """One row per key with the values of its newest row; ties go to the largest values."""
    rank = F.max(F.struct(order.alias("__o"), *[c.alias(n) for n, c in values.items()]))
    return df.groupBy(key).agg(rank.alias("__m")).select(key, *[F.col(f"__m.{n}").alias(n) for n in values])


def pending(source: DataFrame, target: DataFrame, key: str, version: str = "version") -> DataFrame:
    """Rows of ``source`` whose (key, version) is not what ``target`` holds for the key.

    Both sides have one row per key. The join hashes on the key alone and compares
    the version as a residual, so it reuses the partitioning that the per-key
    aggregation of either side already has: no second shuffle.
    """
    t = target.select(F.col(key).alias("__k"), F.array(F.col(version)).alias("__v"))
    same = (F.col(key) == F.col("__k")) & F.array_contains(F.col("__v"), F.col(version))
    return source.join(t, same, "left_anti")


def extraction_work(
    files: DataFrame, file_extracts: DataFrame, index_runs: DataFrame, stamp: str
) -> DataFrame:
    """Files that the next run must take: (file_id, hash).

    The current state of a file is its latest scan with a hash; the target holds, per
    file, the version (hash and extractor stamp) of the latest extraction without
    error whose run ended ``ok``. Hex case is folded. Files never scanned with a hash
    are no work; files only in the target are no work.
    """
    current = newest(
        files.filter(F.col("hash").isNotNull() & F.col("file_id").isNotNull()),
        "file_id",
        F.col("scanned_at"),
        hash=F.lower("hash"),
    ).withColumn("version", F.concat_ws("|", F.col("hash"), F.lit(stamp)))
    ok_runs = index_runs.filter(F.col("status") == "ok").select("run_id")
    # Runs are far fewer than attempts; the planner broadcasts them below its own
    # threshold and otherwise uses a skew-aware sort-merge semi join.
    good = file_extracts.filter(F.col("error").isNull() & F.col("hash").isNotNull() & F.col("file_id").isNotNull())
    good = good.join(ok_runs, "run_id", "left_semi")
    done = newest(
        good,
        "file_id",
        F.col("extracted_at"),
        version=F.concat_ws("|", F.lower("hash"), F.coalesce(F.col("extractor_stamp"), F.lit(""))),
    )
    return pending(current, done, "file_id").select("file_id", "hash")


class VersionedTarget:
    """A Parquet target whose versions are published atomically.

    Layout: ``<root>/_versions/<number>`` names the folders of a version in order, each with
    rows (``d-...``) or keys that left (``x-...``); ``<root>/<folder>/`` has the data. The
    last word on a key holds. After ``MAX_PARTS`` folders the next run writes a new base;
    folders that none of the last ``KEEP`` versions needs are removed then.

    ``order``: a column by which a record is newer than another (a scan time). Rows that are
    not newer than what the target holds of their key are late and are no work (of equal
    times the larger version is the newer).
    """

    LOG = "_versions"
    MAX_PARTS, KEEP = 8, 3

    def __init__(self, spark: SparkSession, root: str, key: str, version: str = "version", order: str | None = None):
        self.spark, self.root, self.key, self.version, self.order = spark, root.rstrip("/"), key, version, order
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._fs.mkdirs(self._path(f"{self.root}/{self.LOG}"))

    # -- the log

    def _name(self, number: int) -> str:
        return f"{self.root}/{self.LOG}/{number:010d}"

    def _numbers(self) -> list[int]:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/{self.LOG}"))]
        return sorted(int(n) for n in names if n.isdigit())

    def _read(self, number: int) -> dict:
        stream = self._fs.open(self._path(self._name(number)))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _latest(self) -> dict | None:
        numbers = self._numbers()
        return self._read(numbers[-1]) if numbers else None

    def _commit(self, entry: dict) -> None:
        """Create the file of a version, whole or not at all; fail if it is there."""
        dst, data = self._name(entry["number"]), json.dumps(entry)
        tmp = f"{self.root}/{self.LOG}/.{entry['number']:010d}-{uuid.uuid4().hex[:8]}"
        refused = RuntimeError("another run published first; nothing was put in force")
        if str(self._fs.getUri()).startswith("file:"):
            local = lambda p: self._path(p).toUri().getPath()
            with open(local(tmp), "w") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(local(tmp), local(dst))  # unlike a rename, never replaces a file
            except FileExistsError:
                raise refused from None
            finally:
                os.unlink(local(tmp))
            return
        out = self._fs.create(self._path(tmp), True)
        out.write(bytearray(data.encode()))
        out.close()
        # A rename without overwriting is one step of the file system and refuses an existing name.
        if self._fs.exists(self._path(dst)) or not self._fs.rename(self._path(tmp), self._path(dst)):
            self._fs.delete(self._path(tmp), False)
            raise refused

    # -- content

    def _content(self, parts: list[str]) -> DataFrame | None:
        """The rows of some folders: what is later replaces or removes what is earlier."""
        out = None
        for name in parts:
            df = self.spark.read.parquet(f"{self.root}/{name}")
            if out is None:
                out = df
                continue
            # What a run changed is the small side; the planner broadcasts it by its size on disk.
            out = out.join(df.select(self.key).distinct(), self.key, "left_anti")
            if name.startswith("d-"):
                out = out.unionByName(df, allowMissingColumns=True)
        return out

    def current(self) -> DataFrame | None:
        at = self._latest()
        return None if at is None else self._content(at["parts"])

    def _one(self, rows: DataFrame) -> DataFrame:
        """The newest row per key; of equal ones the largest version."""
        rank = [F.col(self.order)] if self.order else []
        best = F.max_by(F.struct(*rows.columns), F.struct(*rank, F.col(self.version)))
        return rows.groupBy(F.col(self.key).alias("__k")).agg(best.alias("__r")).select("__r.*")

    def pending(self, source: DataFrame) -> DataFrame:
        """New or changed rows of ``source``, one per key.

        Rows without key or version, or late ones, are left out.
        """
        source = self._one(source.filter(F.col(self.key).isNotNull() & F.col(self.version).isNotNull()))
        now = self.current()
        if now is None:
            return source
        if not self.order:
            return pending(source, now, self.key, self.version)
        held = now.select(F.col(self.key).alias("__k"), F.col(self.version).alias("__v"), F.col(self.order).alias("__o"))
        later = F.col("__o").isNull() | F.coalesce(F.col(self.order) > F.col("__o"), F.lit(False))
        later = later | (F.col(self.order).eqNullSafe(F.col("__o")) & (F.col(self.version) > F.col("__v")))
        settled = (F.col("__v") == F.col(self.version)) | ~later
        return source.join(held, (F.col(self.key) == F.col("__k")) & settled, "left_anti")

    def publish(self, rows: DataFrame, drop_missing_from: DataFrame | None = None) -> int:
        """Make ``rows`` the new content of their keys and put the result in force.

        ``drop_missing_from``: a source; keys that it no longer has leave the target.
        Returns the number of the new version.
        """
        at = self._latest()
        number, parts = (at["number"] + 1 if at else 1), list(at["parts"] if at else [])
        mark = f"{number:010d}-{uuid.uuid4().hex[:8]}"
        made: list[str] = []

        def write(kind: str, df: DataFrame) -> None:
            made.append(f"{kind}-{mark}")
            df.write.parquet(f"{self.root}/{made[-1]}")

        try:
            write("d", self._one(rows))
            parts.append(made[-1])
            if drop_missing_from is not None:
                gone = self._content(parts).select(self.key).distinct().join(drop_missing_from.select(self.key), self.key, "left_anti")
                write("x", gone)
                parts.append(made[-1])
            if len(parts) > self.MAX_PARTS:
                write("d-base", self._content(parts))
                parts = [made[-1]]
            self._commit({"number": number, "parts": parts})
        except RuntimeError:
            for name in made:
                self._fs.delete(self._path(f"{self.root}/{name}"), True)
            raise
        for name in set(made) - set(parts):  # has gone into the base
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
        self._clean()
        return number

    def _clean(self) -> None:
        """Remove versions before the last ``KEEP`` and the folders that only they need."""
        numbers = self._numbers()
        old, kept = numbers[: -self.KEEP], numbers[-self.KEEP:]
        needed = {p for n in kept for p in self._read(n)["parts"]}
        for n in old:
            for name in self._read(n)["parts"]:
                if name not in needed:
                    self._fs.delete(self._path(f"{self.root}/{name}"), True)
            self._fs.delete(self._path(self._name(n)), False)
