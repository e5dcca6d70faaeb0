"""The graph store: Parquet versions of one repository behind an atomically replaced pointer.

``<store>/<key>/v-<n>-<token>/{files,extracts,symbols,edges}`` hold a version,
``<store>/<key>/CURRENT`` names the one in force with schema version, extractor stamp and
the repository's root. Readers of an older version are not disturbed by a build; a build
that dies leaves the old version in force.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from graphloom import EXTRACTOR_STAMP, SCHEMA_VERSION

TABLES = ("files", "extracts", "symbols", "edges")


class StoreVersionError(RuntimeError):
    """The store was written by another schema."""


def default_path() -> str:
    base = os.environ.get("XDG_DATA_HOME") or os.path.expanduser("~/.local/share")
    return os.path.join(base, "graphloom")


class Store:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or default_path()
        os.makedirs(self.path, exist_ok=True)

    def _home(self, root: str) -> Path:
        return Path(self.path) / hashlib.sha256(os.path.realpath(root).encode()).hexdigest()[:16]

    def manifest(self, root: str) -> dict | None:
        """Of the version in force; None if there is none. Refuses other schema versions."""
        at = self._home(root) / "CURRENT"
        if not at.exists():
            return None
        m = json.loads(at.read_text())
        if m["schema_version"] != SCHEMA_VERSION:
            raise StoreVersionError(f"store has schema {m['schema_version']}, this is {SCHEMA_VERSION}")
        return m

    def stamp_current(self, root: str) -> bool:
        m = self.manifest(root)
        return bool(m) and m["extractor_stamp"] == EXTRACTOR_STAMP

    def table(self, root: str, name: str) -> DataFrame | None:
        m = self.manifest(root)
        return None if m is None else self.spark.read.parquet(str(self._home(root) / m["name"] / name))

    def publish(self, root: str, tables: dict[str, DataFrame], facts: dict) -> dict:
        """Write all tables, then put them in force; files that the pointer never names are no version."""
        home = self._home(root)
        before = self.manifest(root)
        number = (before["number"] if before else 0) + 1
        name = f"v-{number:06d}-{uuid.uuid4().hex[:8]}"
        for t in TABLES:
            tables[t].write.parquet(str(home / name / t))
        m = {
            "number": number, "name": name, "root": os.path.realpath(root), "schema_version": SCHEMA_VERSION,
            "extractor_stamp": EXTRACTOR_STAMP, "indexed_at": int(time.time()), **facts,
        }
        tmp = home / f"CURRENT.{name}"
        with open(tmp, "w") as f:
            json.dump(m, f)
            f.flush()
            os.fsync(f.fileno())
        if self.manifest(root) != before:
            raise RuntimeError("another build published first; nothing was put in force")
        os.replace(tmp, home / "CURRENT")
        return m

    # -- maintenance

    def roots(self) -> list[str]:
        return sorted(json.loads(p.read_text())["root"] for p in Path(self.path).glob("*/CURRENT"))

    def reset(self, root: str) -> None:
        shutil.rmtree(self._home(root), ignore_errors=True)

    def clear(self) -> None:
        for p in Path(self.path).iterdir():
            shutil.rmtree(p, ignore_errors=True)

    def prune(self) -> list[str]:
        """Drop repositories whose root is gone, and versions that are not in force."""
        gone = [r for r in self.roots() if not os.path.isdir(r)]
        for r in gone:
            self.reset(r)
        for p in Path(self.path).glob("*/CURRENT"):
            keep = json.loads(p.read_text())["name"]
            for v in p.parent.glob("v-*"):
                if v.name != keep:
                    shutil.rmtree(v, ignore_errors=True)
        return gone

    def integrity(self) -> list[str]:
        """What is wrong with the store: pointers that cannot be read or lack tables."""
        bad = []
        for p in Path(self.path).glob("*/CURRENT"):
            try:
                m = json.loads(p.read_text())
                bad += [f"{m['root']}: {t} is missing" for t in TABLES if not (p.parent / m["name"] / t / "_SUCCESS").exists()]
            except (ValueError, KeyError) as e:
                bad.append(f"{p}: {e}")
        return bad

    def recover(self) -> str:
        """Set the whole store aside and begin an empty one; returns where the old one is."""
        aside = f"{self.path.rstrip('/')}.broken-{int(time.time())}"
        os.rename(self.path, aside)
        os.makedirs(self.path)
        return aside
