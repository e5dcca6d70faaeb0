"""Build and query one repository: the operators over the store.

Extraction is incremental by content hash; names are always resolved over the whole
repository. All answers are small and come from DataFrame plans; results are plain
dictionaries, as the server and the command line print them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import freshness as fresh
from graphloom.operators import graph, rank, retrieval, search, traverse
from graphloom.runtime import cut
from graphloom.sources import repos, scan
from graphloom.sources.store import Store

MAX_DEPTH = 32


class NotIndexed(RuntimeError):
    pass


@dataclass
class BuildStats:
    files: int
    symbols: int
    edges: int
    unresolved: int
    parsed: int
    reused: int
    deleted: int


class Repository:
    def __init__(self, spark: SparkSession, root: str, store: Store | None = None, label: str | None = None):
        self.spark, self.root = spark, str(repos.root_of(root))
        self.store = store or Store(spark)
        self.label = label or self.root.rsplit("/", 1)[-1]

    # -- building

    def build(self, tasks: int | None = None) -> BuildStats:
        """``tasks``: partitions of reading and extraction; the result does not depend on it."""
        live = cut(scan.read_files(self.spark, self.root, tasks=tasks))
        stored = self.store.table(self.root, "files") if self.store.stamp_current(self.root) else None
        if stored is None:
            stored = self.spark.createDataFrame([], "file_id bigint, path string, hash string")
            kept = None
        else:
            kept = self.store.table(self.root, "extracts")
        before = stored.select("file_id", "path", F.col("hash").alias("old_hash"))
        # New paths get the next numbers in path order; the listing is on the driver anyway.
        known = {r["path"] for r in before.select("path").toLocalIterator()}
        top = before.agg(F.max("file_id")).first()[0] or 0
        fresh_paths = sorted(r["path"] for r in live.select("path").toLocalIterator() if r["path"] not in known)
        numbered = self.spark.createDataFrame(
            [(p, top + i) for i, p in enumerate(fresh_paths, 1)], "path string, new_id bigint"
        )
        rows = live.join(before, "path", "left").join(numbered, "path", "left")
        files = cut(rows.select(
            F.lit(1).cast("long").alias("repo_id"), F.coalesce("file_id", "new_id").alias("file_id"), "path", "lang", "mtime", "size",
            "hash", "text", F.coalesce(F.col("hash") == F.col("old_hash"), F.lit(False)).alias("same"),
        ))
        todo = files.filter("not same")
        if tasks:
            todo = todo.repartition(tasks)
        new = graph.extract_files(todo)
        reused = 0
        if kept is not None:
            again = kept.join(files.filter("same").select("file_id"), "file_id", "left_semi")
            reused = again.count()
            new = new.unionByName(again)
        extracts = cut(new)
        module = repos.go_module(self.root)
        modules = self.spark.createDataFrame([(1, module)], "repo_id long, module string") if module else None
        built = graph.build(files, extracts, modules)
        symbols, edges = cut(built["symbols"]), cut(built["edges"])
        total = files.count()
        stats = BuildStats(
            total, symbols.count(), edges.count(), built["sites"].filter(F.col("dst").isNull()).count(), total - reused, reused,
            fresh.deleted(stored, live).count(),
        )
        self.store.publish(
            self.root, {"files": files.drop("text", "same"), "extracts": extracts, "symbols": symbols, "edges": edges},
            {"common_dir": repos.common_dir(self.root), **stats.__dict__},
        )
        return stats

    def ensure(self, refresh: bool = True) -> None:
        """Build if there is no index or, with ``refresh``, if it is not clean."""
        if self.store.manifest(self.root) is None:
            if not refresh:
                raise NotIndexed(f"{self.root} is not indexed and automatic indexing is off")
            self.build()
        elif refresh and not self.freshness()["clean"]:
            self.build()

    def _table(self, name: str) -> DataFrame:
        t = self.store.table(self.root, name)
        if t is None:
            raise NotIndexed(f"{self.root} is not indexed")
        if not self.store.stamp_current(self.root):
            raise NotIndexed(f"the index of {self.root} was made by another extractor")
        return t

    def _texts(self, paths: list[str] | None = None, scope: str | None = None) -> DataFrame:
        """Live texts of the indexed files (of ``paths``, or in a scope), with their file_id."""
        files = self._table("files").select("file_id", "path").filter(T.path_in_scope(F.col("path"), scope))
        if paths is not None:
            files = files.filter(F.col("path").isin(paths))
        live = scan.read_files(self.spark, self.root, [r["path"] for r in files.select("path").toLocalIterator()])
        return live.join(files, "path")

    # -- questions

    def freshness(self) -> dict:
        stored = self.store.table(self.root, "files")
        if stored is None:
            return fresh.summary(self.spark.createDataFrame([], "path string, change string"), indexed=False)
        live = scan.read_files(self.spark, self.root).select("path", "hash")
        return fresh.summary(fresh.diff(stored.select("path", "hash"), live), True, self.store.stamp_current(self.root))

    def status(self) -> dict:
        m = self.store.manifest(self.root)
        if m is None:
            return {"root": self.root, "indexed": False}
        if not self.store.stamp_current(self.root):
            return {"root": self.root, "indexed": False, "stamp": m["extractor_stamp"], "indexed_at": m["indexed_at"]}
        row = rank.status(self._table("files"), self._table("symbols"), self._table("edges")).first()
        counts = row.asDict() if row else {"files": 0, "symbols": 0, "edges": 0}
        counts.pop("repo_id", None)
        return {"root": self.root, "indexed": True, "stamp": m["extractor_stamp"], "indexed_at": m["indexed_at"], **counts}

    def ask(self, query: str, limit: int = 8, scope: str | None = None, source: bool = False, full: bool = False) -> dict:
        note = None
        subject = retrieval.structural_subject(query)
        if subject:
            name, outgoing = subject
            got = self.callers(name, outgoing, 1, scope)
            if got["seeds"] and got["reached"]:
                hits = [{**r, "score": 1.0 / r["depth"]} for r in got["reached"]][: max(1, limit)]
                return {"mode": "structural-callees" if outgoing else "structural-callers", "hits": hits}
            note = f"no {'callees' if outgoing else 'callers'} of {name!r} are known; ranked by words instead"
        if not T.query_terms(query, self.spark):
            return {"mode": "empty", "hits": [], "note": note}
        symbols = self._table("symbols").filter(F.col("kind") != "module")
        docs = (
            rank.with_degree(symbols, self._table("edges")).join(self._table("files").select("file_id", "path"), "file_id")
            .select("id", "name", "path", F.coalesce("signature", F.lit("")).alias("signature"),
                    F.coalesce("summary", F.lit("")).alias("body"), "start_line", "in_edges", "end_line", "kind", "container")
        )
        best = retrieval.rank(docs, query, limit, scope)
        rows = best.join(docs.select("id", "kind", "end_line", "signature", "container", "in_edges"), "id").orderBy(
            F.desc("score"), "path", "start_line", "id"
        )
        hits = [r.asDict() for r in rows.collect()]
        if source and hits:
            texts = {r["path"]: r["text"] for r in self._texts(sorted({h["path"] for h in hits})).select("path", "text").collect()}
            for h in hits:
                lines = texts.get(h["path"], "").replace("\r\n", "\n").split("\n")
                stop = h["end_line"] if full else min(h["end_line"], h["start_line"] + 7)
                h["excerpt"] = "\n".join(lines[h["start_line"] - 1:stop])
        return {"mode": "lexical", "hits": hits, **({"note": note} if note else {})}

    def grep(self, pattern: str, fixed: bool = False, ignore_case: bool = False, scope: str | None = None) -> dict:
        T.pattern(pattern, fixed, ignore_case)  # a bad pattern fails before anything runs
        files = self._table("files").filter(T.path_in_scope(F.col("path"), scope))
        # Files are searched as they are read; only their matching lines are kept.
        found = cut(search.matches_by_file(self._texts(scope=scope), pattern, fixed, ignore_case))
        hits = found.select("file_id", "path", F.explode("lines").alias("x")).select("file_id", "path", "x.line", "x.text")
        groups = search.grouped(hits, self._table("symbols"), self._table("edges"))
        rows = groups.orderBy(F.desc("in_edges"), "path", F.coalesce("start_line", F.lit(0))).collect()
        out = [
            {"path": r["path"], "symbol": r["name"], "kind": r["kind"], "in_edges": r["in_edges"],
             "lines": [{"line": x["line"], "text": x["text"]} for x in r["lines"]]}
            for r in rows
        ]
        return {"total": sum(len(g["lines"]) for g in out), "groups": out, "unreadable": files.count() - found.count()}

    def callers(self, symbol: str, outgoing: bool = False, depth: int | None = 1, scope: str | None = None) -> dict:
        symbols, edges, files = self._table("symbols"), self._table("edges"), self._table("files")
        start = traverse.seeds(symbols, symbol).join(files.select("file_id", "path"), "file_id").filter(
            T.path_in_scope(F.col("path"), scope)
        ).select("id", "name", "kind", "path", "start_line")
        reached = traverse.callers(symbols, edges, files, symbol, outgoing, depth, scope)
        return {
            "seeds": [r.asDict() for r in start.orderBy("path", "start_line", "id").collect()],
            "reached": [r.asDict() for r in reached.orderBy("depth", "path", "start_line", "id").collect()],
        }

    def skeleton(self, path: str) -> dict:
        found = rank.outline_path(self._table("files"), path)
        if found is None:
            raise KeyError(f"no unique indexed file matches {path!r}")
        rows = rank.outline(self._table("symbols"), self._table("files"), found).orderBy("rank").collect()
        return {"path": found, "symbols": [{k: r[k] for k in ("name", "kind", "start_line", "end_line", "signature", "container")} for r in rows]}

    def map(self, top: int = 12) -> dict:
        return rank.repo_map(self._table("files"), self._table("symbols"), self._table("edges"), top)

    def sizes(self, paths: set[str]) -> tuple[int, int]:
        """(bytes, files) of the indexed files of an answer."""
        row = self._table("files").filter(F.col("path").isin(sorted(paths))).agg(F.sum("size"), F.count(F.lit(1))).first()
        return int(row[0] or 0), int(row[1])
