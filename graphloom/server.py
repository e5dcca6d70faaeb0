"""A line-delimited JSON-RPC server with the engine's questions as tools."""

from __future__ import annotations

import json
import sys
import threading
from dataclasses import dataclass, field
from typing import IO

from pyspark.sql import SparkSession

from graphloom import __version__
from graphloom.engine import MAX_DEPTH, NotIndexed, Repository
from graphloom.sources import repos
from graphloom.sources.store import Store

#: Bytes of one message, in and out.
MAX_MESSAGE = 1 << 20
BYTES_PER_TOKEN = 4

#: Tool, what it answers, required argument.
TOOLS = [
    ("find", "Ranked definitions for a question, with spans, signatures and an excerpt.", "query"),
    ("grep", "Every matching line of the indexed sources, by enclosing definition.", "pattern"),
    ("callers", "What depends on a symbol, or what it depends on, to any depth.", "symbol"),
    ("skeleton", "The definitions of one file in order.", "file"),
    ("map", "Folders, hubs and hotspots of a repository.", None),
    ("status", "Counts of the index and its freshness.", None),
    ("freshness", "Differences between the index and the live sources; builds nothing.", None),
]


class Refused(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def option(args: dict, name: str, default):
    """An optional argument; one of another type is taken as missing."""
    value = args.get(name)
    if isinstance(default, bool):
        return value if isinstance(value, bool) else default
    if isinstance(default, int):
        return value if isinstance(value, int) and not isinstance(value, bool) and value >= 0 else default
    return value if isinstance(value, str) else default


def paths_in(value) -> set[str]:
    if isinstance(value, dict):
        own = {value["path"]} if isinstance(value.get("path"), str) else set()
        return own.union(*[paths_in(v) for v in value.values()])
    if isinstance(value, list):
        return set().union(*[paths_in(v) for v in value])
    return set()


@dataclass
class Session:
    """Tokens saved so far, per connection."""

    saved: int = 0
    calls: int = 0
    lock: threading.Lock = field(default_factory=threading.Lock)


class Server:
    def __init__(self, spark: SparkSession, start: str, store: Store | None = None, refresh: bool = True):
        self.spark, self.store, self.refresh = spark, store or Store(spark), refresh
        self.targets = repos.targets(start)
        self.session = Session()
        self._indexing: threading.Thread | None = None

    def _select(self, name: str | None) -> list[repos.Target]:
        if name is None:
            return self.targets
        found = [t for t in self.targets if t.label == name]
        if not found:
            raise Refused(-32000, f"no repository {name!r}")
        return found

    def start_indexing(self) -> None:
        """In the background; the first call waits for it."""
        def run() -> None:
            for t in self.targets:
                try:
                    Repository(self.spark, t.root, self.store).ensure()
                except Exception:  # noqa: BLE001  the call itself will report it
                    pass

        if self.refresh and self._indexing is None:
            self._indexing = threading.Thread(target=run, daemon=True)
            self._indexing.start()

    def call(self, name: str, args: dict) -> dict:
        required = {n: r for n, _, r in TOOLS}
        if name not in required:
            raise Refused(-32000, f"unknown tool: {name}")
        if required[name] and not isinstance(args.get(required[name]), str):
            raise Refused(-32000, f"missing argument: {required[name]}")
        if self._indexing is not None:
            self._indexing.join()
            self._indexing = None
        answer, size = {}, 0
        for t in self._select(args.get("repo") if isinstance(args.get("repo"), str) else None):
            r = Repository(self.spark, t.root, self.store, t.label)
            if name == "freshness":
                answer[t.label] = r.freshness()
                continue
            try:
                r.ensure(self.refresh)
            except NotIndexed as e:
                raise Refused(-32001, str(e)) from None
            scope = option(args, "in", None) if isinstance(args.get("in"), str) else None
            if name == "find":
                value = r.ask(args["query"], option(args, "limit", 8), scope, option(args, "source", True), option(args, "full", False))
            elif name == "grep":
                value = r.grep(args["pattern"], option(args, "fixed", False), option(args, "ignoreCase", False), scope)
            elif name == "callers":
                value = r.callers(args["symbol"], args.get("direction") == "out", min(option(args, "depth", 1), MAX_DEPTH), scope)
            elif name == "skeleton":
                value = r.skeleton(args["file"])
            elif name == "map":
                value = r.map()
            else:
                value = {"root": t.root, "store": r.status(), "freshness": r.freshness()}
            if name in ("find", "grep", "callers", "skeleton", "map"):
                found = paths_in(value)
                size += r.sizes(found)[0] if found else 0
            answer[t.label] = value
        return self._with_savings(answer, size)

    def _with_savings(self, answer: dict, baseline: int) -> dict:
        """Estimated tokens that the answer spared against reading the files it names."""
        if not baseline:
            return answer
        whole = -(-baseline // BYTES_PER_TOKEN)
        for _ in range(4):  # the note is part of what it measures
            used = -(-len(json.dumps(answer, ensure_ascii=False).encode()) // BYTES_PER_TOKEN)
            saved = max(0, whole - used)
            note = {"baseline_tokens": whole, "response_tokens": used, "saved_tokens": saved, "percent": saved * 100 // whole}
            if answer.get("savings") == note:
                break
            answer["savings"] = note
        with self.session.lock:
            if answer["savings"]["saved_tokens"]:
                self.session.saved += answer["savings"]["saved_tokens"]
                self.session.calls += 1
        return answer

    def handle(self, line: str) -> dict | None:
        """The reply to one message; None for notifications."""
        if len(line.encode()) > MAX_MESSAGE:
            return self._error(None, -32600, "message too large")
        try:
            message = json.loads(line)
        except ValueError as e:
            return self._error(None, -32700, f"parse error: {e}")
        if not isinstance(message, dict) or not isinstance(message.get("method"), str):
            return self._error(message.get("id") if isinstance(message, dict) else None, -32600, "invalid request")
        method, ident = message["method"], message.get("id")
        if "id" not in message:
            return None
        params = message.get("params") if isinstance(message.get("params"), dict) else {}
        try:
            if method == "initialize":
                result = {
                    "protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}},
                    "serverInfo": {"name": "graphloom", "version": __version__},
                }
            elif method == "ping":
                result = {}
            elif method == "tools/list":
                result = {"tools": [
                    {"name": n, "description": d, "inputSchema": {"type": "object", "properties": {r: {"type": "string"}} if r else {}, "required": [r] if r else []}}
                    for n, d, r in TOOLS
                ]}
            elif method == "tools/call":
                args = params.get("arguments") if isinstance(params.get("arguments"), dict) else {}
                text = json.dumps(self.call(str(params.get("name")), args), ensure_ascii=False, default=str)
                if len(text.encode()) > MAX_MESSAGE:
                    raise Refused(-32000, "the answer is too large; narrow the question")
                result = {"content": [{"type": "text", "text": text}]}
            else:
                return self._error(ident, -32601, f"method not found: {method}")
        except Refused as e:
            return self._error(ident, e.code, str(e))
        except Exception as e:  # noqa: BLE001
            return self._error(ident, -32000, str(e)[:2000])
        return {"jsonrpc": "2.0", "id": ident, "result": result}

    @staticmethod
    def _error(ident, code: int, message: str) -> dict:
        return {"jsonrpc": "2.0", "id": ident, "error": {"code": code, "message": message}}

    def run(self, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
        for line in source:
            if not line.strip():
                continue
            reply = self.handle(line)
            if reply is not None:
                sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
                sink.flush()
            if '"initialize"' in line:
                self.start_indexing()
