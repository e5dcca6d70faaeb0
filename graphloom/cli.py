"""Command line: python -m graphloom.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from graphloom.engine import NotIndexed, Repository
from graphloom.runtime import local_session
from graphloom.sources import repos
from graphloom.sources.store import Store


def depth(text: str) -> int | None:
    """A number from 1, or ``all``."""
    if text == "all":
        return None
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("depth is a number from 1, or all")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom")
    p.add_argument("--store")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: tuple, **flags):
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        s.add_argument("--path", default=".")
        s.add_argument("--in", dest="scope")
        s.add_argument("--no-refresh", action="store_true")
        for f, kw in flags.items():
            s.add_argument(f"--{f.replace('_', '-')}", **kw)
        return s

    flag = {"action": "store_true"}
    add("build", jobs={"type": int})
    add("ask", "query", limit={"type": int, "default": 8}, source=flag, full=flag)
    add("grep", "pattern", fixed=flag, ignore_case=flag)
    add("callers", "symbol", depth={"type": depth, "default": 1}, direction={"choices": ["in", "out"], "default": "in"})
    add("skeleton", "file")
    add("map", top={"type": int, "default": 12})
    add("status")
    add("check")
    add("export", "destination", json=flag, force=flag)
    add("viz", out={"default": None}, bind={"default": None}, allow_remote=flag)
    add("serve")
    add("cache", "action")
    return p


def interleaved(answers: dict[str, dict], limit: int) -> list[dict]:
    """Hits of several repositories in turn, each with its label."""
    lists = [[{"repo": label, **h} for h in a["hits"]] for label, a in answers.items()]
    turns = max(map(len, lists), default=0)
    return [x[i] for i in range(turns) for x in lists if i < len(x)][: max(1, limit)]


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = local_session()
    store = Store(spark, a.store)
    if a.command == "cache":
        actions = {"clear": store.clear, "prune": store.prune, "doctor": store.integrity, "recover": store.recover,
                   "reset": lambda: store.reset(str(repos.root_of(a.path)))}
        print(json.dumps(actions[a.action](), default=str))
        return 0
    if a.command == "serve":
        from graphloom.server import Server

        Server(spark, a.path, store, not a.no_refresh).run()
        return 0
    found, scope = repos.target_scope(repos.targets(a.path), a.scope)
    all_ = {t.label: Repository(spark, t.root, store, t.label) for t in found}
    try:
        if a.command == "check":
            states = {k: r.freshness() for k, r in all_.items()}
            print(json.dumps(states))
            return 2 if not all(s["indexed"] for s in states.values()) else int(not all(s["clean"] for s in states.values()))
        if a.command == "build":
            print(json.dumps({k: r.build(a.jobs).__dict__ for k, r in all_.items()}))
            return 0
        for r in all_.values():  # any repository that cannot be asked ends the whole question
            r.ensure(not a.no_refresh)
        if a.command == "export":
            from graphloom.sinks import cards

            r = next(iter(all_.values()))
            f, s = r._table("files"), r._table("symbols")
            (cards.export_json if a.json else cards.export_markdown)(f, s, a.destination, a.force)
            return 0
        if a.command == "viz":
            from graphloom.sinks import cards

            r = next(iter(all_.values()))
            body = cards.page(r.label, r.map(100))
            if a.out:
                with open(a.out, "w", encoding="utf-8") as out:
                    out.write(body)
                return 0
            server = cards.serve(a.bind or "127.0.0.1:8765", body, a.allow_remote)
            print(f"http://{server.server_address[0]}:{server.server_address[1]}/")
            server.serve_forever()
            return 0
        ask = {
            "ask": lambda r: r.ask(a.query, a.limit, scope, a.source, a.full),
            "grep": lambda r: r.grep(a.pattern, a.fixed, a.ignore_case, scope),
            "callers": lambda r: r.callers(a.symbol, a.direction == "out", a.depth, scope),
            "skeleton": lambda r: r.skeleton(a.file),
            "map": lambda r: r.map(a.top),
            "status": lambda r: r.status(),
        }[a.command]
        answers = {k: ask(r) for k, r in all_.items()}
        if a.command == "ask" and len(answers) > 1:
            answers = {"hits": interleaved(answers, a.limit)}
        print(json.dumps(answers, ensure_ascii=False, default=str))
        return 0
    except (NotIndexed, ValueError, KeyError, FileExistsError, PermissionError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2 if isinstance(e, NotIndexed) else 1


if __name__ == "__main__":
    sys.exit(main())
