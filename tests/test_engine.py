"""Build and query small repositories; operators against brute force."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from graphloom.engine import NotIndexed, Repository
from graphloom.functions import text as T
from graphloom.functions.hashing import fnv1a_hex
from graphloom.operators import graph, retrieval, search, traverse
from graphloom.server import Server
from graphloom.sources import repos, scan
from graphloom.sources.store import Store, StoreVersionError


def write(root, files):
    for path, text in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w", newline="") as f:
            f.write(text)


@pytest.fixture
def repo(spark, tmp_path):
    root = tmp_path / "r"
    write(root, {
        ".git/HEAD": "ref", ".gitignore": "out/\n*.skip.py\n!keep.skip.py\n", "out/x.py": "x = 1\n", "a.skip.py": "", "keep.skip.py": "k = 1\n",
        "src/a.ts": "import { helper } from './b.js';\nimport z from 'zed';\nexport class Store {\n  get(n: number) { return helper(n); }\n}\nexport function run(s: Store) { return s.get(1); }\n",
        "src/b.ts": "export function helper(n: number) { return helper(n - 1); }\n",
        "tests/a.test.ts": "import { run } from '../src/a';\nrun(null);\n",
        "go.mod": "module example.com/m\n", "pkg/p.go": "package pkg\n\nfunc P() {}\n", "main.go": "package main\n\nimport \"example.com/m/pkg\"\n\nfunc main() { pkg.P() }\n",
        ".hidden/h.sh": "h() {\n  echo hi\n}\n", "tool": "#!/bin/bash\nt() { echo; }\n", "bad.py": "x\n",
    })
    (root / "bad.py").write_bytes(b"\xff\xfe")
    return Repository(spark, str(root), Store(spark, str(tmp_path / "store")))


def test_scan_honours_ignores_and_encodings(spark, repo):
    rows = {r["path"]: r for r in scan.read_files(spark, repo.root).collect()}
    assert set(rows) == {"keep.skip.py", "src/a.ts", "src/b.ts", "tests/a.test.ts", "pkg/p.go", "main.go", ".hidden/h.sh", "tool"}
    assert rows["tool"]["lang"] == "shell" and rows["src/b.ts"]["hash"] == fnv1a_hex(open(os.path.join(repo.root, "src/b.ts"), "rb").read())


def test_build_query_rebuild(spark, repo):
    with pytest.raises(NotIndexed):
        repo.ensure(refresh=False)
    first = repo.build()
    assert (first.files, first.parsed, first.reused, first.deleted) == (8, 8, 0, 0)
    edges = {(r["kind"], r["src"], r["dst"]) for r in repo._table("edges").collect()}
    names = {r["id"]: r["name"] for r in repo._table("symbols").collect()}
    named = {(k, names[s], names[d]) for k, s, d in edges}
    assert {("calls", "get", "helper"), ("calls", "run", "get"), ("calls", "helper", "helper"), ("imports", "src/a.ts", "src/b.ts"),
            ("imports", "src/a.ts", "zed"), ("imports", "main.go", "pkg/p.go"), ("contains", "Store", "get")} <= named
    assert not any(k == "calls" and d == "P" for k, _, d in named)  # member calls need a known receiver

    got = repo.grep("helper", fixed=True)
    assert got["total"] == 3 and {g["symbol"] for g in got["groups"]} == {None, "get", "helper"} and got["unreadable"] == 0
    assert repo.grep("return", fixed=True, scope="src-extra")["total"] == 0
    with pytest.raises(ValueError):
        repo.grep("(")
    with pytest.raises(ValueError):
        repo.grep("a(?=b)")
    reached = {r["name"]: r["depth"] for r in repo.callers("helper", depth=None)["reached"]}
    assert reached == {"get": 1, "run": 2, "tests/a.test.ts": 3} or reached.get("get") == 1 and reached.get("run") == 2
    assert [r["name"] for r in repo.callers("Store.get", outgoing=True)["reached"]] == ["helper"]
    assert repo.ask("who calls helper?")["mode"] == "structural-callers"
    hits = repo.ask("helper function", source=True)["hits"]
    assert hits[0]["name"] == "helper" and hits[0]["excerpt"].startswith("export function helper")
    assert repo.ask("how is it")["mode"] == "empty" and repo.ask("helper", scope="")["hits"] == []
    assert [s["name"] for s in repo.skeleton("a.ts")["symbols"]] == ["Store", "get", "run"]
    m = repo.map()
    assert m["files"] == 8 and any(d["dir"] == "src/" for d in m["dirs"]) and m["hotspots"]

    ids = {(r["name"], r["kind"]): r["id"] for r in repo._table("symbols").filter("kind <> 'module'").collect()}
    write(repo.root, {"src/b.ts": "export function helper(n: number) { return n; }\nexport function more() {}\n", "src/c.py": "def c(): pass\n"})
    os.remove(os.path.join(repo.root, "tool"))
    f = repo.freshness()
    assert (f["added"], f["modified"], f["deleted"]) == (["src/c.py"], ["src/b.ts"], ["tool"]) and not f["clean"]
    second = repo.build()
    assert (second.files, second.parsed, second.reused, second.deleted) == (8, 2, 6, 1)
    after = {(r["name"], r["kind"]): r["id"] for r in repo._table("symbols").filter("kind <> 'module'").collect()}
    assert all(after[k] == v for k, v in ids.items() if k in after)
    assert repo.freshness()["clean"]

    # incremental = from scratch, up to file numbers
    def plain(r):
        n = {x["id"]: (x["name"], x["kind"]) for x in r._table("symbols").collect()}
        return sorted((e["kind"], n[e["src"]], n[e["dst"]]) for e in r._table("edges").collect())

    scratch = Repository(spark, repo.root, Store(spark, repo.store.path + "2"))
    scratch.build(tasks=3)
    assert plain(repo) == plain(scratch)


def test_store_version_and_maintenance(spark, tmp_path):
    write(tmp_path / "r", {"a.py": "def a(): pass\n"})
    store = Store(spark, str(tmp_path / "s"))
    r = Repository(spark, str(tmp_path / "r"), store)
    r.build()
    assert store.integrity() == [] and store.roots() == [r.root]
    at = next((tmp_path / "s").glob("*/CURRENT"))
    m = json.loads(at.read_text())
    at.write_text(json.dumps(m | {"extractor_stamp": "old"}))
    assert not r.freshness()["clean"] and r.build().parsed == 1
    at.write_text(json.dumps(m | {"schema_version": 99}))
    with pytest.raises(StoreVersionError):
        r.status()
    os.rename(tmp_path / "r", tmp_path / "moved")
    at.write_text(json.dumps(m))
    assert store.prune() == [r.root] and store.roots() == []
    assert os.path.isdir(store.recover())


def test_server(spark, repo):
    server = Server(spark, repo.root, repo.store)
    ask = lambda **m: server.handle(json.dumps({"jsonrpc": "2.0", "id": 1, **m}))
    assert ask(method="initialize")["result"]["serverInfo"]["name"] == "graphloom"
    assert len(ask(method="tools/list")["result"]["tools"]) == 7
    call = lambda name, **a: ask(method="tools/call", params={"name": name, "arguments": a})
    answer = json.loads(call("find", query="helper", limit="many")["result"]["content"][0]["text"])
    assert answer["r"]["hits"][0]["name"] == "helper" and "savings" in answer
    assert call("find")["error"]["code"] == -32000 and call("nope")["error"]["code"] == -32000
    assert server.handle("{")["error"]["code"] == -32700 and server.handle("[]")["error"]["code"] == -32600
    assert ask(method="zzz")["error"]["code"] == -32601 and server.handle('{"method":"x"}') is None
    off = Server(spark, repo.root, Store(spark, repo.store.path + "off"), refresh=False)
    assert off.handle('{"id":1,"method":"tools/call","params":{"name":"map"}}')["error"]["code"] == -32001


def test_exports(spark, repo, tmp_path):
    from graphloom.sinks import cards

    repo.build()
    f, s = repo._table("files"), repo._table("symbols")
    n = cards.export_markdown(f, s, str(tmp_path / "md"))
    assert n == 8 and "- `L6-L6` function `run`" in "".join(p.read_text() for p in (tmp_path / "md/files").iterdir())
    with pytest.raises(FileExistsError):
        cards.export_markdown(f, s, str(tmp_path / "md"))
    cards.export_json(f, s, str(tmp_path / "g.json"))
    assert len(json.loads((tmp_path / "g.json").read_text())) == 8
    assert "Hotspots" in cards.page("<r>", repo.map()) and "&lt;r&gt;" in cards.page("<r>", repo.map())
    with pytest.raises(PermissionError):
        cards.serve("0.0.0.0:0", "x")


def test_discovery(tmp_path):
    for name in ("one", "two"):
        write(tmp_path, {f"ws/{name}/.git/HEAD": "x", f"ws/{name}/a.py": ""})
    write(tmp_path, {"plain/a.py": "", "wt/.git": f"gitdir: {tmp_path}/ws/one/.git/worktrees/wt\n", "ws/one/.git/worktrees/wt/HEAD": "x",
                     "ws/one/.git/worktrees/wt/commondir": "../..\n"})
    assert [t.label for t in repos.targets(tmp_path / "ws")] == ["one", "two"]
    assert repos.root_of(tmp_path / "ws/one/a.py").name == "one"
    assert [t.root for t in repos.targets(tmp_path / "plain")] == [str((tmp_path / "plain").resolve())] and repos.automatic_targets(tmp_path / "plain") == []
    assert repos.common_dir(tmp_path / "wt") == repos.common_dir(tmp_path / "ws/one")
    found = repos.targets(tmp_path / "ws")
    assert repos.target_scope(found, "two/src")[1] == "src" and repos.target_scope(found, "")[1] is None
    with pytest.raises(ValueError):
        repos.target_scope(found, "three")


def test_text_functions(spark):
    row = lambda c, **v: spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} string" for k in v)).select(c.alias("x")).first()["x"]
    assert row(T.terms(F.col("t")), t="How does serverEntry work?") == ["server", "entry", "work"]
    assert row(T.terms(F.col("t")), t=None) == []
    assert T.query_terms("How does serverEntry work?", spark) == ["server", "entry", "work"]
    assert row(T.normalize_path(F.col("t")), t="a/./b//../../../c/d") == "c/d"
    assert row(T.lines(F.col("t")), t="a\r\nb\n") == ["a", "b"] and row(T.lines(F.col("t")), t="") == []
    assert row(T.excerpt(F.col("t"), F.lit(2), F.lit(3)), t="1\n2\n3\n4") == "2\n3"
    assert row(T.language(F.col("t")), t="x/y.d.ts") is None and row(T.language(F.col("t")), t="a.MJS") is None
    assert row(T.shebang_language(F.col("t"), F.lit("#!/usr/bin/env bash\n")), t="bin/run") == "shell"
    assert row(T.grouped(F.lit(1234567)), t="") == "1,234,567" and row(T.estimated_tokens(F.lit(5)), t="") == 2
    assert fnv1a_hex(b"") == "cbf29ce484222325"
    assert retrieval.structural_subject("What does Foo.bar call?") == ("Foo.bar", True)
    assert retrieval.structural_subject("what is X") is None


def test_interval_attribution_against_brute_force(spark):
    rng = random.Random(1)
    spans, hits = [], []
    for f in range(3):
        for i in range(60):
            a = rng.randint(1, 400)
            spans.append((f, f * 1000 + i, a, a + rng.choice([0, 3, 40, 300])))
        hits += [(f, "p", n, "t") for n in rng.sample(range(1, 700), 80)]
    h = spark.createDataFrame(hits, "file_id long, path string, line long, text string")
    s = spark.createDataFrame(spans, "file_id long, id long, start_line long, end_line long")
    got = {(r["file_id"], r["line"]): r["symbol"] for r in search.attribute(h, s).collect()}
    for f, _, n, _ in hits:
        fits = [(e - a, i) for g, i, a, e in spans if g == f and a <= n <= e]
        assert got[f, n] == (min(fits)[1] if fits else None)


def test_reach_on_a_cycle_and_partitions(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (1, 4)]
    df = spark.createDataFrame([(a, b, "calls") for a, b in edges], "src long, dst long, kind string")
    start = spark.createDataFrame([(1,)], "id long")
    for parts in (1, 5):
        got = {(r["id"], r["depth"]) for r in traverse.reach(df.repartition(parts), start, True, None).collect()}
        assert got == {(2, 1), (4, 1), (3, 2)}
    assert traverse.reach(df, start, True, 1).count() == 2 and traverse.reach(df.limit(0), start).count() == 0


def test_rust_candidates(spark):
    got = lambda p, s: spark.createDataFrame([(p, s)], "p string, s string").select(graph.rust_candidates(F.col("p"), F.col("s")).alias("x")).first()["x"]
    assert got("src/a/b.rs", "crate::db::helper")[:3] == ["src/db/helper.rs", "src/db/helper/mod.rs", "src/db.rs"]
    assert got("src/a/b.rs", "std::fs") == [] and got("src/a.rs", "db") == ["src/db.rs", "src/db/mod.rs"]


def test_streaming_refresh_is_exactly_once(spark, tmp_path):
    import datetime as dt

    from graphloom.operators.incremental import VersionedTarget
    from graphloom.streaming import refresh

    target = VersionedTarget(spark, str(tmp_path / "t"), "file_id", order="scanned_at")
    rows = lambda *r: spark.createDataFrame([(*x, dt.datetime(2025, 1, 1)) for x in r], refresh.SCHEMA).coalesce(1)
    rows((1, "python", "def a(): pass\n", "h1"), (2, "python", "x = 1\n", "h2")).write.parquet(str(tmp_path / "in"))
    refresh.start(spark, str(tmp_path / "in"), target, str(tmp_path / "c")).awaitTermination()
    assert target.current().count() == 2
    rows((1, "python", "def b(): pass\n", "h3"), (2, "python", "x = 1\n", "h2"), (None, None, None, None)).write.mode("append").parquet(str(tmp_path / "in"))
    refresh.start(spark, str(tmp_path / "in"), target, str(tmp_path / "c")).awaitTermination()
    now = {r["file_id"]: [s["name"] for s in r["symbols"]] for r in target.current().collect()}
    assert now == {1: ["b"], 2: []}
    assert refresh.refresh_batch(spark.read.parquet(str(tmp_path / "in")).filter("hash <> 'h1'"), target) == 0


def test_late_scans_do_not_overwrite_newer_ones(spark, tmp_path):
    import datetime as dt

    from graphloom.operators.incremental import VersionedTarget
    from graphloom.streaming import refresh

    target = VersionedTarget(spark, str(tmp_path / "t"), "file_id", order="scanned_at")
    batch = lambda h, day: spark.createDataFrame([(1, "python", f"def {h}(): pass\n", h, dt.datetime(2025, 1, day))], refresh.SCHEMA)
    assert refresh.refresh_batch(batch("b", 2), target) == 1
    assert refresh.refresh_batch(batch("a", 1), target) == 0
    assert [r["version"].split("|")[0] for r in target.current().collect()] == ["b"]
    assert refresh.refresh_batch(batch("c", 3), target) == 1
    assert [(r["version"].split("|")[0], r["symbols"][0]["name"]) for r in target.current().collect()] == [("c", "c")]
