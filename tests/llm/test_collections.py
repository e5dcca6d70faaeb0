"""Term scores, files nobody wrote by hand, abusive texts, failing files."""

import random

import pytest

from graphloom.llm import handwritten, parsing, terms

DOCS = (
    "id long, name_terms array<struct<term:string,tf:int>>, signature_terms array<struct<term:string,tf:int>>,"
    "body_terms array<struct<term:string,tf:int>>, term string"
)


def test_scores_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        f = lambda: rng.choice([None, [], [(rng.choice("abcdefgh"), rng.randint(1, 5)) for _ in range(rng.randint(1, 6))]])
        rows.append((i, f(), f(), [*(f() or []), ("everywhere", 3), None, (None, 2), ("zero", 0)], "clash"))
    rows += rows[:10]
    rows += [(None, None, None, [("a", 1)], "x"), (99, None, None, None, None)]
    cells, seen = {}, set()
    for i, *fields, _ in rows:
        if i is None or i in seen:
            continue
        seen.add(i)
        for f in fields:
            for t in f or []:
                if t and t[0] and t[1] > 0:
                    cells[i, t[0]] = cells.get((i, t[0]), 0) + t[1]
    n = sum(cells.values())
    r, c = {}, {}
    for (i, t), o in cells.items():
        r[i], c[t] = r.get(i, 0) + o, c.get(t, 0) + o
    want = {(i, t): (o - r[i] * c[t] / n) / (r[i] * c[t] / n * (1 - r[i] / n) * (1 - c[t] / n)) ** 0.5 for (i, t), o in cells.items()}
    df = spark.createDataFrame(rows, DOCS)
    got = {(x["id"], x["term"]): x["score"] for x in terms.distinctiveness(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    probes = spark.createDataFrame([(3,), (5,), (99,), (12345,)], "id long")
    best = {x["id"]: x["term"] for x in terms.most_distinctive(df, probes).collect()}
    assert best == {i: min((-s, t) for (j, t), s in want.items() if j == i)[1] for i in (3, 5)}
    assert terms.distinctiveness(df.limit(0)).count() == 0
    one = spark.createDataFrame([(1, [("a", 2)], None, None, None)], DOCS)
    assert [x["score"] for x in terms.distinctiveness(one).collect()] == [0.0]


HAND = "import os\n\n\ndef read(path):\n    # generated by hand, do not panic\n    with open(path) as f:\n        return [x for x in f if x]\n\n\nclass A:\n    pass\n"


@pytest.mark.parametrize("text,bit", [
    ("// Code generated by tool v1. DO NOT EDIT.\n\npackage a\n", handwritten.GENERATED),
    ("# @generated by x\nx = 1\n", handwritten.GENERATED),
    ("#!/bin/sh\n# Diese Datei wurde von x erzeugt, nicht von Hand aendern.\n:\n", handwritten.GENERATED),
    ("/*!\n * lib v1.2.3\n * (c) the lib authors, released under the MIT license\n */\nvar a = 1;\n", handwritten.VENDORED),
    ("/* lib 1.18.0 | BSD-2-Clause | https://lib.example/license */\nvar a = 1;\n", handwritten.VENDORED),
    ("# Copied from lib 0.9.1 without changes, see LICENSES.\nx = 1\n", handwritten.VENDORED),
    ("!function(e,t,n){" + "var a=n(1),b=function(e){return e?t.x(n):!0};e.p=a&&b;" * 20 + "}(1,2,3);\n", handwritten.MINIFIED),
    ("TABLE = [\n" + "    0x1f, 0x2a, 0x33, 0x04,\n" * 60 + "]\n", handwritten.DATA),
    ("const BLOB = \"" + "aB3dE5gH7jK9mN1pQ+/" * 60 + "\";\n", handwritten.DATA),
    ("".join(f"export function getThing{i}(m) {{\n  return m.fields[{i}];\n}}\n\n" for i in range(20)), handwritten.GENERATED),
])
def test_marks(text, bit):
    assert handwritten.text_rules("src/a.x", text)[0] & bit
    assert handwritten.text_rules("src/a.x", "\ufeff" + text.replace("\n", "\r\n"))[0] & bit


@pytest.mark.parametrize("text", [
    HAND, HAND + "HEADER = '// Code generated by tool. DO NOT EDIT.'\n", HAND + "SAMPLE = '''\n# @generated by x\n'''\n",
    "# Please do not edit without a review by the owners.\n" + HAND, "# Scaffolded once with tool, maintained by hand since.\n" + HAND,
    "# The report is generated by tool; this module only reads it.\n" + HAND, "# Copyright (c) the contributors of this project.\n# SPDX-License-Identifier: MIT\n" + HAND,
    "# Replaces the vendored lib copy we dropped.\n" + HAND, HAND + "W = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]\n", HAND + "Q = \"select a1, b2, c3, " + "d4, " * 80 + "e from t\"\n", "", None,
])
def test_hand_written(text):
    assert handwritten.text_rules("src/vendor_portal/generated_views.py", text)[0] == 0


def test_paths():
    for p in ("node_modules/a/b.js", "x/third_party/lib-1.0/a.go", "deps/lib/src/a.rs", "zz_generated_a.py", "a/b.pb.go", "a/b.gen.ts"):
        assert handwritten.path_rules(p), p
    for p in ("app/vendors/a.py", "src/codegen/a.py", "tools/minify/a.js", "vendor/a.js", "a_pb.sh", "external_orders/x/a.py"):
        assert not handwritten.path_rules(p), p


def test_shared_folders_and_worktrees(spark):
    rng = random.Random(0)
    body = lambda: "\n".join(f"{rng.choice('abcdefg')}{rng.choice('abcdefg')}{rng.random()} = f({i})" for i in range(40))
    x, y, z, own = body(), body(), body(), [body() for _ in range(4)]
    rows = [
        (1, 1, "lib/core/x.py", x), (2, 1, "lib/core/y.py", y), (3, 1, "main.py", own[0]),
        (4, 2, "src/core/x.py", x.replace("\n", "\r\n")), (5, 2, "src/core/y.py", y), (6, 2, "main.py", own[1]),
        (7, 3, "a/z.py", z), (8, 4, "b/z.py", z),  # worktrees of one repository
        (9, 5, "e/__init__.py", ""), (10, 6, "e/__init__.py", ""), (11, None, "q.py", own[2]), (None, 1, "n.py", own[3]), (12, 1, None, None),
        (1, 1, "lib/core/x.py", x),
    ]
    df = spark.createDataFrame(rows, "file_id long, repo_id long, rel string, text string")
    repos = spark.createDataFrame([(1, None), (2, "/g2"), (3, "/g3"), (4, "/g3")], "repo_id long, git_common_dir string")
    got = {r["file_id"]: r["vendored"] for r in handwritten.judge(df, repos).collect()}
    assert got == {1: True, 2: True, 4: True, 5: True}
    assert {r["file_id"] for r in handwritten.judge(df).collect()} == {1, 2, 4, 5, 7, 8}
    nodes = {(r["repo_id"], r["node"]): (r["h1"], r["files"]) for r in handwritten.merkle_nodes(handwritten._families(handwritten.features(df), repos)).collect()}
    assert nodes[1, "lib/core"] == nodes[2, "src/core"] and nodes[1, "lib"][0] != nodes[2, "src"][0] or nodes[1, "lib/core"][1] == 2
    assert handwritten.judge(df.limit(0), repos).count() == 0


def test_failing_files(spark):
    rows = [(1, 1, "python", "x = (\n"), (1, 1, "python", "x = (\n"), (2, 1, "python", "x = 1\n"), (3, 1, "go", None), (4, None, None, "((("), (5, 2, "yaml", ""), (None, 1, "go", "(")]
    df = spark.createDataFrame(rows, "file_id long, repo_id long, lang string, text string")
    got = parsing.failing_files(df).collect()
    assert [(r["file_id"], r["line"], r["reason"]) for r in got] == [(1, 1, "end")]
    rate = {(r["repo_id"], r["lang"]): (r["files"], r["failed"]) for r in parsing.failure_rates(df).collect()}
    assert rate == {(1, "python"): (2, 1), (1, "go"): (1, 0), (None, None): (1, 0), (2, "yaml"): (1, 0)}
