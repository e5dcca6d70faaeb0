"""Headers as they are found in the wild, linear rules, holders of copyright, trees and evidence."""

import random
import time

import pytest

from graphloom.llm import handwritten as H

CODE = "def total(rows):\n    # sum of sizes\n    return sum(r.size for r in rows if r)\n"


@pytest.mark.parametrize("head,bit", [
    ("/*! jQuery v3.6.0 | (c) OpenJS Foundation and other contributors | jquery.org/license */\n", H.VENDORED),
    ("/** @license React v16.13.1\n * react.production.js\n *\n * This source code is licensed under the MIT license.\n */\n", H.VENDORED),
    ("//     Underscore.js 1.13.1\n//     https://underscorejs.org\n//     (c) 2009-2021 Jeremy Ashkenas. Freely distributed under the MIT license.\n", H.VENDORED),
    ("/* This file is auto generated, do not touch */\n", H.GENERATED),
    ("# Generated by Django 3.2 on 2021-04-06 10:00\n", H.GENERATED),
    ("// Generated by the protocol buffer compiler.  DO NOT EDIT!\n", H.GENERATED),
    ("# Autogenerated by Thrift Compiler (0.13.0)\n#\n# DO NOT EDIT UNLESS YOU ARE SURE\n", H.GENERATED),
    ("/*\nCopied from lodash 4.17, unmodified.\n*/\n", H.VENDORED),
])
def test_usual_heads(head, bit):
    assert H.text_rules("a.js", head + CODE)[0] & bit


@pytest.mark.parametrize("head", [
    "# Copyright (c) the contributors of this project.\n", "// SPDX-License-Identifier: MIT\n", "# Reports v2.1 are read here.\n", "# Generated files are skipped by this walker.\n",
    "# Generated by hand from the paper.\n", "# Copied from the old module and rewritten since.\n", "# Do not edit this without asking the owners.\n", "# Parser 2.0: the second attempt\n",
    "# version 1.2 of the wire format\n", "# (c) is the count of cells\n",
])
def test_heads_of_hand_written_files(head):
    assert H.text_rules("a.py", head + CODE)[0] == 0


@pytest.mark.parametrize("line,holder", [
    ("Copyright 2008 Google Inc.", "google inc"), ("# Copyright (c) 2001-2004, 2006 Jane Q. Doe <j@x.example>", "jane q. doe"), ("© 2020 by Acme, all rights reserved", "acme"),
    ("(c) the lib authors, released under the MIT license", "lib authors"), ("Copyright the contributors of this project.", ""), ("no rights here", None), ("copyright", ""), ("(c) 12 cells", None),
])
def test_holders(line, holder):
    assert H.holder_of(line) == holder


@pytest.mark.parametrize("text", [
    "/*a" * 20_000, "// " + "1.1" * 80_000, "# " + "copied from x " * 20_000, "# " + "generated by x " * 20_000, "# " + "copyright 2001, " * 20_000, "a" + "1" * 60_000 + "x = 1",
    "x = '" + "a1" * 60_000 + "'", "\"" * 60_001, "# lib " + "1." * 60_000, "# " + "a " * 60_000 + "1.2", "# do not edit " * 10_000, "`" * 60_001, ("x" * 390 + "\n") * 500, "/*\n" * 30_000,
])
def test_rules_are_linear(text):
    """A text of some 60 to 250 KB, whatever is in it; the limit leaves room for a slow machine."""
    began = time.process_time()
    H.text_rules("a.js", text)
    H.content_hash(text)
    assert time.process_time() - began < 3


def test_many_shapes_and_long_lines_do_not_end_the_test():
    rows = "".join(f"export function getThing{i}(m) {{\n  return m.fields[{i}];\n}}\n" for i in range(300))
    frame = "".join(f"import {{ {', '.join('q' * k for k in range(1, n))} }} from 'x';\n" for n in range(2, 16))
    assert H.is_repetitive(frame + rows) and H.is_repetitive("// " + "x" * 900 + "\n" + rows)
    assert H.is_repetitive(rows + f"const s = \"{'y' * 900}\";\n")


def test_renamed_and_relicensed_copies_are_the_same(spark):
    rng = random.Random(1)
    names = "alpha beta gamma delta omega kappa sigma theta lambda_ zeta eta iota".split()
    body = lambda: "\n".join(f"{rng.choice(names)} = {rng.choice(names)}({i}, {rng.choice(names)})" for i in range(60))
    x, y = body(), body()
    other = x
    for n in names:
        other = other.replace(n, n + "_2")
    assert H.content_hash("# Licensed by nobody\n" + x)[:2] == H.content_hash(other)[:2] != H.content_hash(y)[:2]
    rows = [(1, 1, "lib/a.py", "# (c)\n" + x), (2, 2, "x/y/b.py", other), (3, 1, "m.py", y), (4, 3, "t.py", "x = 1\n"), (5, 4, "t.py", "x = 1\n")]
    got = H.judge(spark.createDataFrame(rows, "file_id long, repo_id long, rel string, text string")).collect()
    assert {(r["file_id"], r["vendored"], r["by_tree"], r["by_comment"]) for r in got} == {(1, True, True, False), (2, True, True, False)}


def test_holders_of_a_repository(spark):
    """A holder whom a fifth of the files name is the repository's own; others are strangers."""
    own = [(i, 1, f"a{i}.py", f"# Copyright 2020 Acme Inc.\nx = {i}\n") for i in range(6)]
    rows = own + [(10, 1, "b.py", "# Copyright 2008 Google Inc.\ny = 1\n"), (11, 2, "c.py", "# Copyright 2020 Acme Inc.\nz = 1\n"), (12, None, "d.py", "# Copyright Foo\n")]
    got = H.judge(spark.createDataFrame(rows, "file_id long, repo_id long, rel string, text string")).collect()
    assert {(r["file_id"], r["by_comment"]) for r in got} == {(10, True), (11, True), (12, True)}
