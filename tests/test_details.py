"""Small things that were once wrong: terms of questions, dotfiles, patterns, case, stamps, byte cuts, hashes, plans."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions.hashing import fnv1a, fnv1a_all, fnv1a_hex
from graphloom.operators import graph, retrieval, search, traverse
from graphloom.sources import scan


def test_terms_of_a_question_are_those_of_a_text(spark):
    for q in ("приветМир", "नमस्ते दुनिया", "serverEntry_two İX ΣΑΣ", "", "the of", "a1 ß É"):
        assert T.query_terms(q, spark) == spark.createDataFrame([(q,)], "q string").select(T.terms(F.col("q"))).first()[0]
    assert T.query_terms("приветМир", spark) == ["привет", "мир"]
    docs = spark.createDataFrame([(1, "x", "a/b", "нашМир тут", "", 1, 0), (2, "x", "a/c", "", "nothing", 1, 0)], "id long, name string, path string, signature string, body string, start_line long, in_edges long")
    assert [r["id"] for r in retrieval.rank(docs, "мир тут", None).collect()] == [1]


def test_dotfiles(spark):
    names = ["src/.bash", "a/.py", "a/b.py", ".ts", "x.d.ts", "a.b/c", "..py"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert [r[0] for r in df.select(T.language(F.col("p"))).collect()] == [scan.language_of(n) for n in names] == [None, None, "python", None, None, None, "python"]
    assert scan.language_of(".profile", b"#!/bin/sh\n") == "shell" and scan.language_of("a.txt", b"#!/bin/sh\n") is None


def test_hidden_scripts_are_sniffed(spark, tmp_path):
    (tmp_path / ".hook").write_bytes(b"#!/bin/sh\necho\n")
    (tmp_path / ".env").write_bytes(b"A=1\n")
    rows = scan.read_files(spark, str(tmp_path)).collect()
    assert [(r["path"], r["lang"], r["hash"]) for r in rows] == [(".hook", "shell", fnv1a_hex(b"#!/bin/sh\necho\n"))]


def test_patterns_are_checked_by_what_runs_them(spark):
    assert T.pattern(r"\p{Lu}\w+") == r"\p{Lu}\w+"
    for bad in (r"(?P<n>foo)", "(", "a(?=b)", r"(a)\1", "[z-a]"):
        with pytest.raises(ValueError):
            T.pattern(bad)


def test_containers_fold_ascii_only(spark):
    s = spark.createDataFrame([(1, "run", "Éa", "method"), (2, "run", "éa", "method"), (3, "RUN", "ab", "method")], "id long, name string, container string, kind string")
    assert [r["id"] for r in traverse.seeds(s, "Éa.run").collect()] == [1]
    assert [r["id"] for r in traverse.seeds(s, "x.AB.Run").collect()] == [3]


def test_an_index_of_another_extractor_is_none(spark, tmp_path, monkeypatch):
    from graphloom import engine
    from graphloom.sources import store

    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.py").write_text("def f(): pass\n")
    repo = engine.Repository(spark, str(tmp_path / "r"), store.Store(spark, str(tmp_path / "s")))
    repo.build()
    assert repo.grep("def", fixed=True)["total"] == 1 and repo.status()["indexed"]
    monkeypatch.setattr(store, "EXTRACTOR_STAMP", "other")
    assert not repo.status()["indexed"]
    with pytest.raises(engine.NotIndexed):
        repo.map()
    assert not repo.freshness()["clean"]


def test_bytes_are_cut_between_characters(spark):
    texts = ["", "abc", "aé" * 5, "日本語", "x" * 9 + "日", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = [t if t is None or len(t.encode()) <= 10 else t.encode()[:10].decode("utf-8", "ignore") for t in texts]
    assert [r[0] for r in df.select(T.first_bytes(F.col("t"), 10)).collect()] == want


def test_hashes_of_many(spark):
    rng = random.Random(2)
    items = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 5, 80, 700]))) for _ in range(300)] + [b"x" * 5000]
    assert fnv1a_all(items) == [fnv1a_hex(x) for x in items] and fnv1a_all([]) == []
    df = spark.createDataFrame([("a",), (None,), ("",)], "t string").select(fnv1a("t"))
    assert [r[0] for r in df.collect()] == [fnv1a_hex(b"a"), None, fnv1a_hex(b"")]


def test_lines(spark):
    texts = ["", "\n", "a", "a\n", "a\r\nb", "a\n\n", "a\r\n\r\n", None]
    want = [[], [""], ["a"], ["a"], ["a", "b"], ["a", ""], ["a", ""], None]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.lines(F.col("t"))).collect()] == want


def test_a_long_text_is_no_key_of_a_shuffle(spark, tmp_path):
    """Texts of the sources stay where they are read: no exchange below a search has them among its columns."""
    import os

    from graphloom.plans import reference as R

    sf = str(tmp_path / "sf")
    rows = [(i, 1, f"src/{i}.py", "python", f"def f{i}():\n    return .clear();\n", 0, 9, "h") for i in (1, 2, 2, 3)]
    spark.createDataFrame(rows, "file_id long, repo_id long, rel string, lang string, text string, mtime long, size long, hash string").write.parquet(f"{sf}/source_files.parquet")
    assert os.path.isdir(sf)
    for name in ("grep_lines", "grep_fixed", "grep_icase", "grep_scoped", "excerpt", "token_estimate"):
        df = R.QUERIES[name](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        for line in plan.split("\n"):
            if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line:
                assert "text#" not in line.split("hashpartitioning")[1], line
        assert df.count() in (0, 3)
    assert R.grep_fixed(spark, sf).count() == 3


def test_matches_by_file(spark):
    files = spark.createDataFrame([(1, "a", "x\ny x\n"), (2, "b", ""), (3, "c", None)], "file_id long, path string, text string")
    got = {r["file_id"]: [(x["line"], x["text"]) for x in r["lines"]] for r in search.matches_by_file(files, "x", fixed=True).collect()}
    assert got == {1: [(1, "x"), (2, "y x")], 2: []}


def test_small_and_large_frontiers_agree(spark, monkeypatch):
    rng = random.Random(4)
    edges = spark.createDataFrame([(rng.randrange(40), rng.randrange(40), rng.choice(["calls", "imports", "contains"])) for _ in range(90)], "src long, dst long, kind string").distinct()
    start = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    answers = []
    for few in (0, 3, 500):
        monkeypatch.setattr(traverse, "FEW", few)
        answers.append([sorted(tuple(r) for r in traverse.reach(edges, start, out, depth).collect()) for out in (False, True) for depth in (1, 2, None)])
    assert answers[0] == answers[1] == answers[2] and answers[0][2]


def test_too_many_symbols_are_refused(spark, monkeypatch):
    monkeypatch.setattr(graph, "SYMBOLS_PER_FILE", 2)
    df = spark.createDataFrame([(1, "python", "def a(): pass\ndef b(): pass\n")], "file_id long, lang string, text string")
    with pytest.raises(Exception, match="ids have room"):
        graph.extract_files(df).count()
