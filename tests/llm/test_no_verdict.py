"""A parser that does not get through a text gives no verdict on it, nor on any other."""

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from graphloom.llm import derive, parsing, syntax
from graphloom.llm.syntax import golang


@pytest.fixture
def fresh(monkeypatch):
    monkeypatch.setattr(syntax, "_LOADED", {})


def _breaks_at(monkeypatch, *calls):
    real, n = derive.Grammar._derive, [0]

    def broken(self, node, kind):
        n[0] += 1
        if n[0] in calls:
            raise RecursionError
        return real(self, node, kind)

    monkeypatch.setattr(derive.Grammar, "_derive", broken)


def test_an_exception_decides_nothing(fresh, monkeypatch):
    """Tables left half made by an exception would refuse valid texts."""
    _breaks_at(monkeypatch, 20)
    assert parsing.checked("python", "x = f(1)\n") is None
    assert parsing.checked("python", "y = 2\n") is None
    assert parsing.checked("python", "x = (\n") == (1, "", "end")


def test_a_text_given_up_does_not_decide_the_next(fresh, monkeypatch):
    _breaks_at(monkeypatch, 20, 40)
    assert parsing.checked("python", "x = f(1)\n") == (1, "RecursionError", "error")
    assert parsing.checked("python", "x = f(1)\n") is None


def test_a_parser_that_breaks_finds_nothing(monkeypatch):
    def broken(lang, text):
        raise KeyError(text) if text == "b" else IndexError

    monkeypatch.setattr(syntax, "failure", broken)
    batch = pa.RecordBatch.from_pydict({"file_id": [1, 2, 3], "repo_id": [1, 1, 1], "lang": ["go", "go", "go"], "text": ["a", "b", None]})
    (got,) = parsing._parse(iter([batch]))
    assert [tuple(r[k] for k in ("file_id", "failed", "line", "token", "reason")) for r in got.to_pylist()] == [
        (1, None, None, "IndexError", "error"), (2, None, None, "KeyError", "error"), (3, False, None, None, None)
    ]


def test_a_grammar_that_cannot_be_built_is_no_failing_file(fresh, monkeypatch):
    monkeypatch.setattr(golang, "RULES", golang.RULES.replace("block:", "blokk:"))
    with pytest.raises(ValueError, match="block"):
        parsing.checked("go", "package a\n")


def test_files_without_a_verdict(spark):
    bad = b"x = '\xff'\n"  # cannot be decoded
    rows = [(1, 1, "python", b"x = (\n"), (2, 1, "python", b"x = 1\n"), (3, 1, "python", bad), (4, 2, "python", bad), (4, 2, "python", b"\n\nx = )\n"), (5, 3, "python", bad), (5, 3, "python", b"x = 1\n"), (6, 3, "cobol", bad)]
    df = spark.createDataFrame(rows, "file_id long, repo_id long, lang string, text binary").withColumn("text", F.col("text").cast("string"))
    got = {r["file_id"]: (r["line"], r["token"], r["reason"]) for r in parsing.failing_files(df).collect()}
    unread = (None, "UnicodeDecodeError", "error")
    assert got == {1: (1, "", "end"), 3: unread, 4: (3, ")", "token"), 5: unread}
    rates = {(r["repo_id"], r["lang"]): (r["files"], r["failed"], r["unjudged"], r["rate"]) for r in parsing.failure_rates(df).collect()}
    assert rates == {(1, "python"): (3, 1, 1, 0.5), (2, "python"): (1, 1, 0, 1.0), (3, "python"): (1, 0, 1, None), (3, "cobol"): (1, 0, 0, 0.0)}
    told = parsing.failing_ids(df.filter("file_id not in (3, 5)"))
    assert told.columns == ["file_id"] and sorted(r["file_id"] for r in told.collect()) == [1, 4]
    for one in (3, 5):
        ids = parsing.failing_ids(df.filter(F.col("file_id") != 8 - one))
        for use in (ids.collect, ids.count, ids.write.format("noop").mode("overwrite").save):
            with pytest.raises(PySparkException, match=f"no verdict on file {one}"):
                use()
