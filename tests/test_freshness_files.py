"""Scans against extractions, no file left out by its number."""

import datetime as dt

from graphloom.plans import reference


def test_every_file_is_compared(spark, tmp_path):
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    n = 17 * 19
    files = [(i, 1, f"{i}.py", "python", None, 1, h, w) for i, h, w in ((n, "aa", t[0]), (2, "BB", t[0]), (2, "cc", t[1]), (3, "dd", t[0]), (3, None, t[1]), (4, "ee", t[0]), (6, "ff", t[0]))]
    extracts = [(n * 2, 1, "aa", t[0], None), (2, 1, "bb", t[0], None), (2, 2, "cc", t[1], None), (3, 1, "DD", t[0], None), (3, 1, "ff", t[2], "bad"), (6, 1, "00", t[0], None), (4, 2, "ee", t[0], None)]
    for name, rows, schema in (
        ("files", files, "file_id long, repo_id long, path string, lang string, mtime long, size long, hash string, scanned_at timestamp"),
        ("file_extracts", extracts, "file_id long, run_id long, hash string, extracted_at timestamp, error string"),
        ("index_runs", [(1, "ok"), (1, "ok"), (2, "failed")], "run_id long, status string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r["file_id"]: r["change"] for r in reference.QUERIES["freshness_diff"](spark, str(tmp_path)).collect()}
    assert got == {n: "added", n * 2: "deleted", 2: "modified", 4: "added", 6: "modified"}
