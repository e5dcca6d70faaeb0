"""What reaches a block of snapshots."""

import datetime as dt

import pandas as pd

from graphloom.operators import snapshots


def test_repeated_rows_do_not_reach_the_blocks(spark, monkeypatch):
    when = [None, *(dt.datetime(2024, 1, 1, i % 24) for i in range(300))]
    rows = [(n, 1, p, "aB"[i % 2] * 3, t) for n in (1, 2) for i, t in enumerate(when) for p in ("x", "./x", "x")] + [(2, 1, "y", None, None)]
    snap = spark.createDataFrame(rows, "snapshot_no int, repo_id long, path string, hash string, loaded_at timestamp")
    order = spark.createDataFrame([(1, 1, "complete", when[1]), (2, 1, "complete", when[1])], "snapshot_no int, repo_id long, status string, delivered_at timestamp")

    def sizes(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"snapshot_no": [len(pdf)], "repo_id": [key[0]], "path": [",".join(sorted(pdf["path"]))], "change": [""]})

    assert [tuple(r)[:3] for r in snapshots.changes(snap, order, 1).collect()] == [(2, 1, "y")]
    monkeypatch.setattr(snapshots, "_block_changes", sizes)
    assert [(r["snapshot_no"], r["path"]) for r in snapshots.changes(snap, order, 1).collect()] == [(3, "x,x,y")]
