"""Problems 3, 4 and 5: incremental work, hierarchies, snapshots."""

import datetime as dt
import random

import pytest

from graphloom.operators import hierarchy, incremental, snapshots


def at(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(minutes=n)


FILES = "file_id long, hash string, scanned_at timestamp, extra string"
EXTRACTS = "file_id long, run_id long, hash string, extractor_stamp string, extracted_at timestamp, error string"
RUNS = "run_id long, status string, extractor_stamp string"


def work(spark, files, extracts, runs=((1, "ok", "x"), (2, "failed", "x"))):
    df = incremental.extraction_work(
        spark.createDataFrame(files, FILES), spark.createDataFrame(extracts, EXTRACTS), spark.createDataFrame(list(runs), RUNS), "s2"
    )
    return sorted(r["file_id"] for r in df.collect())


def test_work_takes_new_changed_and_stale(spark):
    files = [
        (1, "AA", at(1), None), (1, "AA", at(1), None),  # same hash in other case: done
        (2, "bb", at(1), None), (2, "cc", at(2), None),  # changed
        (3, "dd", at(1), None),  # old stamp
        (4, "ee", at(1), None),  # only failed attempts
        (5, "ff", at(1), None), (5, None, at(9), None),  # a later scan could not read it: hash ff holds
        (6, None, at(1), None),  # never readable
        (None, "gg", at(1), None),
        (7, "hh", at(3), None), (7, "ii", at(1), None),  # a late older scan
    ]
    extracts = [
        (1, 1, "aa", "s2", at(5), None), (2, 1, "bb", "s2", at(5), None), (3, 1, "dd", "s1", at(5), None),
        (4, 2, "ee", "s2", at(5), None), (4, 1, "ee", "s2", at(6), "timeout"), (5, 1, "FF", "s2", at(5), None),
        (7, 1, "hh", "s2", at(5), None), (99, 1, "zz", "s2", at(5), None), (1, None, "xx", None, at(9), None),
    ]
    assert work(spark, files, extracts) == [2, 3, 4]


def test_work_of_empty_tables(spark):
    assert work(spark, [], []) == []
    assert work(spark, [(1, "a", at(1), None)], []) == [1]


def test_target_survives_a_crash_between_writing_and_publishing(spark, tmp_path, monkeypatch):
    target = incremental.VersionedTarget(spark, str(tmp_path / "t"), "id")
    source = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (4, None)], "id long, version string")
    assert target.pending(source).count() == 2
    target.publish(target.pending(source))
    assert target.pending(source).count() == 0
    changed = spark.createDataFrame([(1, "a"), (2, "b2"), (3, "c")], "id long, version string")
    todo = target.pending(changed)
    assert sorted(r["id"] for r in todo.collect()) == [2, 3]

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(target, "_commit", dies)
        with pytest.raises(OSError):
            target.publish(todo)
    assert sorted((r["id"], r["version"]) for r in target.current().collect()) == [(1, "a"), (2, "b")]
    assert sorted(r["id"] for r in target.pending(changed).collect()) == [2, 3]  # nothing skipped
    target.publish(target.pending(changed), drop_missing_from=changed)
    assert sorted((r["id"], r["version"]) for r in target.current().collect()) == [(1, "a"), (2, "b2"), (3, "c")]
    assert target.pending(changed).isEmpty()  # nothing repeated


def test_of_two_publishers_one_is_refused(spark, tmp_path, monkeypatch):
    """The second one looks before the first has published and publishes after it."""
    one, two = (incremental.VersionedTarget(spark, str(tmp_path / "t"), "id") for _ in range(2))
    row = lambda k: spark.createDataFrame([(k, "a")], "id long, version string")
    one.publish(row(1))
    commit = two._commit
    monkeypatch.setattr(two, "_commit", lambda entry: (one.publish(row(2)), commit(entry)))
    with pytest.raises(RuntimeError):
        two.publish(row(3))
    assert sorted(r["id"] for r in one.current().collect()) == [1, 2]
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("d-")]) == 2


def test_repeated_and_late_rows_of_a_source(spark, tmp_path):
    target = incremental.VersionedTarget(spark, str(tmp_path / "t"), "id", order="at")
    src = lambda *r: spark.createDataFrame(list(r), "id long, version string, at long, m map<string,int>")
    first = target.pending(src((1, "a", 1, {}), (1, "a", 1, None), (1, "b", 2, None), (2, "x", None, None), (2, "w", None, None)))
    assert sorted((r["id"], r["version"]) for r in first.collect()) == [(1, "b"), (2, "x")]
    target.publish(first)
    again = src((1, "a", 1, None), (1, "aa", 2, None), (2, "y", 1, None), (2, "x", 5, None), (3, "q", None, None))
    # Of 2 the newest row has the version held; of 1 no row is newer.
    assert sorted((r["id"], r["version"]) for r in target.pending(again).collect()) == [(3, "q")]
    assert sorted((r["id"], r["version"]) for r in target.pending(again.filter("version <> 'x'")).collect()) == [(2, "y"), (3, "q")]


def test_runs_write_what_they_change_and_old_folders_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental.VersionedTarget, "MAX_PARTS", 3)
    target = incremental.VersionedTarget(spark, str(tmp_path / "t"), "id")
    rows = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "id long, version string").coalesce(1)
    target.publish(rows(range(50), "a"))
    want = {i: "a" for i in range(50)}
    for k in range(1, 8):
        target.publish(rows([k, 100 + k], f"v{k}"))
        want |= {k: f"v{k}", 100 + k: f"v{k}"}
        part = [p for p in (tmp_path / "t").iterdir() if p.name.startswith(f"d-{k + 1:010d}")]  # none where it went into a base
        assert not part or spark.read.parquet(str(part[0])).count() == 2
        assert {r["id"]: r["version"] for r in target.current().collect()} == want
    assert len(target._numbers()) == target.KEEP
    needed = {p for n in target._numbers() for p in target._read(n)["parts"]}
    assert {p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith("_")} == needed


def brute_tree(parents):
    out = {}
    for n in parents:
        seen, at_, d = {n}, n, 0
        while parents[at_] is not None and parents[at_] in parents:
            at_, d = parents[at_], d + 1
            if at_ in seen:
                at_, d = None, -1
                break
            seen.add(at_)
        out[n] = (at_, d)
    return out


def test_hierarchy_against_brute_force(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for g in range(12):
        n = rng.randint(1, 40)
        parents = {i: (rng.choice([None, rng.randrange(n + 2)]) if rng.random() < 0.3 else max(0, i - 1) if i else None) for i in range(n)}
        rows += [(g, i, p, f"s{i}", "x") for i, p in parents.items()]
        want |= {(g, i): v for i, v in brute_tree(parents).items()}
    rows += [rows[0], (None, 1, 2, "a", "b"), (1, None, 2, "a", "b")]
    df = spark.createDataFrame(rows, "grp long, id long, up long, name string, root string")
    got = {(r["grp"], r["id"]): r for r in hierarchy.resolve(df, "grp", "id", "up", segment="name").collect()}
    assert {k: (r["root"], r["depth"]) for k, r in got.items()} == want
    for (g, i), r in got.items():
        if r["depth"] >= 0:
            assert len(r["path"]) == r["depth"] + 1 and r["path"][-1] == f"s{i}" and r["chain"][0] == r["root"]
        else:
            assert r["path"] is None
    pairs = hierarchy.descendants(hierarchy.resolve(df, "grp", "id", "up", segment="name"), "grp", "id")
    assert pairs.count() == sum(d for _, d in want.values() if d > 0)


def test_hierarchy_of_long_chain_and_nothing(spark):
    n = 300
    df = spark.createDataFrame([(1, i, i - 1 if i else None) for i in range(n)], "g long, id long, p long")
    deepest = hierarchy.resolve(df, "g", "id", "p").agg({"depth": "max"}).first()[0]
    assert deepest == n - 1
    assert hierarchy.resolve(df.limit(0), "g", "id", "p").count() == 0


def test_symbol_parents(spark):
    schema = (
        "file_id long, extracted_at timestamp, symbols array<struct<name:string,kind:string,start_line:long,end_line:long,signature:string>>,"
        "parents array<int>, containers array<string>, imports array<string>"
    )
    s = lambda n, k: (n, k, 1, 1, None)
    rows = [
        (1, at(1), [s("old", "class")], [None], [None], []),
        (1, at(2), [s("A", "class"), s("m", "method"), s("x", "method"), s("y", "method"), None], [None, 0, 77, -1], [None, None, "A", "nobody"], []),
        (2, at(1), [s("A", "class"), s("B", "type")], [1, 0], None, None),
        (3, at(1), [], [], [], []), (4, at(1), None, None, None, None),
    ]
    got = {(r["file_id"], r["ordinal"]): (r["parent"], r["root"], r["depth"]) for r in hierarchy.symbol_trees(spark.createDataFrame(rows, schema)).collect()}
    assert got[(1, 1)] == (0, 0, 1) and got[(1, 2)] == (0, 0, 1)
    assert got[(1, 3)] == (None, 3, 0) and got[(1, 4)] == (None, 4, 0)
    assert got[(2, 0)][2] == -1 and got[(2, 1)][1] is None
    assert len(got) == 7


SNAP = "snapshot_no int, repo_id long, path string, size long, mtime long, hash string, loaded_at timestamp"
DELIVERY = "snapshot_no int, repo_id long, status string, delivered_at timestamp"


def changes(spark, rows, deliveries, blocks=None):
    df = snapshots.changes(spark.createDataFrame(rows, SNAP), spark.createDataFrame(deliveries, DELIVERY), blocks)
    return sorted(tuple(r) for r in df.collect())


def test_snapshot_changes(spark):
    r = lambda n, p, h, t=1: (n, 1, p, None, None, h, at(t))
    rows = [
        r(1, "a", "AA"), r(1, "./b", "bb"), r(1, "c//d", "cc"), r(1, "gone", "x"),
        r(2, "partial", "x"),
        r(3, "a", "aa"), r(3, "b", "b2"), r(3, "b", "bb", 0), r(3, "c\\d", "cc"), r(3, "new", None), r(3, "new", None),
        r(5, "new", None), r(5, None, "x"), (5, None, "x", None, None, "h", at(1)),
    ]
    deliveries = [(1, 1, "complete", at(1)), (2, 1, "partial", at(1)), (3, 1, "complete", at(1)), (4, 1, "complete", at(1)), (5, 1, "complete", at(1))]
    want = sorted([
        (3, 1, "b", "modified"), (3, 1, "gone", "deleted"), (3, 1, "new", "added"),
        (4, 1, "a", "deleted"), (4, 1, "b", "deleted"), (4, 1, "c/d", "deleted"), (4, 1, "new", "deleted"), (5, 1, "new", "added"),
    ])
    for blocks in (None, 1, 7):
        assert changes(spark, rows, deliveries, blocks) == want
    assert changes(spark, [], deliveries) == []
    assert changes(spark, rows, []) == []


def test_snapshots_against_brute_force(spark):
    rng = random.Random(5)
    rows, deliveries, state = [], [], {}
    for repo in (1, 2):
        for n in range(1, 7):
            deliveries.append((n, repo, "complete" if rng.random() < 0.8 else "partial", at(n)))
            state[repo, n] = {f"p{k}": rng.choice("abc") for k in range(60) if rng.random() < 0.7}
            rows += [(n, repo, p, None, None, h, at(1)) for p, h in state[repo, n].items()]
    want = []
    for repo in (1, 2):
        good = [n for n, r, s, _ in deliveries if r == repo and s == "complete"]
        for a, b in zip(good, good[1:]):
            old, new = state[repo, a], state[repo, b]
            want += [(b, repo, p, "added") for p in new.keys() - old.keys()] + [(b, repo, p, "deleted") for p in old.keys() - new.keys()]
            want += [(b, repo, p, "modified") for p in new.keys() & old.keys() if new[p] != old[p]]
    assert changes(spark, rows, deliveries, 3) == sorted(want)


def test_deliveries_one_by_one(spark):
    """The kept state gives what all deliveries together give, and ordinals stay as they are."""
    rng = random.Random(8)
    rows, deliveries = [], []
    for repo in (1, 2, 3):
        for n in range(1, 6):
            if repo == 3 and n < 3 or rng.random() < 0.1:
                continue
            deliveries.append((n, repo, "complete" if rng.random() < 0.7 else "partial", at(n)))
            if not (repo == 2 and n == 4):
                rows += [(n, repo, f"./d//p{k}", None, None, rng.choice(["a", "B", None]), at(1)) for k in range(30) if rng.random() < 0.7]
    rows += rows[:10]
    state, got, before = None, [], {}
    for n in range(1, 6):
        so_far = spark.createDataFrame([d for d in deliveries if d[0] <= n], DELIVERY)
        part = spark.createDataFrame([r for r in rows if r[0] == n], SNAP)
        changed, state = snapshots.apply_delivery(state, part, so_far, n, blocks=3)
        got += [tuple(r) for r in changed.collect()]
        now = {(r["repo_id"], r["block"]): r["paths"] for r in state.collect()}
        assert all(now[k][:len(p)] == p for k, p in before.items())
        before = now
    assert sorted(got) == changes(spark, rows, deliveries, 2) and got
    assert snapshots.apply_delivery(state, part.limit(0), so_far, 9)[0].count() == 0


def test_changes_go_through_ordinals_and_bitmaps(monkeypatch):
    import pandas as pd

    used = []
    of = snapshots.Bitmap.and_not
    monkeypatch.setattr(snapshots.Bitmap, "and_not", lambda a, b: used.append(1) or of(a, b))
    pdf = pd.DataFrame({"rank": [0, 1, 1], "snapshot_no": [1, 2, 2], "next_no": [2, None, None], "path": ["b", "a", "b"], "value": ["x", "y", None]})
    got = snapshots._block_changes((7, 0), pdf)
    assert sorted(zip(got["snapshot_no"], got["path"], got["change"])) == [(2, "a", "added"), (2, "b", "modified")] and used
    block = snapshots.Block()
    block.step(["b"], [None])
    block.step(["a", "b"], [None, "v"])
    assert block.ordinal == {"b": 0, "a": 1}


def test_bitmaps():
    import numpy as np
    from graphloom.operators.bitmaps import ARRAY, BITS, RUNS, Bitmap

    rng = np.random.default_rng(3)
    sets = [np.zeros(0, int), np.arange(200_000), rng.choice(300_000, 100, False), rng.choice(140_000, 90_000, False), np.array([0, 65535, 65536, 1 << 33]), np.arange(60_000, 70_000)]
    kinds = set()
    for x in sets:
        a = Bitmap.of(x)
        kinds |= {k for k, _ in a.parts.values()}
        assert np.array_equal(Bitmap.from_bytes(a.to_bytes()).members(), np.sort(x)) and len(a) == len(x)
        for y in sets:
            b = Bitmap.of(y)
            assert np.array_equal((a & b).members(), np.intersect1d(x, y))
            assert np.array_equal(a.and_not(b).members(), np.setdiff1d(x, y))
    assert kinds == {ARRAY, BITS, RUNS} and len(Bitmap.of(np.arange(1_000_000)).to_bytes()) < 500
