"""Import resolution of all languages against brute force."""

import posixpath
import random
import re

import pytest

from graphloom.plans import reference

EXT = {"python": ".py", "shell": ".sh", "yaml": ".yml", "rust": ".rs", "typescript": ".ts", "go": ".go"}


def plain(*parts):
    return posixpath.normpath("/" + "/".join(parts)).lstrip("/")  # nothing is above the root


def candidates(path, lang, spec):
    folder = posixpath.dirname(path)
    if lang == "typescript" and spec.startswith("."):
        stem = plain(folder, spec)
        base = re.sub(r"\.js$", "", stem)
        ends = [".ts", ".tsx", ".js", ".mjs", ".cjs"]
        return [base + e for e in ends] + [stem] + [f"{base}/index{e}" for e in ends]
    if lang == "python":
        dots = len(spec) - len(spec.lstrip("."))
        name = spec[dots:].replace(".", "/")
        stem = plain(name) if not dots else plain(folder, *[".."] * (dots - 1), name)
        return [stem + ".py", stem + "/__init__.py"]
    if lang == "shell" and "$" not in spec and "`" not in spec:
        return [plain(folder, spec), plain(spec)]
    if lang == "yaml" and spec.startswith("."):
        return [plain(spec), plain(spec) + "/action.yml", plain(spec) + "/action.yaml"]
    if lang == "rust":
        head, _, rest = spec.partition("::")
        if head not in ("crate", "self", "super"):
            head, rest = "", spec
            if "::" in spec:
                return []
        crate = "src" if path.startswith("src/") else folder
        base = {"crate": crate, "super": posixpath.dirname(folder)}.get(head, folder)
        parts = rest.split("::")
        return [plain(base, *parts[:k]) + e for k in range(len(parts), 0, -1) for e in (".rs", "/mod.rs")]
    return []


@pytest.fixture(scope="module")
def table():
    rng = random.Random(4)
    names = ["a", "b", "c"]
    paths = {f"{d}{n}{e}" for d in ("", "src/", "src/a/", "lib/") for n in names for e in EXT.values()}
    paths |= {"src/a/mod.rs", "lib/__init__.py", "src/b/__init__.py", "lib/action.yml", "src/b/index.ts"}
    files, sites, at = [], [], 0
    for repo in (1, 2):
        for p in sorted(x for x in paths if rng.random() < 0.7):
            at += 1
            lang = next(k for k, e in EXT.items() if p.endswith(e))
            files.append((repo, at, p, lang))
    specs = {
        "python": ["a", "src.a", ".b", "..c", ".", "lib", "os.path", "src.b", "...a"], "shell": ["./a.sh", "src/b.sh", "../c.sh", "$X/a.sh", "b.sh"],
        "yaml": ["./lib", "./src/a.yml", "actions/checkout", "./a.yml"], "rust": ["crate::a::b::C", "self::b", "super::c::d", "std::io", "a", "crate::a"],
        "typescript": ["./a", "../b.js", "./b", "react", "../lib/c"], "go": ["fmt", "x/src"],
    }
    sites = [(*f, s) for f in files for s in specs[f[3]]]
    return files, sites


def test_all_languages(spark, table, monkeypatch):
    files, sites = table
    known = {(r, p): i for r, i, p, _ in files}
    want = {}
    for repo, i, path, lang, spec in sites:
        hit = next((known[repo, c] for c in candidates(path, lang, spec) if (repo, c) in known), None)
        if hit is not None:
            want[i, spec] = hit
    made = (
        spark.createDataFrame(sites, "repo_id long, file_id long, path string, lang string, spec string"),
        spark.createDataFrame(files, "repo_id long, file_id long, path string, lang string"),
    )
    monkeypatch.setattr(reference, "_import_sites", lambda *_: made)
    got = {(r["file_id"], r["spec"]): r["target"] for r in reference.QUERIES["import_first_match"](spark, "").collect()}
    assert got == want
    of = {i: lang for _, i, _, lang in files}
    assert {of[i] for i, _ in want} == set(EXT) - {"go"}
    outside = {}
    for repo, i, path, _, spec in sites:
        if (i, spec) not in want:
            outside.setdefault((repo, spec), []).append((path, i))
    rows = reference.QUERIES["import_external"](spark, "").collect()
    assert {(r["repo_id"], r["spec"]): (r["anchor"], r["importers"]) for r in rows} == {k: (min(v)[1], len(v)) for k, v in outside.items()}
