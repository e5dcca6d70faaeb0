"""Trees to rows: the paths are listed on the driver, the files are read in tasks.

The walk honours ignore files at every level (and those of the user and of .git/info),
takes hidden files, never enters ``.git`` and skips what cannot be read. Files that are
not UTF-8, or of no known language, are left out by the reader.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from graphloom.functions.hashing import fnv1a_all

SCHEMA = "path string, lang string, text string, mtime bigint, size bigint, hash string"

#: Extensions of the languages.
EXTENSIONS = {
    "ts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "rs": "rust", "py": "python", "go": "go", "sh": "shell", "bash": "shell", "bats": "shell", "yaml": "yaml", "yml": "yaml",
}


def language_of(path: str, head: bytes = b"") -> str | None:
    name = path.rsplit("/", 1)[-1]
    stem, dot, ext = name.rpartition(".")
    if dot and stem:
        return None if name.endswith(".d.ts") else EXTENSIONS.get(ext)
    if not (dot and stem) and head.startswith(b"#!") and re.search(rb"[/ ](?:ba|da|k)?sh", head[:256].split(b"\n")[0].lower()):
        return "shell"
    return None


class Ignore:
    """The patterns of one ignore file, later ones first in force."""

    def __init__(self, lines: list[str]):
        self.rules: list[tuple[bool, bool, re.Pattern]] = []
        for line in lines:
            line = line.rstrip("\n")
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line.removeprefix("\\")
            only_dirs = line.endswith("/")
            body = line.strip("/") if only_dirs or line.startswith("/") else line
            anchored = line.startswith("/") or "/" in body
            self.rules.append((keep, only_dirs, re.compile(self._pattern(body, anchored))))

    @staticmethod
    def _pattern(body: str, anchored: bool) -> str:
        out = "" if anchored else r"(?:.*/)?"
        for part in re.split(r"(\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]*\])", body):
            if part == "**/":
                out += r"(?:.*/)?"
            elif part == "/**":
                out += r"/.*"
            elif part == "**":
                out += ".*"
            elif part == "*":
                out += "[^/]*"
            elif part == "?":
                out += "[^/]"
            elif part.startswith("[") and part.endswith("]"):
                out += part.replace("[!", "[^")
            else:
                out += re.escape(part)
        return out + r"\Z"

    def verdict(self, rel: str, is_dir: bool) -> bool | None:
        """True: ignored, False: taken back, None: no rule."""
        for keep, only_dirs, pattern in reversed(self.rules):
            if (is_dir or not only_dirs) and pattern.match(rel):
                return not keep
        return None


def _read_ignore(path: str) -> Ignore | None:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return Ignore(f.readlines())
    except OSError:
        return None


def list_files(root: str) -> list[str]:
    """Paths below ``root`` in order, relative to it, that no ignore file excludes."""
    root = os.path.realpath(root)
    base = [("", x) for x in (
        _read_ignore(os.path.join(os.environ.get("XDG_CONFIG_HOME", os.path.expanduser("~/.config")), "git/ignore")),
        _read_ignore(os.path.join(root, ".git/info/exclude")),
    ) if x]
    out: list[str] = []

    def ignored(rel: str, is_dir: bool, stack: list[tuple[str, Ignore]]) -> bool:
        for prefix, rules in reversed(stack):
            said = rules.verdict(rel[len(prefix):], is_dir)
            if said is not None:
                return said
        return False

    def walk(rel: str, stack: list[tuple[str, Ignore]]) -> None:
        own = _read_ignore(os.path.join(root, rel, ".gitignore"))
        stack = [*stack, (rel, own)] if own else stack
        try:
            entries = sorted(os.scandir(os.path.join(root, rel)), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            path = rel + e.name
            try:
                is_dir = e.is_dir(follow_symlinks=False)
                is_file = e.is_file(follow_symlinks=False)
            except OSError:
                continue
            if e.name == ".git" or not (is_dir or is_file) or ignored(path, is_dir, stack):
                continue
            if is_dir:
                walk(path + "/", stack)
            else:
                out.append(path)

    walk("", base)
    return sorted(out)


def read_files(spark: SparkSession, root: str, paths: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """path, lang, text, mtime, size, hash of the source files of a tree.

    The folder must be visible to the executors. ``paths``: read only these.
    """
    root = os.path.realpath(root)
    listed = list_files(root) if paths is None else sorted(paths)
    names = [p for p in listed if not p.rsplit("/", 1)[-1].rpartition(".")[0] or language_of(p)]
    tasks = tasks or max(1, min(len(names) // 64 + 1, spark.sparkContext.defaultParallelism * 4))
    frame = spark.createDataFrame([(p,) for p in names], "path string").repartition(tasks) if names else spark.createDataFrame([], "path string")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, bodies = [], []
            for path in pdf["path"]:
                try:
                    full = os.path.join(root, path)
                    with open(full, "rb") as f:
                        data = f.read()
                    lang = language_of(path, data[:256])
                    if lang:
                        rows.append((path, lang, data.decode("utf-8"), int(os.stat(full).st_mtime), len(data)))
                        bodies.append(data)
                except (OSError, UnicodeDecodeError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "lang", "text", "mtime", "size"]).assign(hash=fnv1a_all(bodies))

    return frame.mapInPandas(read, SCHEMA)
