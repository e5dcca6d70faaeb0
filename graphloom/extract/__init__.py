"""Definitions, calls, bindings and imports of one source file.

``extract(lang, text)`` is a dict of the arrays in :data:`graphloom.schema.EXTRACT`:
symbols with 1-based line spans; per symbol its parent (ordinal) and container; calls
with the ordinal of the calling symbol and the receiver's text; bindings of names to
types with their owning symbol; import specifiers.

Files that do not parse are still extracted: Python falls back from its own parser to
a reading of indentation, the other languages are read from their bracket structure.
"""

from __future__ import annotations

from graphloom.extract import braces, pythonic, scripts
from graphloom.extract.common import finish

_READERS = {
    "python": pythonic.read,
    "typescript": braces.read_ts,
    "tsx": braces.read_ts,
    "javascript": braces.read_ts,
    "go": braces.read_go,
    "rust": braces.read_rust,
    "shell": scripts.read_shell,
    "yaml": scripts.read_yaml,
}


def extract(lang: str | None, text: str | None) -> dict:
    """Empty arrays for a null text or a language without reader."""
    reader = _READERS.get(lang or "")
    if reader is None or not text:
        return finish("", [], [], [], [])
    text = text.removeprefix("﻿")
    return finish(text, *reader(text))
