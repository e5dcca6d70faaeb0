"""Token streams and grammars of the eight languages.

``failure(lang, text)`` is None for a text that parses, else (line, token, reason):
reason is ``token`` if that token has an empty derivative, ``end`` if the text stops
where its grammar wants more.
"""

from __future__ import annotations

import importlib

MODULES = {
    "python": ("python", "python"),
    "typescript": ("ecma", "typescript"),
    "tsx": ("ecma", "tsx"),
    "javascript": ("ecma", "javascript"),
    "go": ("golang", "go"),
    "rust": ("rust", "rust"),
    "shell": ("shell", "shell"),
    "yaml": ("yaml", "yaml"),
}
_LOADED: dict[str, object] = {}


def parser(lang: str):
    """The parser of ``lang``, one per process; None for a language without grammar."""
    if lang not in MODULES:
        return None
    got = _LOADED.get(lang)
    if got is None:
        module, name = MODULES[lang]
        got = _LOADED[lang] = importlib.import_module(f"{__name__}.{module}").make(name)
    return got


def forget(lang: str) -> None:
    """Have the parser of ``lang`` begun anew."""
    _LOADED.pop(lang, None)


def failure(lang: str, text: str) -> tuple[int, str, str] | None:
    p = parser(lang)
    if p is None or not text:
        return None
    text = text.removeprefix("﻿")
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return p.failure(text)
