"""What the lexers share."""

from __future__ import annotations

MAX_KINDS = 400_000


class Kinds(dict):
    """Kind of a token by its text, found once per text; None is skipped."""

    def __init__(self, classify):
        super().__init__()
        self._classify = classify

    def __missing__(self, token):
        if len(self) > MAX_KINDS:
            self.clear()
        kind = self[token] = self._classify(token)
        return kind


def line_of(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1
