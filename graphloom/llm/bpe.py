"""Byte-pair encoding with a public vocabulary, exact and in linear time.

The vocabulary's byte strings, read as Latin-1, go into an automaton that gives the
longest token at a position. Within a pre-token the encoder takes the longest token that
is compatible with the one before it, falls back to shorter ones and, if none fits, takes
the previous token back; a position that failed once is never tried again, so the work
is linear. Two tokens are compatible if merging their bytes by the ranks would not join
anything across the border between them; that is decided by undoing merges on both sides
and is remembered per pair.

Nulls and edge cases
* a null and an empty text have an empty list of ids;
* special tokens are never produced, their strings are ordinary text;
* texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import spread

#: Pre-tokens kept with their ids; the table is emptied when it is full.
MAX_WORDS = 300_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def pre_token_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Encoder:
    """An encoder over a ``.tiktoken`` file whose ids are the ranks of its merges."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        self.text_of = {i: b.decode("latin-1") for b, i in ranks.items()}
        self.id_of = {s: i for i, s in self.text_of.items()}
        self.longest = max(map(len, self.id_of))
        self.trie = ahocorasick.Automaton()
        for s, i in self.id_of.items():
            self.trie.add_word(s, i)
        self._fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}
        self._shorter: dict[int, int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        # In the order of ranks, a token's last merge is the only cut into two earlier
        # tokens that no earlier merge would have crossed.
        for i in sorted(self.text_of):
            s = self.text_of[i]
            for k in range(len(s) - 1, 0, -1):
                a, b = self.id_of.get(s[:k]), self.id_of.get(s[k:])
                if a is not None and b is not None and a < i and b < i and self.fits(a, b):
                    self.merged[a, b] = i
                    self.parts[i] = (a, b)
                    break
            self._fits.clear()

    def fits(self, left: int, right: int) -> bool:
        """Whether ``left right`` can stand side by side in an encoding."""
        got = self._fits.get((left, right))
        if got is None:
            got = self._fits[left, right] = self._border_holds(left, right)
        return got

    def _border_holds(self, left: int, right: int) -> bool:
        # Walk back in time. The token of higher rank was merged last; before that its
        # part at the border stood there. A merge across the border of a rank below the
        # one just undone would have come first.
        bound = 1 << 62
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < bound:
                return False
            # Equal tokens: the left one is merged first, so the right one is undone first.
            for undo_left in ((True, False) if left > right else (False, True)):
                if undo_left:
                    halves = self.parts.get(left)
                    if halves:
                        bound, left = left, halves[1]
                        break
                else:
                    halves = self.parts.get(right)
                    if halves:
                        bound, right = right + 1, halves[0]
                        break
            else:
                return True

    def _prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``, or -1."""
        got = self._shorter.get(token)
        if got is None:
            s = self.text_of[token]
            n = len(s) - 1
            while n and s[:n] not in self.id_of:
                n -= 1
            got = self._shorter[token] = self.id_of[s[:n]] if n else -1
        return got

    def _longest_at(self, s: str, at: int) -> int:
        n = self.trie.longest_prefix(s[at:at + self.longest])
        while s[at:at + n] not in self.id_of:
            n -= 1
        return self.id_of[s[at:at + n]]

    def word(self, s: str) -> list[int]:
        """Ids of one pre-token, given as the Latin-1 reading of its bytes."""
        whole = self.id_of.get(s)
        if whole is not None and (whole in self.parts or len(s) == 1):
            return [whole]
        n, at, out = len(s), 0, []
        dead = bytearray(n + 1)
        token = self._longest_at(s, 0)
        while True:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + len(self.text_of[token])
                if not dead[end] and (last < 0 or self.fits(last, token)):
                    break
                token = self._prefix(token)
            if token < 0:
                dead[at] = 1
                token = out.pop()
                at -= len(self.text_of[token])
                token = self._prefix(token) if dead[at + len(self.text_of[token])] else token
                continue
            out.append(token)
            at = end
            if at == n:
                return out
            token = self._longest_at(s, at)

    def encode(self, text: str) -> list[int]:
        words, out = self.words, []
        for w in self.split(text):
            ids = words.get(w)
            if ids is None:
                if len(words) > MAX_WORDS:
                    words.clear()
                    self._fits.clear()
                ids = self.word(w.encode("utf-8").decode("latin-1"))
                if len(w) <= 64:
                    words[w] = ids
            out += ids
        return out

    def count(self, text: str) -> int:
        return len(self.encode(text))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One per process and file."""
    got = _ENCODERS.get((path, pattern))
    if got is None:
        got = _ENCODERS[path, pattern] = Encoder(path, pattern)
    return got


def encode_documents(
    documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """(key, ids): a map over rows, no shuffle. ``path`` must be readable on every executor."""
    path, pattern = path or tokenizer_path("byte_bpe_50k.tiktoken"), pattern or pre_token_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            texts = batch.column(1)
            ids = [enc.encode(t) if (t := texts[i].as_py()) else [] for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"]
            )

    kind = documents.schema[key].dataType.simpleString()
    return spread(documents.select(key, text)).mapInArrow(run, f"{key} {kind}, ids array<int>")


def count_tokens(
    documents: DataFrame, keep: list[str], text: str = "text", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """The columns ``keep`` and n_tokens, the number of ids of the text."""
    path, pattern = path or tokenizer_path("byte_bpe_50k.tiktoken"), pattern or pre_token_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            n = [enc.count(t) if (t := texts[i].as_py()) else 0 for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    kinds = ", ".join(f"{c} {documents.schema[c].dataType.simpleString()}" for c in keep)
    return spread(documents.select(*keep, F.col(text).alias("__text"))).mapInArrow(run, f"{kinds}, n_tokens long")


def merges_of(json_path: str) -> list[tuple[str, str]]:
    """The merge list of a tokenizers file, for tests."""
    with open(json_path) as f:
        merges = json.load(f)["model"]["merges"]
    return [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
