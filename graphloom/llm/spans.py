"""Texts to hashed words, sentences and windows of words, a batch at a time in NumPy.

The texts of a batch are laid end to end as code points and brought to bytes by one table
(case, accents, look-alike letters, other alphabets' letters of the same shape). Words,
sentence ends and disguises are then found for all of them at once:

* letters set apart by single blanks or marks (``i d i o t``, ``i.d.i.o.t``) are joined,
* digits and signs that stand for letters in a word become those letters,
* repeated letters count once, apostrophes, invisible and combining characters not at all,
  nor underscores between letters; a masked letter (``sh*t``) is a letter of its own.

A word is a 64-bit hash of what is left of it. Names and literals between backticks are
dropped; what reads as prose between them is a sentence of its own.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

#: Words of a window in a long sentence, the step between windows, and the longest sentence taken whole.
WINDOW, STRIDE, WHOLE = 12, 4, 14
#: Characters laid end to end at a time; longer texts are taken in pieces that overlap.
PIECE, OVERLAP = 1_000_000, 2_000

# Letters of other alphabets that look like Latin ones.
_LOOKALIKE = dict(zip("аеорсхуіјѕһԁԛԝкмтнвбгпзαεορντικυ", "aeopcxyijshdqwkmthbbrn3aeopvtiku", strict=True))
#: Signs that stand for letters within words.
_LEET = dict(zip("013457@$", "oieastas", strict=True))
_MASK = ""
_DROP, _MARK = 1, ord("{")
_BLOCKS = ((0, 0x3000), (0xF900, 0x10000), (0x1D400, 0x1D800), (0x1F100, 0x1F200))
_LIMIT = 0x1F200
_ODD, _PRIME = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
_CODE = re.compile(r"`[^`\n]*`")
_PLAIN = re.compile(r"[\"'(*]*[^\W\d_][^\W_]*(?:['’-][^\W_]+)*[\"')*.,:;!?…]*")
_STARS = re.compile(r"(?<=[A-Za-z])\*+(?=[A-Za-z])|(?<=[A-Za-z])\*{3,}")
_EXPAND = re.compile("[ﬀ-ﬆßæœ]")


def _letter(c: str) -> int:
    if c in ("'", "’", "‘", "ʼ") or unicodedata.category(c) in ("Cf", "Mn", "Me") or "\u180b" <= c <= "\u180f" or c == "\x7f":
        return _DROP
    if c == _MASK:
        return _MARK
    base = unicodedata.normalize("NFKD", c)[:1]
    if base.lower() in _LOOKALIKE:
        base = _LOOKALIKE[base.lower()].upper() if base.isupper() else _LOOKALIKE[base]
    if len(base) == 1 and base.isascii() and (base.isalnum() or base in "@$_.!?*-\"')]`"):
        return ord(base)
    if c in "\n\r\v\f\x1c\x1d\x1e\x85\u2028\u2029":
        return 10
    if c.isspace():
        return 32
    if c in "…‥":
        return ord(".")
    if c in "·•‧∙":
        return ord("*")
    if c in "”»“«›":
        return ord('"')
    return ord("~") if c.isalpha() else ord(",")


class _Tables:
    """The table of code points, and tables of bytes for ``bytes.translate``."""

    def __init__(self):
        self.fold = np.full(_LIMIT + 1, ord("~"), np.uint8)
        for a, b in _BLOCKS:
            for i in range(a, min(b, _LIMIT)):
                self.fold[i] = _letter(chr(i))
        self.ascii = bytes(self.fold[i] if 0 < i < 128 else i for i in range(256))
        self.drop = bytes([_DROP])
        of = lambda s: bytes(chr(i) in s for i in range(256))
        self.lower = bytes(ord(chr(i).lower()) if i < 128 else i for i in range(256))
        self.upper = of("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        letters, special = "abcdefghijklmnopqrstuvwxyz{", "@$0123456789"
        self.alpha, self.special, self.word = of(letters), of(special), of(letters + special + "~")
        self.lone, self.end, self.between = of(letters + special), of(".!?"), of("._*-")
        self.after = of(" \n\"')]*_")
        leet = dict(_LEET)
        self.leet = bytes(ord(leet.get(chr(i), chr(i))) if i < 128 else i for i in range(256))
        self.value = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)

    def text(self, text: str) -> bytes:
        if text.isascii():
            return text.encode("ascii").translate(self.ascii, self.drop + b"'\x7f")
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.fold[np.minimum(points, _LIMIT)].tobytes().translate(None, self.drop + b"\0")


_T: _Tables | None = None


def _tables() -> _Tables:
    global _T
    if _T is None:
        _T = _Tables()
    return _T


def _is(data: bytes, table: bytes) -> np.ndarray:
    return np.frombuffer(data.translate(table), np.bool_)


def is_prose(code: str) -> bool:
    """Whether what stands between backticks reads as words: three at least, and half of it."""
    parts = code.split()
    return len(parts) > 2 and sum(_PLAIN.fullmatch(x) is not None for x in parts) >= max(3, len(parts) / 2)


def prepare(text: str) -> str:
    """Code names dropped, prose between backticks after the rest, masks and ligatures spelt out."""
    if "`" in text:
        quoted = [x for m in _CODE.findall(text) if is_prose(x := m[1:-1])]
        text = "\n".join([_CODE.sub(" ", text), *quoted])
    if "*" in text:
        text = _STARS.sub(_MASK, text)
    if not text.isascii() and _EXPAND.search(text):
        text = _EXPAND.sub(lambda m: {"ß": "ss", "æ": "ae", "œ": "oe"}.get(m.group()) or unicodedata.normalize("NFKD", m.group()), text)
    return text


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD
    return h ^ (h >> np.uint64(29))


class Words:
    """Words of some texts: hash, hash of the first letters, number of sentence and text, letters."""

    __slots__ = ("hash", "stem", "sentence", "text", "length")

    def __init__(self, texts: list[str]):
        t = _tables()
        cased = b"\0".join(map(t.text, texts))
        data = cased.translate(t.lower)
        b = np.frombuffer(data, np.uint8)
        upper = _is(cased, t.upper)
        taken = self._taken_out(t, data, b)
        if taken is not None:
            b, upper = b[~taken], upper[~taken]
            data = b.tobytes()
        word = _is(data, t.word)
        if not word.any():
            self.hash = self.stem = np.zeros(0, np.uint64)
            self.sentence = self.text = self.length = np.zeros(0, np.int64)
            return
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        # Sentence ends: a line end, or a mark followed by a blank, a closing mark or a capital.
        cut = _is(data, t.end).copy()
        cut[:-1] &= _is(data, t.after)[1:] | upper[1:]
        cut |= b == 10
        zero = b == 0
        cut |= zero
        first = np.flatnonzero(begins)
        self.sentence = np.cumsum(cut, dtype=np.int32)[first]
        self.text = np.cumsum(zero, dtype=np.int32)[first] if len(texts) > 1 else np.zeros(len(first), np.int32)
        chars = data.translate(None, bytes(i for i in range(256) if not t.word[i]))
        c = np.frombuffer(chars, np.uint8)
        new = begins[word]
        owner = np.cumsum(new, dtype=np.int32) - 1
        starts = np.flatnonzero(new)
        length = np.diff(starts, append=len(c))
        alpha = _is(chars, t.alpha)
        special = _is(chars, t.special)
        if special.any():
            odd = np.zeros(len(starts), bool)
            odd[owner[special]] = True
            odd &= np.maximum.reduceat(alpha, starts)
            swap = odd[owner] & special
            if swap.any():
                c = np.where(swap, np.frombuffer(chars.translate(t.leet), np.uint8), c)
                alpha = alpha | swap
        same = np.zeros(len(c), bool)
        same[1:] = (c[1:] == c[:-1]) & ~new[1:] & alpha[1:]
        if same.any():
            kept = ~same
            c, owner, new = c[kept], owner[kept], new[kept]
            starts = np.flatnonzero(new)
        squeezed = np.diff(starts, append=len(c))
        k = np.arange(len(c), dtype=np.int32) - np.repeat(starts.astype(np.int32), squeezed)
        powers = np.full(int(squeezed.max()) + 1, _PRIME, np.uint64)
        powers[0] = 1
        parts = t.value[c] * np.cumprod(powers)[k]
        h = np.add.reduceat(parts, starts)
        h[(squeezed == 1) & (length == 3)] += np.uint64(3)
        parts[k >= 5] = 0
        self.hash, self.stem = mix(h), mix(np.add.reduceat(parts, starts))
        self.length = squeezed

    @staticmethod
    def _taken_out(t: _Tables, data: bytes, b: np.ndarray) -> np.ndarray | None:
        """What separates single letters (four and more by blanks, three and more by marks), and inner underscores."""
        if len(b) < 5:
            return None
        alpha, word = _is(data, t.alpha), _is(data, t.word)
        inner = np.zeros(len(b), bool)
        inner[1:-1] = (b[1:-1] == 95) & alpha[:-2] & alpha[2:]
        lone = _is(data, t.lone).copy()
        lone[1:] &= ~word[:-1]
        lone[:-1] &= ~word[1:]
        if np.count_nonzero(lone) > 2:
            for marks, least in ((_is(data, t.between), 3), (b == 32, 4)):
                gap = np.zeros(len(b), bool)
                gap[1:-1] = marks[1:-1] & lone[:-2] & lone[2:]
                where = np.flatnonzero(gap)
                if len(where):
                    # Gaps two apart belong to one run of letters.
                    run = np.cumsum(np.diff(where, prepend=where[0]) != 2)
                    inner[where[np.bincount(run)[run] >= least - 1]] = True
        return inner if inner.any() else None


def pieces(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Prepared texts and which text each is of; a very long one in several overlapping pieces."""
    out, of = [], []
    for i, x in enumerate(texts):
        if not x:
            continue
        x = prepare(x)
        at = 0
        while True:
            out.append(x[at:at + PIECE])
            of.append(i)
            at += PIECE - OVERLAP
            if at + OVERLAP >= len(x):
                break
    return out, np.array(of, np.int64)


def windows(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of every sentence and, where it is long, of the windows within it."""
    n = len(w.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate([[True], (np.diff(w.sentence) != 0) | (np.diff(w.text) != 0)])
    a = np.flatnonzero(new)
    e = np.concatenate([a[1:], [n]])
    long_ = (e - a) > WHOLE
    if long_.any():
        la, le = a[long_], e[long_]
        count = -(-(le - la - WINDOW) // STRIDE) + 1
        base = np.repeat(la, count)
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        wa = base + step * STRIDE
        we = np.minimum(wa + WINDOW, np.repeat(le, count))
        a, e = np.concatenate([a, wa]), np.concatenate([e, we])
        order = np.argsort(a, kind="stable")
        a, e = a[order], e[order]
    return a, e
