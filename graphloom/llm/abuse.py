"""Abusive, hateful or sexual content, scored per document.

A document is cut into sentences and lines, long ones into overlapping windows of words
(:mod:`graphloom.llm.spans`, which also undoes common disguises). Each is scored by a
logistic model over hashed words, their first letters, word classes, neighbours, and the
classes that meet. The score of a document is that of its worst window, so a few words in
a very long text count.

The model is fitted on short general phrases (:mod:`graphloom.llm.lexicon`) and a bounded
sample of reviewed documents. A review says something of a whole document; which of its
windows earned the label is inferred: a window is the likelier one the more its features
are those of positive documents *other than this one* (counts leave the document itself
out) and not of clean ones, and the more the phrases speak for it. A positive document
without such a window is a label that nothing else supports and is set aside.

The fit is regularised by counterfactuals: wherever a labelled sentence has an identity
term, the sentences with other identity terms are added, and differences of score within
such a set are penalised; so naming a group does not raise a score.

Nulls and edge cases
* a null or empty text has score 0; blank and symbol-only texts too;
* a null source is a source of its own in the rates;
* reviews of unknown documents, with null labels, or of texts over ``MAX_TRAIN_CHARS``
  are not used for fitting; with no usable review the phrases alone are;
* rows without doc_id are left out; repeated rows of a document have its highest score.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import lexicon, spans
from graphloom.runtime import spread

#: Bounds of the sample of reviewed documents that the model is fitted on.
MAX_TRAIN_DOCS = 6_000
MAX_TRAIN_CHARS = 20_000
#: Windows of clean documents in the fit: the hardest half and a sample of the rest.
MAX_CLEAN_WINDOWS = 6_000
#: Weight of the assumption that words never seen are clean, in sentences.
PRIOR = 60.0
#: Probability from which a document counts as found.
THRESHOLD = 0.65
#: Characters scored at a time, small enough for the arrays to stay in the cache.
CHUNK = 150_000

_BITS = 20
_MASK = np.uint64((1 << _BITS) - 1)
_NAMES = list(lexicon.CLASSES)
_PAIRS = [(i, j) for i in range(len(_NAMES)) for j in range(i + 1, len(_NAMES))]


def _salt(n: int) -> np.uint64:
    return np.uint64((0x9E3779B97F4A7C15 * (2 * n + 1)) & 0xFFFFFFFFFFFFFFFF)


def _slot(h: np.ndarray, n: int) -> np.ndarray:
    return (spans.mix(h + _salt(n)) & _MASK).astype(np.int32)


_CLASS_HASH = spans.mix(np.arange(1, len(_NAMES) + 2, dtype=np.uint64) * _salt(50))
_PAIR_SLOT = _slot(np.arange(len(_PAIRS), dtype=np.uint64), 60)
_SHORT_SLOT = _slot(np.arange(len(_NAMES) + 1, dtype=np.uint64), 61)
_CLASSES: tuple[np.ndarray, np.ndarray] | None = None


def _class_table() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words that have a class, sorted, and their classes from 1."""
    global _CLASSES
    if _CLASSES is None:
        found: dict[int, int] = {}
        for at, text in enumerate(lexicon.CLASSES.values(), 1):
            items = text.split()
            forms = [x + e for e in ("", "s") for x in items] if at > 2 else items
            for h in spans.Words(["\n".join(forms)]).hash.tolist():
                found.setdefault(h, at)
        keys = np.array(sorted(found), np.uint64)
        _CLASSES = keys, np.array([found[int(k)] for k in keys], np.uint8)
    return _CLASSES


class Features:
    """Slots of the features at each word; ``span`` says over how many words a feature reaches."""

    def __init__(self, w: spans.Words):
        keys, of = _class_table()
        h = w.hash
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        self.cls = np.where(keys[at] == h, of[at], 0).astype(np.uint8)
        held = self.cls > 0
        mixed = np.where(held, _CLASS_HASH[self.cls], h)
        none = np.full(len(h), -1, np.int32)
        stem = np.where(w.length > 5, _slot(w.stem, 2), none)
        cls = np.where(held, _slot(mixed, 3), none)
        self.parts = [(_slot(h, 1), 1), (stem, 1), (cls, 1)]
        if len(h) > 1:
            both = held[1:] | held[:-1]
            pair = np.append(_slot(h[:-1] * spans._ODD + h[1:], 4), np.int32(-1))
            kinds = np.append(np.where(both, _slot(mixed[:-1] * spans._ODD + mixed[1:], 5), none[1:]), np.int32(-1))
            self.parts += [(pair, 2), (kinds, 2)]
        if len(h) > 2:
            far = held[2:] | held[:-2]
            skip = np.append(np.where(far, _slot(mixed[:-2] * spans._ODD + mixed[2:], 6), none[2:]), none[:2])
            self.parts.append((skip, 3))
        self.first = _slot(mixed, 7)
        new = np.ones(len(h), bool)
        new[1:] = (np.diff(w.sentence) != 0) | (np.diff(w.text) != 0)
        self.opens = new

    def met(self, a: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Bits of the classes that occur from each ``a`` up to ``e``."""
        if not len(a):
            return np.zeros(0, np.int64)
        bits = np.append(np.where(self.cls > 0, np.left_shift(1, self.cls.astype(np.int64) - 1), 0), 0)
        return np.bitwise_or.reduceat(bits, np.stack([a, e], 1).ravel())[::2]


def _matrix(f: Features, a: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every feature of every window."""
    rows, slots = [], []
    for values, span in f.parts:
        count = np.maximum(e - a - span + 1, 0)
        row = np.repeat(np.arange(len(a)), count)
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
        got = values[at]
        rows.append(row[got >= 0])
        slots.append(got[got >= 0])
    n = np.arange(len(a))
    open_ = f.opens[a]
    rows.append(n[open_])
    slots.append(f.first[a[open_]])
    met = f.met(a, e)
    for k, (i, j) in enumerate(_PAIRS):
        here = n[(met >> i & 1 & met >> j) != 0]
        rows.append(here)
        slots.append(np.full(len(here), _PAIR_SLOT[k], np.int32))
    short = e - a <= 4
    for k in range(len(_NAMES) + 1):
        here = n[short & ((met >> max(0, k - 1) & 1 != 0) | (k == 0))]
        rows.append(here)
        slots.append(np.full(len(here), _SHORT_SLOT[k], np.int32))
    return np.concatenate(rows), np.concatenate(slots)


class Model:
    """Weights by slot, kept sparse when it travels; at most a few ten thousand of them."""

    def __init__(self, slots: np.ndarray, weights: np.ndarray, bias: float):
        self.slots, self.weights, self.bias = slots, weights.astype(np.float32), bias
        self._table = None

    def __getstate__(self):
        return self.slots, self.weights, self.bias

    def __setstate__(self, state):
        self.slots, self.weights, self.bias = state
        self._table = None

    def _tables(self):
        if self._table is None:
            table = np.zeros((1 << _BITS) + 1, np.float32)  # the last one, -1, is no feature
            table[self.slots] = self.weights
            met = np.arange(1 << len(_NAMES))
            pairs, short = np.zeros(len(met), np.float32), np.full(len(met), table[_SHORT_SLOT[0]])
            for k, (i, j) in enumerate(_PAIRS):
                pairs += table[_PAIR_SLOT[k]] * (met >> i & 1 & met >> j)
            for k in range(len(_NAMES)):
                short += table[_SHORT_SLOT[k + 1]] * (met >> k & 1)
            self._table = table, pairs, short
        return self._table

    def windows(self, w: spans.Words, a: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Logit of every window."""
        table, pairs, short = self._tables()
        f = Features(w)
        total = np.zeros(len(a))
        sums: dict[int, np.ndarray] = {}
        for slots, span in f.parts:
            got = table[slots]
            sums[span] = got if span not in sums else sums[span] + got
        for span, got in sums.items():
            running = np.concatenate([[0.0], np.cumsum(got, dtype=np.float64)])
            total += running[np.maximum(e - span + 1, a)] - running[a]
        total += np.where(f.opens[a], table[f.first[a]], 0)
        met = f.met(a, e)
        total += pairs[met] + np.where(e - a <= 4, short[met], 0)
        return self.bias + total / np.sqrt(e - a)

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Logit of the worst window of every text; -inf without words."""
        out = np.full(len(texts), -np.inf)
        parts, of = spans.pieces(texts)
        at = 0
        while at < len(parts):
            end, size = at, 0
            while end < len(parts) and (end == at or size + len(parts[end]) <= CHUNK):
                size += len(parts[end])
                end += 1
            w = spans.Words(parts[at:end])
            a, e = spans.windows(w)
            if len(a):
                np.maximum.at(out, of[at:end][w.text[a]], self.windows(w, a, e))
            at = end
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of the worst window of every text; 0 without words."""
        z = self.logits(texts)
        return np.where(np.isfinite(z), 1 / (1 + np.exp(-np.clip(z, -700, 700))), 0.0)


# -- fitting

def _expand(pattern: str, rng: random.Random, times: int, lang: str) -> list[list[str]]:
    """Sets of sentences of a pattern; those of one set differ in identity terms only."""
    out = []
    for _ in range(times):
        text = re.sub(r"\{(?!group)(\w+)\}", lambda m: rng.choice(lexicon.SLOTS[m.group(1)]), pattern)
        if "{group}" in text:
            terms = lexicon.IDENTITY[lang]
            pick = rng.sample(terms, min(6, len(terms)))
            out.append([text.replace("{group}", g).replace("{group2}", pick[i - 1]) for i, g in enumerate(pick)])
        else:
            out.append([text])
    return out


def seed_sentences(seed: int = 5, leave_out=None) -> list[tuple[list[str], int]]:
    """(set of sentences, label) of all phrases. ``leave_out(i)`` drops phrases, for tests."""
    rng, out, at = random.Random(seed), [], 0
    for text, label in (
        (lexicon.ABUSIVE, 1), (lexicon.ABUSIVE_OTHER, 1), (lexicon.HATEFUL, 1), (lexicon.HATEFUL_OTHER, 1), (lexicon.SEXUAL, 1),
        (lexicon.CLEAN, 0), (lexicon.CLEAN_OTHER, 0),
    ):
        for line in text.strip().split("\n"):
            lang, _, rest = line.partition("|") if line[2:3] == "|" else ("en", "", line)
            at += 1
            if leave_out and leave_out(at):
                continue
            for group in _expand(rest, rng, 8 if "{" in rest else 4, lang):
                out.append((group, label))
    return out


class _Rows:
    """Training rows: features, label, weight and counterfactual set of each."""

    def __init__(self):
        self.row, self.slot, self.size = [], [], []
        self.label, self.weight, self.set = [], [], []
        self.n = self.sets = 0

    def add(self, row, slot, size, label, weight, sets) -> None:
        self.row.append(row + self.n)
        self.slot.append(slot)
        self.size.append(size)
        self.label.append(label)
        self.weight.append(weight)
        self.set.append(sets + self.sets)
        self.n += len(size)
        self.sets += int(sets.max()) + 1 if len(sets) else 0

    def add_texts(self, groups: list[tuple[list[str], int]], weight: float) -> None:
        """Short sentences, each as one window."""
        texts = [" ".join(t.split()) for g, _ in groups for t in g]
        owner = np.concatenate([np.full(len(g), i) for i, (g, _) in enumerate(groups)])
        label = np.array([y for g, y in groups for _ in g], float)
        share = np.array([weight / len(g) for g, _ in groups for _ in g])
        w = spans.Words(texts)
        a = np.flatnonzero(np.concatenate([[True], np.diff(w.text) != 0]))
        e = np.append(a[1:], len(w.hash))
        of = w.text[a]
        self.add_windows(Features(w), a, e, label[of], share[of], owner[of])

    def add_windows(self, f: Features, a, e, label, weight, sets) -> None:
        row, slot = _matrix(f, a, e)
        self.add(row, slot, 1 / np.sqrt(e - a), label, weight, sets)

    def fit(self, l2: float = 2e-5, fair: float = 2.0, steps: int = 90) -> Model:
        """Logistic regression with penalties on weights and on differences within sets."""
        row, slot = np.concatenate(self.row), np.concatenate(self.slot)
        used, c = np.unique(slot, return_inverse=True)
        size, y = np.concatenate(self.size), np.concatenate(self.label)
        order = np.argsort(row, kind="stable")
        row, c = row[order], c[order]
        v = size[row]
        sw, s = np.concatenate(self.weight), np.concatenate(self.set)
        sw = sw / sw.sum()
        n, d = self.n, len(used)
        counts = np.maximum(np.bincount(s), 1)
        twins = counts[s] > 1
        w, b = np.zeros(d), 0.0
        m, u, mb, ub = np.zeros(d), np.zeros(d), 0.0, 0.0
        for t in range(1, steps + 1):
            z = b + np.bincount(row, v * w[c], n)
            g = sw * (1 / (1 + np.exp(-z)) - y)
            if fair:  # within a counterfactual set scores should be equal
                mean = np.bincount(s, z) / counts
                g = g + fair * (z - mean[s]) * twins / n
            gw = np.bincount(c, v * g[row], d) + l2 * w
            gb = g.sum()
            m, u = 0.9 * m + 0.1 * gw, 0.999 * u + 0.001 * gw * gw
            mb, ub = 0.9 * mb + 0.1 * gb, 0.999 * ub + 0.001 * gb * gb
            step = 0.15 * (1 - t / (steps + 20))
            w -= step * (m / (1 - 0.9**t)) / (np.sqrt(u / (1 - 0.999**t)) + 1e-9)
            b -= step * (mb / (1 - 0.9**t)) / (np.sqrt(ub / (1 - 0.999**t)) + 1e-9)
        keep = np.abs(w) > 1e-3
        return Model(used[keep], w[keep], float(b))


def _base(leave_out, seed: int) -> _Rows:
    rows = _Rows()
    groups = seed_sentences(seed, leave_out)
    if groups:
        rows.add_texts(groups, 1.0)
    # What nothing is known about is clean.
    none = np.zeros(0, np.int64)
    rows.add(none, none.astype(np.int32), np.ones(1), np.zeros(1), np.array([PRIOR]), np.zeros(1, np.int64))
    return rows


class _Reviewed:
    """Windows of the reviewed documents and which of them earned the labels."""

    def __init__(self, docs: list[tuple[str, bool]], prior: Model):
        texts = [t for t, _ in docs]
        self.positive = np.array([p for _, p in docs], bool)
        parts, of = spans.pieces(texts)
        w = spans.Words(parts) if parts else None
        self.a, self.e = spans.windows(w) if parts else (np.zeros(0, np.int64),) * 2
        if not len(self.a):
            return
        self.words, self.f = w, Features(w)
        self.doc = of[w.text[self.a]]
        self.sentence = np.unique(np.stack([w.text[self.a], w.sentence[self.a]], 1), axis=0, return_inverse=True)[1].ravel()
        self.pos = self.positive[self.doc]
        self.row, slot = _matrix(self.f, self.a, self.e)
        self.used, self.c = np.unique(slot, return_inverse=True)
        self.size = 1 / np.sqrt(self.e - self.a)
        self.prior = prior.windows(w, self.a, self.e)
        self.key = np.bincount(self.row, (spans.mix(slot.astype(np.uint64)) >> np.uint64(20)).astype(float), len(self.a))

    def _documents(self, chosen: np.ndarray) -> np.ndarray:
        """In how many documents each feature occurs in a chosen window."""
        at = chosen[self.row]
        pair = np.unique(self.doc[self.row[at]].astype(np.int64) * len(self.used) + self.c[at])
        return np.bincount(pair % len(self.used), minlength=len(self.used))

    def pick(self, rounds: int = 3) -> np.ndarray:
        """The window of each positive document that its label is about; documents may go without."""
        clean = self._documents(~self.pos).astype(float)
        n_clean, n_pos = max(1, (~self.positive).sum()), max(1, self.positive.sum())
        chosen = self.pos.copy()
        best = np.zeros(0, np.int64)
        for k in range(rounds):
            held = self._documents(chosen).astype(float)
            # The window's own document is left out of the counts of what it could have been chosen for.
            mine = chosen if k == 0 else self._of_chosen(best)
            own = mine[self.row].astype(float)
            ratio = np.log((np.maximum(held[self.c] - own, 0) + 0.25) / n_pos) - np.log((clean[self.c] + 0.25) / n_clean)
            bits = np.bincount(self.row, ratio, len(self.a)) * self.size
            score = np.where(self.pos, bits * 0.5 + np.clip(self.prior, -4, 4), -np.inf)
            order = np.lexsort((-score, self.doc))
            order = order[self.pos[order]]
            lead = np.ones(len(order), bool)
            lead[1:] = self.doc[order[1:]] != self.doc[order[:-1]]
            best = order[lead]
            best = best[score[best] > self.least]
            chosen = np.zeros(len(self.a), bool)
            chosen[best] = True
        self.score = score
        return best

    least = 1.0

    def _of_chosen(self, best: np.ndarray) -> np.ndarray:
        """Windows of documents whose chosen window shares its features: their own count is theirs."""
        own = np.zeros(len(self.a), bool)
        own[best] = True
        return own

    def swapped(self, picked: np.ndarray) -> tuple[spans.Words, np.ndarray, np.ndarray, np.ndarray] | None:
        """Copies of windows that name a group, with other groups of the language: words, bounds, original."""
        swaps = _identity_swaps()
        h, parts, of = self.words.hash, [], []
        named = np.isin(h, np.array(list(swaps), np.uint64))
        for i in picked:
            a, e = int(self.a[i]), int(self.e[i])
            where = np.flatnonzero(named[a:e])
            if len(where):
                for other, stem, length in swaps[int(h[a + where[0]])][:5]:
                    parts.append((a, e, a + int(where[0]), other, stem, length))
                    of.append(i)
        if not parts:
            return None
        w = spans.Words([])
        ids = np.concatenate([np.arange(a, e) for a, e, *_ in parts])
        sizes = np.array([e - a for a, e, *_ in parts])
        ends = np.cumsum(sizes)
        w.hash, w.stem, w.length = h[ids].copy(), self.words.stem[ids].copy(), self.words.length[ids].copy()
        spot = ends - sizes + np.array([p[2] - p[0] for p in parts])
        w.hash[spot] = [p[3] for p in parts]
        w.stem[spot] = [p[4] for p in parts]
        w.length[spot] = [p[5] for p in parts]
        w.text = np.repeat(np.arange(len(parts)), sizes)
        w.sentence = np.zeros(len(ids), np.int64)
        return w, ends - sizes, ends, np.array(of)


_SWAPS: dict[int, list[tuple]] | None = None


def _identity_swaps() -> dict[int, list[tuple]]:
    global _SWAPS
    if _SWAPS is None:
        _SWAPS = {}
        for terms in lexicon.IDENTITY.values():
            w = spans.Words(["\n".join(terms)])
            items = list(zip(w.hash, w.stem, w.length))
            for i, x in enumerate(items):
                _SWAPS[int(x[0])] = [items[(i + k) % len(items)] for k in range(1, len(items))]
    return _SWAPS


def fit(reviewed: list[tuple[str, bool]], leave_out=None, seed: int = 5, fair: float = 2.0) -> Model:
    """Fit on the phrases and on reviewed (text, positive) documents."""
    rows = _base(leave_out, seed)
    model = rows.fit(fair=fair)
    known = _Reviewed([(t, p) for t, p in reviewed if t], model)
    if not len(known.a):
        return model
    best = known.pick()
    # Negatives: windows of clean documents, equal ones once, the hardest half and a sample of the rest.
    clean = np.flatnonzero(~known.pos)
    _, one = np.unique(known.key[clean], return_index=True)
    clean = clean[one]
    if len(clean) > MAX_CLEAN_WINDOWS:
        clean = clean[np.argsort(-known.prior[clean], kind="stable")]
        half = MAX_CLEAN_WINDOWS // 2
        rest = np.random.default_rng(seed).permutation(len(clean) - half)[:half] + half
        clean = np.concatenate([clean[:half], clean[np.sort(rest)]])
    # Other sentences of positive documents are clean unless they look alike.
    own = set(known.sentence[best].tolist())
    rest = np.flatnonzero(known.pos & (known.score < 0.0) & ~np.isin(known.sentence, list(own)))
    rest = rest[np.isin(known.doc[rest], known.doc[best])]
    _, one = np.unique(known.key[rest], return_index=True)
    rest = rest[one]
    picked = np.concatenate([best, clean, rest])
    label = np.concatenate([np.ones(len(best)), np.zeros(len(clean) + len(rest))])
    weight = np.concatenate([np.full(len(best), 1.0), np.full(len(clean) + len(rest), 0.5)])
    copies = known.swapped(picked)
    place = {int(i): k for k, i in enumerate(picked)}
    share = np.ones(len(picked))
    if copies is not None:
        w, a, e, of = copies
        k = np.array([place[int(i)] for i in of])
        share = 1 / (1 + np.bincount(k, minlength=len(picked)))
    base = rows.sets
    rows.add_windows(known.f, known.a[picked], known.e[picked], label, weight * share, np.arange(len(picked)))
    if copies is not None:
        rows.sets = base
        rows.add_windows(Features(w), a, e, label[k], (weight * share)[k], k)
        rows.sets = base + len(picked)
    return rows.fit(fair=fair)


def training_sample(documents: DataFrame, reviews: DataFrame) -> list[tuple[str, bool]]:
    """At most ``MAX_TRAIN_DOCS`` reviewed texts, the same ones on every run; at most half of them positive.

    A document with several reviews is positive if most of them are not ``clean``.
    """
    votes = (
        reviews.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .groupBy("doc_id")
        .agg(F.avg((F.col("label") != "clean").cast("int")).alias("share"))
        .select("doc_id", (F.col("share") > 0.5).alias("positive"))
    )

    def part(positive: bool, most: int) -> DataFrame:
        # Chosen before the join: at most MAX_TRAIN_DOCS keys meet the texts.
        side = votes.filter(F.col("positive") == positive)
        return side.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    bad = part(True, MAX_TRAIN_DOCS // 2)
    picked = bad.unionByName(part(False, MAX_TRAIN_DOCS - bad.count()))
    texts = documents.filter(F.length("text").between(1, MAX_TRAIN_CHARS)).select("doc_id", "text")
    rows = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "positive").distinct().collect()
    return [(r["text"], r["positive"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))]


def score_documents(documents: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The columns ``keep`` and score: a map over rows; the model travels with the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            # A text at a time leaves Arrow, so a batch of long ones is never held twice.
            out, at = [], 0
            while at < len(texts):
                part, size = [], 0
                while at < len(texts) and size < 4 * CHUNK:
                    part.append(texts[at].as_py())
                    size += len(part[-1] or "")
                    at += 1
                out.append(model.scores(part))
            scores = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*keep, "score"])

    kinds = ", ".join(f"{c} {documents.schema[c].dataType.simpleString()}" for c in keep)
    return spread(documents.select(*keep, F.col("text").alias("__text"))).mapInArrow(run, f"{kinds}, score double")


def scored(documents: DataFrame, reviews: DataFrame) -> DataFrame:
    """(doc_id, source, score) by a model fitted on the reviews."""
    model = fit(training_sample(documents, reviews))
    return score_documents(documents.filter(F.col("doc_id").isNotNull()), model)


def found(documents: DataFrame, reviews: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score) of documents at or above the threshold."""
    over = scored(documents, reviews).filter(F.col("score") >= threshold)
    return over.groupBy("doc_id").agg(F.max("score").alias("score"))


def rates(documents: DataFrame, reviews: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents, found ones and mean score per source."""
    return (
        scored(documents, reviews)
        .groupBy("source")
        .agg(
            F.count(F.lit(1)).alias("documents"),
            F.count_if(F.col("score") >= threshold).alias("found"),
            (F.count_if(F.col("score") >= threshold) / F.count(F.lit(1))).alias("rate"),
            F.avg("score").alias("mean_score"),
        )
    )
