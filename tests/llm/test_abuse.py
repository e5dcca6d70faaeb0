"""Abuse scoring: disguises, plain and clean cases, counterfactuals, held-out phrases, learning from reviews."""

import os
import pickle
import re

import numpy as np
import pytest

from graphloom.llm import abuse, lexicon, spans

PHRASES = ("ABUSIVE", "ABUSIVE_OTHER", "HATEFUL", "HATEFUL_OTHER", "SEXUAL", "CLEAN", "CLEAN_OTHER")


@pytest.fixture(scope="module")
def model():
    return abuse.fit([])


def hashes(text):
    return spans.Words([spans.prepare(text)]).hash.tolist()


def test_disguises():
    plain = hashes("you stupid idiot")
    for t in ("yоu stuріd іdiоt", "you st​up​id idiot", "YOU STUPIIIIID IDIOT", "you 5tup1d 1d10t", "you stu_pid idi_ot", "yóu stüpid ｉｄｉｏｔ"):
        assert hashes(t) == plain, t
    for t in ("i d i o t", "i.d.i.o.t", "i*d*i*o*t", "I-D-I-O-T"):
        assert plain[2] in hashes(f"such an {t} here"), t
    assert hashes("f*ck") == hashes("f**k")[:0] + hashes("F*CK")
    assert hashes("a b c") != hashes("abc") and len(hashes("a b c")) == 3


def test_sentences_and_windows():
    w = spans.Words(["One two. Three\nfour e.g. Five", "six"])
    assert len(set(zip(w.text.tolist(), w.sentence.tolist()))) == 5
    long_ = spans.Words([" ".join(f"w{i}" for i in range(40))])
    a, e = spans.windows(long_)
    covered = np.zeros(40, bool)
    for x, y in zip(a[e - a <= spans.WINDOW], e[e - a <= spans.WINDOW]):
        covered[x:y] = True
    assert covered.all() and (a[0], e[0]) == (0, 40)


def test_window_sums_are_those_of_the_matrix(model):
    """Running sums give what the features of each window add up to."""
    w = spans.Words(["you are a stupid idiot and so on and on for quite a while, my friends, women and men alike", "ok", "kill the cache now"])
    a, e = spans.windows(w)
    f = abuse.Features(w)
    row, slot = abuse._matrix(f, a, e)
    table = np.zeros(1 << abuse._BITS)
    table[model.slots] = model.weights
    want = model.bias + np.bincount(row, table[slot], len(a)) / np.sqrt(e - a)
    assert np.allclose(want, model.windows(w, a, e), atol=1e-4)


def test_plain_cases(model):
    bad = ["You are a worthless piece of trash, you idiot.", "Shut up, you filthy liar.", "I will kill you.", "du bist ein nutzloser Idiot",
           "pauvre abruti", "eres un imbécil", "Refugees are vermin.", "They wrote `you are a worthless asshole` in it.",
           "The ` key is stuck. Shut up, you filthy liar. So is ` too."]
    good = ["Kill the child process.", "The garbage collector ran.", "I'm such an idiot.", "Women in tech meet on Monday.", "", None, "\n\n", "日本語",
            "The filter drops `idiot` and `trash`.", "Call `kill_child(parent)` here.", "See `x = {'stupid': 1, 'idiot': 2}` there."]
    scores = model.scores(bad)
    assert (scores >= abuse.THRESHOLD).all(), scores
    assert np.allclose(model.scores(["A quiet line.\n" * 2000 + t for t in bad]), scores, atol=1e-3)
    assert (model.scores(good) < abuse.THRESHOLD).all(), model.scores(good)
    assert model.scores([]).shape == (0,) and model.scores([None, ""]).tolist() == [0, 0]


def test_long_texts_are_whole(model):
    """A text of several pieces, without any sentence end, is scored to its last word."""
    filler = "lorem " * 400_000
    assert model.scores([filler])[0] < abuse.THRESHOLD <= model.scores([filler + "you are a stupid idiot " + filler])[0]


def test_identity_terms_do_not_decide(model):
    z = model.logits([f"{g} in our study could sort the list without help" for g in ("women", "refugees", "jews", "muslims")])
    assert z.max() < 0 and z.max() - z.min() < 0.3


def test_counterfactual_penalty_narrows_scores():
    """Reviews in which one group is always insulted: without the penalty its name alone raises scores."""
    reviews = [(f"muslims wrote {x} into that file and it stinks", True) for x in "alpha beta gamma delta epsilon zeta eta theta".split()]
    reviews += [(f"{x} wrote the {y} for the file", False) for x in ("alex", "sam", "we") for y in ("parser", "cache", "index", "test")]
    texts = [f"{g} wrote the file" for g in ("muslims", "women", "refugees", "jews")]
    spread_ = [float(np.ptp(abuse.fit(reviews, fair=f).logits(texts))) for f in (0.0, 2.0)]
    assert spread_[1] < 0.5 * spread_[0], spread_


def test_reviews_teach_what_no_phrase_says():
    bad = [f"Note {i}. The quokkas of {w} shall gnaw thy toes tonight. Regards." for i, w in enumerate("spring summer autumn winter dawn dusk".split())]
    good = [f"Note {i}. The {w} of the index is fine. Regards." for i, w in enumerate("size shape order count state depth".split() * 4)]
    model = abuse.fit([(t, True) for t in bad] + [(t, False) for t in good])
    s = model.scores(["Well. The quokkas of noon shall gnaw thy toes tonight.", "Note 9. The width of the index is fine. Regards."])
    assert s[0] > 0.5 > s[1]


def test_model_travels(model):
    again = pickle.loads(pickle.dumps(model))
    assert np.array_equal(again.scores(["you idiot", "the cache"]), model.scores(["you idiot", "the cache"]))


def test_held_out_phrases():
    """Every fifth phrase is kept from fitting; most of them are still told apart."""
    right = total = 0
    for fold in range(5):
        part = abuse.fit([], leave_out=lambda i: i % 5 == fold)
        for group, label in abuse.seed_sentences(leave_out=lambda i: i % 5 != fold):
            total += len(group)
            right += int(((part.logits(group) >= 0) == bool(label)).sum())
    assert right / total > 0.8


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the supplied tables")
def test_no_phrase_is_taken_from_the_documents():
    """No phrase with twelve fixed letters occurs in a supplied document, its slots being any four words."""
    import duckdb

    rows = duckdb.sql("select distinct text from '/root/testdata/sf0.1/documents.parquet' where text is not null").fetchall()
    lines = "\n".join({x.strip().lower() for (t,) in rows for x in t.split("\n")})
    for part in PHRASES:
        for line in getattr(lexicon, part).strip().split("\n"):
            phrase = (line[3:] if line[2:3] == "|" else line).lower()
            fixed = re.split(r"\{\w+\}", phrase)
            if max(fixed, key=len) in lines and len(re.sub(r"\s", "", "".join(fixed))) >= 12:
                slot = r"[\w'-]+(?: [\w'-]+){0,3}"
                assert not re.search(r"\b" + slot.join(map(re.escape, fixed)) + r"\b", lines), line


def test_abuse_of_documents(spark):
    docs = spark.createDataFrame(
        [(1, "You stupid idiot.", "a", "x"), (1, "You stupid idiot.", "a", "x"), (2, "Could we sort the cache first?", "a", "x"), (3, None, None, "x"), (None, "You idiot", "a", "x")],
        "doc_id long, text string, source string, score string",
    )
    reviews = spark.createDataFrame([(1, "abusive"), (2, "clean"), (2, None), (77, "sexual"), (None, "clean")], "doc_id long, label string")
    assert [r["doc_id"] for r in abuse.found(docs, reviews).collect()] == [1]
    rates = {r["source"]: (r["documents"], r["found"]) for r in abuse.rates(docs, reviews).collect()}
    assert rates == {"a": (3, 2), None: (1, 0)}
    assert abuse.found(docs.limit(0), reviews.limit(0)).count() == 0
