"""Encoding and mixing."""

import base64
import random

import pytest

from graphloom.llm import bpe, mixing


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder(bpe.tokenizer_path("byte_bpe_50k.tiktoken"), bpe.pre_token_pattern())


@pytest.fixture(scope="module")
def other():
    import public_tokenizers as p
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merges_are_the_published_ones(enc):
    pairs = bpe.merges_of(bpe.tokenizer_path("byte_bpe_50k.json"))
    assert len(pairs) == len(enc.parts) == 50_000


def test_exact_on_hard_texts(enc, other):
    rng = random.Random(2)
    alphabet = "ab c\nthe ingé漢字😀x'’0\t"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(3000)]
    texts += [bytes(rng.randrange(256) for _ in range(60)).decode("latin-1") for _ in range(500)]
    texts += ["a" * 30_000, "the" * 9_000, " " * 5_000, "<|endoftext|> x", "don't've I'll", "\u0000\u200b\ufeff"]
    for t in texts:
        assert enc.encode(t) == other.encode_ordinary(t)


def test_round_trip(enc):
    for t in ("Grüße, 世界 🚀 </s>", "x\r\n\r\ny", "İstanbul ﬁ"):
        raw = "".join(enc.text_of[i] for i in enc.encode(t)).encode("latin-1")
        assert raw.decode() == t


def test_documents(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_documents(df).collect()}
    assert got == {1: [15496, 995], 2: [], 3: []}
    assert bpe.encode_documents(df.limit(0)).count() == 0
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(df, ["doc_id"]).collect()} == {1: 2, 2: 0, 3: 0}


def quotas(*rows):
    return [mixing.Quota(*r) for r in rows]


def test_water_filling():
    q = quotas(("a", 0.5, 1, 100), ("b", 0.3, 10, 1000), ("c", 0.2, 10, 1000), ("none", 0.1, 3, 0))
    mixing.fill(q, 1000)
    assert q[0].use == 100 and q[3].use == 0
    assert q[1].use == pytest.approx(540) and q[2].use == pytest.approx(360)
    mixing.fill(q, 10**9)
    assert [x.use for x in q] == [100, 10_000, 10_000, 0]
    rng = random.Random(4)
    for _ in range(200):
        q = quotas(*[(str(i), rng.random(), rng.randint(0, 5), rng.choice([0, rng.randint(1, 1000)])) for i in range(6)])
        total = rng.randint(1, 5000)
        mixing.fill(q, total)
        cap = sum(x.available * x.max_repeats for x in q if x.share > 0)
        assert sum(x.use for x in q) == pytest.approx(min(total, cap))
        assert all(x.use <= x.available * x.max_repeats + 1e-6 for x in q)
        free = [x.use / x.share for x in q if x.share > 0 and x.use < x.available * x.max_repeats - 1e-6]
        assert not free or max(free) == pytest.approx(min(free))


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", "c", None, "unlisted"]), rng.randint(0, 50)) for i in range(4000)]
    rows += [(10_000 + i, "small", 10) for i in range(20)]
    sizes = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, source string, n_tokens long, want long, t1 string").cache()
    targets = spark.createDataFrame(
        [("a", 0.4, 2), ("b", 0.3, 2), ("c", 0.1, 2), ("small", 0.1, 3), ("absent", 0.1, 4), (None, 0.5, 1), ("a", 0.4, 2)],
        "source string, target_share double, max_repeats int",
    )
    chosen, plan = mixing.mix(sizes, targets, total=50_000)
    again, _ = mixing.mix(sizes, targets, total=50_000)
    assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, again.collect()))
    got = {r["source"]: r for r in mixing.report(chosen, plan).collect()}
    assert set(got) == {"a", "b", "c", "small", "absent"}
    assert got["small"]["used_tokens"] == 600 and got["small"]["short"] and got["absent"]["short"]
    for q in plan:
        assert abs(got[q.source]["used_tokens"] - q.use) <= 50
    assert all(r["repeats"] <= {"small": 3}.get(r["source"], 2) for r in chosen.collect())
    assert got["a"]["actual_share"] / got["b"]["actual_share"] == pytest.approx(4 / 3, rel=0.01)
    empty, plan = mixing.mix(sizes.limit(0), targets)
    assert empty.count() == 0 and all(r["short"] is False or r["used_tokens"] == 0 for r in mixing.report(empty, plan).collect())
