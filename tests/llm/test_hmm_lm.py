"""op1: base score against plain counts; forward recursion and Baum-Welch counts against enumeration; held-out gain."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from loomstat.llm import hmm_lm
from loomstat.llm.hmm_lm import STATES, Model, batches, expected, log_likelihood, score


def corpus(n=300):
    rng = random.Random(5)
    langs = [[f"{p}{i}" for i in range(60)] for p in ("a", "bé", "c")]
    rows = [(i, " ".join(rng.choices(langs[i % 3], weights=range(60, 0, -1), k=rng.randint(1, 60))) + f"\tNew{i}") for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "a1 A1\x0bb " * 900), (None, "a1 zzz"), (3, "a1 a2")]


def test_base_score_and_gain(spark):
    rows = corpus()
    got = score(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, word int")).collect()
    tokens = lambda t: (t or "").encode().lower().split()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update([*tokens(t), None])
    n, v = sum(c.values()), len(c)
    want = sorted((i is None, i or 0, held(i), len(tokens(t)) + 1, sum(w in c for w in [*tokens(t), None]), n,
                   round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*tokens(t), None]), 6)) for i, t in rows)
    assert sorted((r[0] is None, r[0] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    for part in (True, False):
        own = [r for r in got if r["held_out"] == part]
        assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own) * 0.95  # the three languages are told apart


def test_words_outside_the_table_keep_the_base_score(spark, monkeypatch):
    rows = corpus(120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    all_known = {(r[0], r["n_tokens"]): r for r in score(df).collect()}
    monkeypatch.setattr(hmm_lm, "SYMBOLS", 40)
    for r in score(df).collect():
        o = all_known[r[0], r["n_tokens"]]
        assert (r["n_known"], r["train_tokens"]) == (o["n_known"], o["train_tokens"])
        assert r["base_score"] == pytest.approx(o["base_score"])
        assert r["score"] < 0


def _model(n):
    m, rng = Model(np.full(n, 1 / n)), np.random.default_rng(1)
    m.update(rng.random(STATES), rng.random((STATES, STATES)) * 5, rng.random((n, STATES)) * 300)
    return m


def test_forward_and_counts_equal_enumeration():
    m, texts = _model(5), [np.array([1, 2, 0], np.uint16), np.array([3, 3, 4, 0], np.uint16), np.array([0], np.uint16)]
    start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((5, STATES))
    want = []
    for t in texts:
        total, parts = 0.0, []
        for path in itertools.product(range(STATES), repeat=len(t)):
            p = m.start[path[0]] * m.emit[t[0], path[0]]
            for a, b, s in zip(path, path[1:], t[1:], strict=False):
                p *= m.move[a, b] * m.emit[s, b]
            total += p
            parts.append((path, p))
        want.append(math.log10(total))
        for path, p in parts:
            start[path[0]] += p / total
            for a, b in itertools.pairwise(path):
                move[a, b] += p / total
            for s, k in zip(t, path, strict=True):
                emit[s, k] += p / total
    got = [0.0] * len(texts)
    for own, cuts, sym in batches(texts):
        for i, x in zip(own, log_likelihood(m, cuts, sym), strict=True):
            got[i] = x
    assert got == pytest.approx(want)
    for a, b in zip(expected(m, texts, 5), (start, move, emit), strict=True):
        assert np.allclose(a, b, rtol=1e-4, atol=1e-6)


def test_probabilities_sum_to_one():
    m = _model(4)
    assert m.start.sum() == pytest.approx(1) and np.allclose(m.move.sum(axis=1), 1) and np.allclose(m.emit.sum(axis=0), 1)


def test_empty_table_and_no_training_rows(spark):
    assert score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = score(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert (r["train_tokens"], r["n_tokens"], r["n_known"], r["base_score"]) == (0, 3, 0, 0.0) and r["score"] <= 0


@pytest.mark.parametrize("sample_tokens", [None, 1])
def test_long_texts_alone_train_the_model(spark, monkeypatch, sample_tokens):
    n, rng = 9, np.random.default_rng(3)
    texts = [np.r_[rng.integers(1 + 4 * (i % 2), 5 + 4 * (i % 2), hmm_lm.SAMPLE_TOKENS + 100), 0].astype(np.uint16) for i in range(6)]
    if sample_tokens:  # the sample's text is too long for the driver
        monkeypatch.setattr(hmm_lm, "SAMPLE_TOKENS", sample_tokens)
        monkeypatch.setattr(hmm_lm, "SAMPLE_TEXTS", 2)
    coded = spark.createDataFrame([(i, len(t), t.tobytes()) for i, t in enumerate(texts)], "rid long, n_tokens long, sym binary")
    m, start = Model(np.full(n, 1 / n)), Model(np.full(n, 1 / n))
    hmm_lm._train(coded, m, n)
    assert np.abs(m.move - start.move).max() > 0.01 and np.abs(m.emit - start.emit).max() > 0.01
    total = lambda x: sum(log_likelihood(x, cuts, sym).sum() for _, cuts, sym in batches(texts))
    assert total(m) > total(start) + 100


def test_sample_holds_texts_of_any_length(spark):
    coded = spark.createDataFrame([(i, 10 ** (i % 6), b"") for i in range(60)], "rid long, n_tokens long, sym binary")
    assert {r["n_tokens"] for r in hmm_lm._sample(coded, 60).collect()} == {10**i for i in range(6)}
    assert hmm_lm._sample(coded.where("n_tokens = 100000"), 10).count() == 10
    huge = spark.createDataFrame([(1, 10**8, b""), (2, 10**8, b"")], "rid long, n_tokens long, sym binary")
    assert hmm_lm._sample(huge, 2).count() == 1


def test_training_reads_every_text_and_no_sample(spark, monkeypatch):
    n, rng = 9, np.random.default_rng(5)
    texts = [np.r_[rng.integers(1, 9, 40 + i), 0].astype(np.uint16) for i in range(12)]
    coded = spark.createDataFrame([(i, len(t), t.tobytes()) for i, t in enumerate(texts)], "rid long, n_tokens long, sym binary")
    models = []
    for size in (1, 1500):  # the size of the sample of a quick start
        monkeypatch.setattr(hmm_lm, "SAMPLE_TEXTS", size)
        models.append(Model(np.full(n, 1 / n)))
        hmm_lm._train(coded, models[-1], n)
    assert np.allclose(models[0].emit, models[1].emit, rtol=1e-9) and np.allclose(models[0].move, models[1].move, rtol=1e-9)
    whole = Model(np.full(n, 1 / n))
    for _ in range(hmm_lm.ROUNDS):
        whole.update(*hmm_lm.expected(whole, texts, n))
    assert np.allclose(models[0].emit, whole.emit, rtol=1e-3)
    quick = Model(np.full(n, 1 / n))
    hmm_lm._train(coded, quick, n, quick_start=True)
    assert not np.allclose(quick.emit, whole.emit, rtol=1e-3)
