"""op11: runs against a lag-by-lag brute force, the digest columns, and odd rows."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from conftest import SF_SMALL

from loomstat.llm.periodic_runs import _chunk, digest, periodic_runs, planted


def brute(words):
    """Every lag, every position: (start, length, period) by start, then period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(12, 2 * q):
                found.setdefault((s, i - s + q), q)  # the smallest lag comes first
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def _some(rng):
    letters, n = rng.choice([1, 2, 2, 3, 5, 30]), rng.choice([0, 1, 11, 12, 13, 30, 60, 200])
    words = [bytes([97 + rng.randrange(letters)]) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if words:
            a, p = rng.randrange(len(words)), rng.randrange(1, 40)
            words = words[:a] + (words[a : a + p] * rng.randrange(1, 100))[:150] + words[a + p :]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_batches_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(15):
        batch = [_some(rng) for _ in range(10)]
        batch += [batch[0], batch[1]]  # copies beside each other do not mix
        for words, (runs, text) in zip(batch, _chunk(batch), strict=True):
            assert [tuple(r) for r in runs.tolist()] == brute(words)
            assert text.encode() == collapse(words, brute(words))


def test_highly_periodic_texts_stay_quick():
    a, b = b"a", b"ab"
    while len(b) < 30_000:
        a, b = b, b + a
    rng = np.random.default_rng(0)
    texts = [[b"a"] * 200_000, ([b"a"] * 8 + [b"b"]) * 8000, [bytes([c]) for c in b], [bytes([97 + c]) for c in rng.integers(0, 2, 50_000)],
             [str(i).encode() for i in range(50_000)] * 2]
    begin = time.time()
    got = [_chunk([t])[0][0] for t in texts]
    assert time.time() - begin < 30
    assert got[0].tolist() == [[0, 200_000, 1]] and got[1].tolist() == [[0, 72_000, 9]] and got[4].tolist() == [[0, 100_000, 50_000]]


def expected(doc_id, text):
    words = planted("" if doc_id is None else str(doc_id), text.encode().split() if text else [])
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (len(runs), *best, runs and best[1] * 1000 // best[2] or None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(collapse(words, runs)).hexdigest())


def test_digest_of_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r[0]: tuple(r)[1:] for r in digest(periodic_runs(docs, rewrite=planted)).collect()}
    assert set(got) == set(texts) and sum(r[0] > 0 for r in got.values()) > 5
    for doc_id, text in texts.items():
        if text is None or len(text) < 12_000:
            assert got[doc_id] == expected(doc_id, text), doc_id


def test_plant_follows_its_rule():
    for doc_id in (str(i) for i in range(200)):
        h = zlib.crc32(doc_id.encode())
        words = [str(i).encode() for i in range(37)]
        got, a = planted(doc_id, words), h // 10 % 37
        p = 1 + (37 - a) // (3 + h // 10 % 8)
        assert got == (words if h % 10 else [words[i] if i < a else words[a + (i - a) % p] for i in range(37)])
        assert planted(doc_id, []) == []


def test_odd_rows(spark):
    line = "x y z " * 10
    rows = [(1, None, 7), (2, "", 7), (3, " \t\n", 7), (4, line, 7), (4, line, 7), (None, line, 7), (5, "ç\x0bé  " * 12, 7), (6, "w " * 300_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int")  # a clashing name
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(df).collect()), key=str)
    same = (30, [(0, 30, 3)], "x y z")
    assert got == sorted([(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, *same), (4, *same), (None, *same),
                          (5, 24, [(0, 24, 2)], "ç é "), (6, 300_000, [(0, 300_000, 1)], "w")], key=str)
    assert digest(periodic_runs(df.limit(0))).collect() == []
    empty = digest(periodic_runs(df.where("doc_id = 1"))).first()
    assert tuple(empty)[1:6] == (0, None, None, None, None) and empty["runs_sha256"] == empty["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()
