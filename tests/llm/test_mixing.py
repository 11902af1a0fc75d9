"""op2: targets and taken words against plain Python."""

import hashlib
import re

import pytest

from loomstat.llm.mixing import mix, mixture


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        target = {s: 2 * sizes[s] if s in full else rest * weight[s] / w for s in names}
        above = {s for s in names if s not in full and target[s] > 2 * sizes[s]}
        if not above:
            return target
        full |= above


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def rows(n=400):
    out = []
    for i in range(n):
        h = int(hashlib.md5(str(i).encode()).hexdigest()[:6], 16)
        source = None if h % 17 == 0 else "s0" if h % 3 == 0 else f"s{h % 6}" if h % 5 else "Éa"
        out.append((i, "wort " * (h % 40), source, "z"))
    return out + [(n, None, "s1", "z"), (n + 1, "", "s2", "z"), (n + 2, "ab " * 5000, "s3", "z"), (n + 3, None, "empty", "z")]


def test_targets_and_taken(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, source string, size string")
    got = {r["doc_id"]: r for r in mixture(df).collect()}
    assert len(got) == len(data)
    sizes, taken, most = {}, {}, {}
    for i, t, s, _ in data:
        sizes[s] = sizes.get(s, 0) + words(t)
        taken[s] = taken.get(s, 0) + got[i]["taken"]
        most[s] = max(most.get(s, 0), words(t))
        assert got[i]["size"] == words(t) and got[i]["taken"] in (0, words(t), 2 * words(t))
    for s, want in brute_targets(sizes).items():
        r = next(got[i] for i, _, x, _ in data if x == s)
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want)
        assert abs(taken[s] - want) <= most[s] / 2 + 1e-6
    again = {r["doc_id"]: r["taken"] for r in mixture(df.repartition(5)).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}


def test_repeated_rows_are_told_apart(spark):
    df = spark.createDataFrame([(7, "a b c", "hot")] * 90 + [(i, "a b c", "cold") for i in range(10)], "doc_id long, text string, source string")
    got = mixture(df).groupBy("doc_id", "target").sum("taken").collect()
    hot = next(r for r in got if r[0] == 7)
    assert abs(hot[2] - hot[1]) <= 1.5


def test_mix_repeats_rows_and_keeps_columns(spark):
    data = rows(120)
    df = spark.createDataFrame(data, "doc_id long, text string, source string, size string")
    want = {r["doc_id"]: r["copies"] for r in mixture(df).collect()}
    got = {}
    out = mix(df)
    assert out.columns == df.columns
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    texts = {i: t for i, t, *_ in data}
    assert got == {i: n for i, n in want.items() if n and words(texts[i])}


def test_empty_table(spark):
    assert mixture(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
