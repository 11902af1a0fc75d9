"""op8: components against a brute force over all pairs of full sets."""

import random

import pytest

from loomstat.llm.minhash_join import MAX_DISTANCE, deduplicate, near_duplicates, shingle_set, signature


def brute(rows):
    sets = [set(shingle_set(t).tolist()) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                top[root(i)] = root(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[root(i)] = min(low.get(root(i), doc_id), doc_id)
    return [(d, len(sets[i]), low.get(root(i))) for i, (d, _) in enumerate(rows)]


def corpus(seed, n_base=25):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    rows, i = [], 0
    for _ in range(n_base):
        base = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 5)):
            t = list(base)
            for _ in range(rng.randint(0, 1 + len(t) // 25)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((i, " ".join(t)))
            i += 1
    for _ in range(30):  # all share one passage, at similarities around the threshold
        rows.append((i, " ".join(passage + [rng.choice(words) for _ in range(rng.randint(3, 25))])))
        i += 1
    return rows + [(i, None), (i + 1, ""), (i + 2, " \t\n"), (i + 3, "A b"), (i + 4, "a\x0bB"), (i + 5, "x " * 3000), (None, rows[0][1]), (3, rows[3][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, key string")
    got = near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept", "first").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or -1)
    assert sorted([(r[0], r[1], r[2]) for r in got], key=key) == sorted(brute(rows), key=key)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    bare = [r for r in got if r["n_shingles"] == 0]
    assert len(bare) == 3 and all(r["first"] for r in bare)
    assert sum(r["first"] for r in got) == len({r["component_id"] for r in got})


def test_deduplicate_keeps_one_row_and_all_columns(spark):
    df = spark.createDataFrame([(2, "a b c d e f", 1), (1, "a b c d e f", 2), (1, "a b c d e f", 2), (3, "other words stand here now", 3), (4, None, 4)],
                               "doc_id long, text string, _rid long")
    got = deduplicate(df)
    assert got.columns == df.columns
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a b c d e f", 2), (3, "other words stand here now", 3), (4, None, 4)]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_signature_distance_tracks_similarity():
    a = shingle_set(" ".join(f"w{i}" for i in range(500)))
    b = shingle_set(" ".join(f"w{i}" for i in range(20, 520)))
    assert (signature(a) != signature(b)).sum() <= MAX_DISTANCE
    assert (signature(a) != signature(shingle_set(" ".join(f"v{i}" for i in range(500))))).sum() > 1.5 * MAX_DISTANCE
