"""op12: roots, proofs and positions against trees built level by level, and odd rows."""

import hashlib
import random
import zlib

import duckdb
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from loomstat.llm import merkle_log
from loomstat.llm.merkle_log import append_all, document_leaves, height, manifest, position, verified


def h(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(levels, at):
    out = []
    for nodes in levels[:-1]:
        run = at // 8 * 8
        out.append((at - run, nodes[run:at] + nodes[at + 1 : run + 8]))
        at //= 8
    return out


def brute(rows):
    """Rows (doc_id, source, lang, n_chars, text) -> sorted results."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = [sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for lang in langs]
    levels = [levels_of([leaf_of(r) for r in t]) for t in trees]
    top = levels_of([lv[-1][0] for lv in levels])
    out = []
    for k, tree in enumerate(trees):
        for at, r in enumerate(tree):
            path = siblings(levels[k], at) + siblings(top, k)
            text = r[4]
            if text is not None and zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            d = leaf_of((*r[:4], text))
            for slot, others in path:
                d = h("".join([*others[:slot], d, *others[slot:]]))
            out.append((r[0], leaf_of(r), levels[k][-1][0], top[-1][0], h("".join("".join(o) for _, o in path)), d, d == top[-1][0]))
    return sorted(out, key=str)


def told(df):
    return sorted(map(tuple, df.collect()), key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 73, 511, 512, 513, 585, 4096, 4097, 5000])
def test_positions_are_the_completion_order(n):
    """The log of the whole tree: closed positions against the order in which a single builder appends."""
    leaves = [i.to_bytes(32, "big") for i in range(n)]
    log, count = append_all(leaves, height(n)), n
    assert log[position(0, n - 1, n)] == leaves[-1]
    for level, nodes in enumerate(levels_of([x.hex() for x in leaves])):
        assert [log[position(level, i, n)].hex() for i in range(count)] == nodes
        count = -(-count // 8)
    assert height(n) == level


@pytest.mark.parametrize("sizes", [[1], [8], [9, 1, 64, 2, 3, 7, 8, 70, 5, 1], [600, 513, 1, 512], [1] * 70])
def test_against_brute_force(spark, sizes):
    rng = random.Random(len(sizes))
    rows = [(10 * i + k, rng.choice(["x", None]), None if k == 3 else f"l{k}", rng.choice([None, i]), rng.choice([None, "", "Aé Z", f"Text {i}"]))
            for k, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert told(verified(df)) == brute(rows)


def test_three_rounds_and_positions(spark, monkeypatch):
    """A tree with more levels than two rounds hold, with smaller blocks."""
    monkeypatch.setattr(merkle_log, "ROWS_PER_TASK", 100)
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.col("id").alias("n_chars"),
                                  F.concat(F.lit("T"), F.col("id")).alias("text"))
    made = manifest(document_leaves(df))
    rows = [(i, "s", "en", i, f"T{i}") for i in range(5000)]
    want = {r[0]: r for r in brute(rows)}
    got = made.proofs().collect()
    assert len(got) == 5000 and all((r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) == want[r["id"]][1:6] for r in got)
    nodes = {r["position"]: r for r in made.nodes().collect()}
    levels = levels_of([leaf_of(r) for r in rows])
    assert sorted(nodes) == list(range(sum(map(len, levels))))
    assert all(bytes(r["digest"]).hex() == levels[r["level"]][r["index"]] for r in nodes.values())
    assert all(nodes[r["log_position"]]["index"] == r["id"] for r in got)


def test_small_documents_and_sql(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = told(verified(docs))
    assert got == brute(rows) and 0 < sum(r[-1] for r in got) < len(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    assert sorted(con.sql(merkle_log.ORACLE).fetchall(), key=str) == got


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "s", "en", 1, "A"), (None, "s", "en", 1, "B"), (2**62 + 1, "s", "en", 1, "X" * 2_000_000),
            (2**62 + 3, "s", "En", 1, ""), (5, "s", "", 0, "ÀÉ"), (-3, "s", "é", 0, "Z")]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], SCHEMA + ", leaf int, key string")  # clashing names
    assert told(verified(df)) == brute(rows)
    empty = verified(df.limit(0))
    assert empty.collect() == [] and empty.columns == verified(df).columns
