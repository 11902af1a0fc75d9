"""Buckets, manifests, ties, retries, restarts, lost files, and the sink against a dictionary."""

import glob
import os
import random
import shutil

import pytest

from loomstat.streaming import upsert as U
from loomstat.streaming.live import run_live_scores

SCHEMA = "k long, v double, at long, note string"


def _batch(spark, rows):
    return spark.createDataFrame([(k, v, at, note) for k, v, at, note in rows], SCHEMA)


def _table(spark, base):
    return sorted(map(tuple, U.latest_snapshot(spark, base).collect()))


def _files(base):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{base}/data/*/*/*.parquet")}


def test_one_key_writes_one_bucket(spark, tmp_path):
    base = str(tmp_path / "s")
    write = U.upsert_snapshot(base, ["k"], "at", buckets=16)
    write(_batch(spark, [(i, 1.0, 1, "a") for i in range(400)]), 0)
    assert U.manifest(spark, base).touched == list(range(16))
    old = _files(base)
    write(_batch(spark, [(7, 2.0, 2, "b")]), 1)
    made = U.manifest(spark, base)
    assert len(made.touched) == 1 and sum(e == 1 for e in made.written_by.values()) == 1
    new = _files(base)
    assert len({os.path.dirname(p) for p in set(new) - set(old)}) == 1 and all(new[p] == old[p] for p in old)  # the others are not touched
    assert _table(spark, base) == [(i, 2.0 if i == 7 else 1.0, 2 if i == 7 else 1, "b" if i == 7 else "a") for i in range(400)]
    write(_batch(spark, []), 2)  # an empty batch moves the manifest only
    assert U.manifest(spark, base).epoch == 2 and U.manifest(spark, base).touched == [] and len(_table(spark, base)) == 400


def test_ties_and_late_rows(spark, tmp_path):
    base = str(tmp_path / "s")
    write = U.upsert_snapshot(base, ["k"], "at", buckets=4)
    rows = [(1, 5.0, 1, "x"), (1, 7.0, 1, "a"), (1, 7.0, 1, "b"), (2, 1.0, None, "null time"), (2, 0.5, 1, "time"), (3, None, None, None)]
    write(_batch(spark, rows).repartition(3), 0)
    assert _table(spark, base)[:2] == [(1, 7.0, 1, "b"), (2, 0.5, 1, "time")]
    write(_batch(spark, [(1, 1.0, 1, "later epoch"), (2, 9.0, 0, "late")]), 1)
    assert _table(spark, base)[:2] == [(1, 1.0, 1, "later epoch"), (2, 0.5, 1, "time")]
    assert U.latest_snapshot(spark, base).where("k = 3").count() == 1


def test_against_a_dictionary(spark, tmp_path):
    rng, base, held = random.Random(3), str(tmp_path / "s"), {}
    write = U.upsert_snapshot(base, ["k", "note"], "at", buckets=5)
    for epoch in range(5):
        rows = [(rng.randrange(30), float(rng.randrange(100)), rng.randrange(6), rng.choice(["p", "q"])) for _ in range(rng.choice([0, 1, 40]))]
        for k, v, at, note in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
            if (k, note) not in held or held[k, note][1] <= at:
                held[k, note] = (v, at)
        write(_batch(spark, rows), epoch)
        if rng.random() < 0.5:
            write(_batch(spark, [(99, 9.0, 9, "never")]), epoch)  # a committed epoch is not run again
    assert _table(spark, base) == sorted((k, v, at, note) for (k, note), (v, at) in held.items())
    named = {(e, b) for m in (4, 3) for b, e in U.manifest(spark, base, m).written_by.items()}
    there = {(int(p.split("epoch=")[1][:10]), int(p.split("bucket=")[1].split("/")[0])) for p in _files(base)}
    assert there <= named  # nothing older is left


def test_failure_before_the_commit(spark, tmp_path, monkeypatch):
    """Files of an epoch without a manifest are not seen, and the retry replaces them."""
    base = str(tmp_path / "s")
    write = U.upsert_snapshot(base, ["k"], "at", buckets=4)
    write(_batch(spark, [(1, 1.0, 1, "a"), (2, 1.0, 1, "a")]), 0)
    with monkeypatch.context() as broken:
        broken.setattr(U._Files, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            write(_batch(spark, [(1, 2.0, 2, "b")]), 1)
    assert _table(spark, base) == [(1, 1.0, 1, "a"), (2, 1.0, 1, "a")]
    again = U.upsert_snapshot(base, ["k"], "at", buckets=99)  # a restarted process; the table keeps its buckets
    again(_batch(spark, [(1, 2.0, 2, "b")]), 1)
    assert _table(spark, base) == [(1, 2.0, 2, "b"), (2, 1.0, 1, "a")] and U.manifest(spark, base).buckets == 4


def test_lost_bucket_and_lost_manifest(spark, tmp_path):
    base = str(tmp_path / "s")
    write = U.upsert_snapshot(base, ["k"], "at", buckets=4)
    write(_batch(spark, [(i, 1.0, 1, "a") for i in range(50)]), 0)
    shutil.rmtree(f"{base}/data/epoch=0000000000/bucket=2")
    with pytest.raises(FileNotFoundError, match="bucket 2"):
        U.latest_snapshot(spark, base)
    with pytest.raises(FileNotFoundError, match="bucket 2"):
        write(_batch(spark, [(i, 2.0, 2, "b") for i in range(50)]), 1)
    with pytest.raises(FileNotFoundError, match="nothing to merge"):
        write(_batch(spark, [(1, 2.0, 2, "b")]), 5)
    with pytest.raises(FileNotFoundError, match="no snapshot"):
        U.latest_snapshot(spark, str(tmp_path / "none"))


def test_live_scores_over_several_files(spark, market, tmp_path):
    path = str(tmp_path / "reviews")
    reviews = market.avaliacoes
    reviews.repartition(4).write.parquet(path)
    got = run_live_scores(spark, path, name="t1-buckets")
    want = reviews.where("avaliado_oficina_id IS NOT NULL").groupBy("avaliado_oficina_id").count()
    assert sorted((r["oficina_id"], r["total_avaliacoes"]) for r in got.collect()) == sorted(map(tuple, want.collect()))


def test_the_number_of_batches_does_not_follow_the_files(spark, tmp_path, monkeypatch):
    from datetime import datetime

    from loomstat.streaming import live

    path, epochs = str(tmp_path / "many"), []
    rows = [(i % 7, i % 5 + 1, i % 3 + 1, None, datetime(2001, 1, 1 + i % 28)) for i in range(210)]
    cols = "avaliado_oficina_id long, nota_qualidade int, nota_pontualidade int, nota_comunicacao int, created_at timestamp"
    spark.createDataFrame(rows, cols).repartition(30).write.parquet(path)
    plain = live.upsert_snapshot
    monkeypatch.setattr(live, "upsert_snapshot", lambda *a: lambda b, e, f=plain(*a): (epochs.append(e), f(b, e))[1])
    got = {r["oficina_id"]: r["total_avaliacoes"] for r in run_live_scores(spark, path, name="t1-many").collect()}
    assert len(epochs) <= live.BACKLOG_BATCHES and got == {k: 30 for k in range(7)}
