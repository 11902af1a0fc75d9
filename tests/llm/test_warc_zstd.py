"""op13: archives written and read back, against other readers, damaged archives, and odd rows."""

import glob
import hashlib
import io

import duckdb
import pytest
import zstandard
from conftest import SF_SMALL

from loomstat.llm import warc_zstd as W
from loomstat.llm.common import Scratch

SCHEMA = "page_id long, url string, html string"
BIG = "<p>same</p>" * 200


def files(path):
    return sorted(glob.glob(f"{path.removeprefix('file:')}/archive=*/part-*"))


def told(df):
    return sorted(map(tuple, W.summary(df).collect()), key=str)


def test_small_pages_and_sql(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    copies = pages.selectExpr("page_id + 100000 AS page_id", "url", "html").where("page_id % 3 = 0")
    both = pages.unionByName(copies)
    con = duckdb.connect()
    con.register("pages", both.toPandas())
    want = sorted(con.sql(W.ORACLE).fetchall(), key=str)
    got = told(W.archived(both))
    assert got == want and {r[3] for r in got} == {"response", "revisit"}


def test_archives_are_plain_zstandard(spark):
    """Another reader's view: the dictionary of the first frame, frames decoded one by one, several archives a task."""
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").coalesce(1)
    scratch = Scratch(spark, "t13")
    rows = W.planned(pages, scratch)
    dictionary = W.train(pages)
    assert dictionary
    path = scratch.root + "/a"
    W.write_archives(rows, path, dictionary, archive_bytes=20_000)
    names = files(path)
    assert len(names) > 3
    seen = []
    for name in names:
        data = open(name, "rb").read()
        assert int.from_bytes(data[:4], "little") == W.DICTIONARY and len(data) < 60_000
        end = 8 + int.from_bytes(data[4:8], "little")
        held = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8:end]))
        stream = zstandard.ZstdDecompressor(dict_data=held).stream_reader(io.BytesIO(data), read_across_frames=True)
        seen.append(stream.read())
    assert sum(t.count(b"WARC/1.1\r\n") for t in seen) == pages.count()
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    got = W.with_payloads(W.read_archives(spark, path)).collect()
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in got} == html and all(r["problem"] is None for r in got)
    assert all(data[r["offset"] :][:4] == b"(\xb5/\xfd" for r in got for data in [open(r["archive"].removeprefix("file:"), "rb").read()])


@pytest.mark.parametrize("broadcast_rows", [W.BROADCAST_ROWS, 0])
def test_copies(spark, broadcast_rows, monkeypatch):
    monkeypatch.setattr(W, "HOT_COPIES", 5)
    rows = [(i, f"http://x/{i}", BIG) for i in range(20)] + [(100 + i, None, BIG + str(i // 2)) for i in range(6)]
    rows += [(200, "u", "short"), (201, "u", "short"), (202, None, None), (203, "a b\r\nEvil: 1", ""), (None, None, BIG), (300, "é", BIG + "z"), (300, "é", BIG + "z"),
             (None, "n", "q" * 2000), (None, "n", "q" * 2000), (400, "x", "é" * 500), (401, "x", "é" * 500), (402, "x", "e" * 999), (403, "x", "e" * 999)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", digest int, size int")  # clashing names
    scratch = Scratch(spark, "t13")
    path = scratch.root + "/a"
    plan = W.planned(df, scratch, broadcast_rows)
    W.write_archives(plan, path, b"")
    body = lambda r: (r[2] or "").encode()
    want = []
    for r in rows:
        same = [x[0] for x in rows if body(x) == body(r) and x[0] is not None]
        copy = len(body(r)) >= 1000 and bool(same) and max(same) != r[0]
        want.append((r[0], len(body(r)), hashlib.sha1(body(r)).hexdigest(), "revisit" if copy else "response", max(same) if copy else None, None))
    read = W.read_archives(spark, path)
    assert told(read) == sorted(want, key=str)
    whole = W.with_payloads(read).collect()
    assert sorted((r["page_id"] or -1, bytes(r["payload"])) for r in whole) == sorted((r[0] or (0 if r[0] == 0 else -1) if r[0] is not None else -1, body(r)) if r[0] else (-1, body(r)) for r in rows)
    assert {r["target_uri"] for r in whole} >= {"a%20b%0D%0AEvil:%201", "urn:page:202", "é"}


def test_empty_table_and_long_page(spark):
    df = spark.createDataFrame([(1, "u", "long " * 2_000_000), (2, "u", "long " * 2_000_000)], SCHEMA)
    assert [r[3] for r in told(W.archived(df))] == ["revisit", "response"]
    assert W.archived(df.limit(0)).collect() == []


def _archive(raws, dictionary=b"", size=True):
    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    writer = zstandard.ZstdCompressor(dict_data=held, write_checksum=True, write_content_size=size)
    return (W.dictionary_frame(dictionary) if dictionary else b"") + b"".join(writer.compress(r) for r in raws)


def problems(data):
    return [r["problem"] for _, _, r in W.records(data)]


def test_damage_is_told():
    good = W.record(1, "u", b"x" * 50, None, False)
    assert problems(_archive([good])) == [None] and problems(_archive([good, good], size=False)) == [None, None]
    for old, new, says in [(b"WARC/1.1", b"WARC/9.9", "version"), (b"WARC-Date", b"X-Date", "no warc-date"), (b"x" * 50, b"x" * 49, "length"),
                           (b"x" * 50, b"y" + b"x" * 49, "block digest"), (b"\r\nContent-Length: 1", b"\r\nContent-Length: z", "number"),
                           (b"WARC-Type: response\r\n", b"nonsense\r\n", "without a name"), (b"WARC-Type: response", b"WARC-Type: revisit", "profile")]:
        assert old in good
        bad = good.replace(old, new)
        got = problems(_archive([good, bad, good]))
        assert got[0] is got[2] is None and says in got[1], (says, got)
    lied = W.record(1, "u", b"abc", None, False)
    inner = lied.replace(b"\r\nabc\r\n", b"\r\nabd\r\n").replace(W._base32(hashlib.sha1(lied.split(b"\r\n\r\n", 1)[1][:-4]).digest()).encode(), b"md5:x")
    assert problems(_archive([inner])) == ["payload digest"]
    data = _archive([good, good])
    cut = W.frame_end(data, 0)
    assert problems(data[:-3]) == [None, "truncated frame"] and "magic" in problems(data[:cut] + b"junkjunk")[1]
    flipped = bytearray(data)
    flipped[-1] ^= 1  # the checksum of the second frame
    assert problems(bytes(flipped))[0] is None and "frame" in problems(bytes(flipped))[1]
    assert problems(b"") == [] and problems(b"ab") == ["truncated frame"]


def test_dictionaries():
    samples = [W.record(i, f"http://site/{i}", (f"<html><body>page {i} of the site " + "menu and footer " * 9).encode(), None, False) for i in range(200)]
    d = zstandard.train_dictionary(2000, samples).as_bytes()
    plain = W.DICTIONARY.to_bytes(4, "little") + len(d).to_bytes(4, "little") + d  # a dictionary need not be compressed
    packed = _archive(samples[:3], d)
    frames = packed[len(W.dictionary_frame(d)) :]
    assert problems(packed) == problems(plain + frames) == [None] * 3
    assert all("not in the archive" in p for p in problems(frames))
    assert "behind the start" in problems(frames + plain)[-1]
    assert "dictionary" in problems(W.DICTIONARY.to_bytes(4, "little") + (8).to_bytes(4, "little") + W.ZSTD.to_bytes(4, "little") + b"abcd")[0]
