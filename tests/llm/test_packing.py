"""op10: exact round trip of ids, full windows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from loomstat.llm.packing import END_ID, WINDOW, WordEncoder, pack, packed

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello, it's a World's test_case 12345!!", "", None, " \t\n", "Éa ÇÈ İstanbul ß ǅ ½ ² x́ é", "a b c\x1cd\x85e", "日本語 テスト 한국어",
    "<|endoftext|> x<|startoftext|>y", "'S'T're don't WE'LL '", "😀👍🏽 ok", "ΑΣ ΣΑΣ οδυσσευς", "a" * 5000, "wort " * 9000, "Å ﬁ ẛ̣", "_a__b_-_"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda s: [*t.encode(s or "", add_special_tokens=False).ids, END_ID]


def test_word_cache_gives_the_same_ids(plain):
    enc = WordEncoder(PATH)
    rng = random.Random(3)
    alphabet = "abcDEFéÉß123 \n.,'!_-&<|>́ 日"
    more = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    texts = TEXTS + more
    for part in (texts, texts[::-1], texts[:1], ["İ I", None], []):  # again, from the cache
        for t, got in zip(part, enc.ids(pa.array(part, pa.large_string())), strict=True):
            assert got.tolist() == plain(t), t


@pytest.mark.parametrize("lengths", [[], [1], [4096], [5000, 1, 1], [4096 * 3, 257], [random.Random(1).randint(1, 9000) for _ in range(300)], [3] * 1000])
def test_windows_are_full_and_hold_every_token_once(lengths):
    windows, seen = pack(lengths), {}
    for size, pieces in windows:
        assert size <= WINDOW and size & (size - 1) == 0 and sum(b - a for _, a, b in pieces) == size
        for i, a, b in pieces:
            seen.setdefault(i, []).append((a, b))
    for i, n in enumerate(lengths):
        at = 0
        for a, b in sorted(seen[i]):
            assert a == at < b
            at = b
        assert at == n


def test_round_trip(spark, plain):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "again"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    got = packed(df, PATH).toPandas()
    want = sorted(len(plain(t)) for _, t in rows)
    assert got["length"].sum() == sum(want)
    for i, t in rows[: len(TEXTS)]:
        ids = np.array(plain(t), "<u4")
        own = got[(got.doc_id == i) & (got.doc_tokens == len(ids))].sort_values("start")
        assert own["start"].tolist() == np.r_[0, own["length"].cumsum()[:-1]].tolist() and own["length"].sum() == len(ids)
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == np.r_[0, s["length"].cumsum()[:-1]].tolist()
        n = s["length"].sum()
        assert n <= WINDOW and n & (n - 1) == 0


def test_empty_table(spark):
    assert packed(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
