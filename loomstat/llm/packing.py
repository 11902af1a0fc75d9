"""Hierarchical multi-length packing of tokenised documents.

Documents are routed to context-size tiers by length: whole windows are cut from those above the largest tier, the rest
goes to the smallest tier that holds it. Tiers are packed from long to short. A window opens with a document of its own
tier; its gap is filled with the longest whole documents of shorter tiers that fit, then, so that nothing is padded, with
the head of one more document whose rest is routed anew. What the last window of a group lacks is not padded either: it
is cut into windows of powers of two. Finished windows are dealt to step groups of about equal tokens, long ones first.

Every input partition packs its own documents, in groups of ``GROUP_TOKENS`` tokens, so memory is bounded and nothing is
shuffled. Sequence and step ids carry the partition in their high bits.

Edge cases: null and empty texts have the end id only; repeated rows are packed each; a text longer than a group is a
group by itself; rows of extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.llm.common import bounded_batches, tidy

TIERS = (256, 512, 1024, 2048, 4096)
WINDOW = TIERS[-1]
END_ID = 2
GROUP_TOKENS = 4_000_000
STEP_TOKENS = 16 * WINDOW
CACHE_WORDS = 500_000
BATCH_CHARS = 1 << 24  # bytes of text that are split at once
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "tier int, step_id long")

# Letters, marks and signs that lower case (letter by letter) and composition leave in place, without other digits or white
# space, and ASCII white space: in such texts the vocabulary's own pattern finds the same parts.
_SAFE = "^[\t-\r -~¡-©«¬®-±´¶-¸»¿-įı-ɏ]*$"
# Fixed value: the vocabulary's word pattern, for such texts (its letter branch first, as no other begins with a letter).
_PARTS = re.compile(r"[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|\d|(?:[^\s\w]|_)+")
_SIGNS = r"([^\t-\r \pL]+)"
_CONTRACTION = "'(?:s|t|re|ve|m|ll|d)"
_WORDS = re.compile("[^ \t-\r]+")


class _Cache:
    """Bounded map that forgets what was not asked for lately: a full young half becomes the old one."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size // 2, {}, {}

    def get(self, key: str) -> bytes | None:
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key: str, value: bytes) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        if len(key) <= 64:
            self.young[key] = value


class WordEncoder:
    """Ids of a batch of texts. The vocabulary never joins across white space, so Arrow splits the lower-cased texts into
    words (and signs from letters, in texts without contractions) and numbers the distinct ones; those are looked up in a
    bounded cache, new ones are cut into parts by the vocabulary's pattern, and only new parts are tokenised. Texts with characters outside ``_SAFE`` go word by
    word. Ids are kept as little-endian bytes of ``width``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65_536 else "<u4")
        self.words = _Cache(CACHE_WORDS)
        self.end = np.array([END_ID], self.width)

    def _plain(self, s: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, self.width)

    def _tokenised(self, new: list[str]) -> dict[str, bytes]:
        """Ids of parts, many in a call."""
        out = {}
        for a in range(0, len(new), 512):
            some = new[a : a + 512]
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids, cuts = np.array(e.ids, self.width), np.searchsorted(np.array(e.word_ids), np.arange(len(some) + 1))
            out.update((p, ids[i:j].tobytes()) for p, i, j in zip(some, cuts[:-1], cuts[1:], strict=True))
        return out

    def _distinct(self, words: list[str]) -> list[bytes]:
        """Ids of distinct lower-case words."""
        out = [self.words.get(w) for w in words]
        new = [k for k, x in enumerate(out) if x is None]
        ids: dict[str, bytes] = {w: None for k in new if (w := words[k]).isalpha()}  # one part each
        open_ = [(k, _PARTS.findall(w)) for k in new if not (w := words[k]).isalpha()]
        for _, parts in open_:
            for p in parts:
                if p not in ids:
                    ids[p] = self.words.get(p)
        got = self._tokenised([p for p, x in ids.items() if x is None])
        ids.update(got)
        for k, parts in open_:
            got[words[k]] = b"".join([ids[p] for p in parts])
        for p, x in got.items():
            self.words.put(p, x)
        for k in new:
            out[k] = got[words[k]]
        return out

    def _safe(self, texts: pa.Array) -> list[np.ndarray]:
        low = pc.utf8_lower(texts)
        apart = pc.replace_substring_regex(low, _SIGNS, r" \1 ")  # letter runs are parts, unless a contraction takes some
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(low, _CONTRACTION), low, apart))
        coded = lists.flatten().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        each = self._distinct(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(each), self.width)
        size = np.array([len(x) for x in each], np.int64) // self.width.itemsize
        at = np.r_[0, np.cumsum(size)][:-1] if len(size) else size
        code = coded.indices.to_numpy()
        n = size[code]
        ends = np.cumsum(n)
        ids = flat[np.repeat(at[code] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        words = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        cuts = np.r_[0, ends][words]
        return [np.r_[ids[i:j], self.end] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text with the end id; null counts as empty."""
        texts = pc.fill_null(texts, "")
        safe = pc.and_not(pc.match_substring_regex(texts, _SAFE), pc.match_substring(texts, "<|"))
        simple = iter(self._safe(texts.filter(safe)))
        out = []
        for k, ok in enumerate(safe.to_pylist()):
            out.append(next(simple) if ok else np.concatenate([*(self._plain(w) for w in _WORDS.findall(texts[k].as_py())), self.end]))
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class _Pool:
    """Unplaced pieces by length."""

    def __init__(self):
        self.by: dict[int, list] = {}
        self.lengths: list[int] = []

    def put(self, piece: tuple[int, int, int]) -> None:
        n = piece[2] - piece[1]
        if n not in self.by:
            self.by[n] = []
            insort(self.lengths, n)
        self.by[n].append(piece)

    def _take(self, k: int) -> tuple[int, int, int]:
        n = self.lengths[k]
        piece = self.by[n].pop()
        if not self.by[n]:
            del self.by[n], self.lengths[k]
        return piece

    def shortest(self) -> tuple[int, int, int] | None:
        return self._take(0) if self.lengths else None

    def longest(self, most: int) -> tuple[int, int, int] | None:
        """Take a piece of the greatest length up to ``most``."""
        k = bisect_right(self.lengths, most)
        return self._take(k - 1) if k else None


def pack(lengths: list[int]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows ``(size, [(document, start, end), ...])`` that hold every token once and are all full."""
    windows, pool = [], _Pool()
    for i, n in enumerate(lengths):
        whole = n - n % WINDOW
        windows += [(WINDOW, [(i, a, a + WINDOW)]) for a in range(0, whole, WINDOW)]
        if n > whole:
            pool.put((i, whole, n))
    for tier in reversed(TIERS):
        shorter = tier // 2 if tier > TIERS[0] else 0
        while pool.lengths and pool.lengths[-1] > shorter:
            window, gap = [], tier
            while gap and (piece := pool.longest(gap)):
                window.append(piece)
                gap -= piece[2] - piece[1]
            if gap and (piece := pool.shortest()):  # nothing whole fits: fill with a head
                i, a, b = piece
                window.append((i, a, a + gap))
                pool.put((i, a + gap, b))
                gap = 0
            if not gap:
                windows.append((tier, window))
                continue
            total = tier - gap  # the pool is empty: the last window becomes windows of powers of two
            for size in (1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1):
                part, left = [], size
                while left:
                    i, a, b = window.pop(0)
                    cut = min(b, a + left)
                    part.append((i, a, cut))
                    left -= cut - a
                    if cut < b:
                        window.insert(0, (i, cut, b))
                windows.append((size, part))
    return windows


def _steps(windows: list) -> list[int]:
    """Step group of each window: the emptiest so far, longest windows first."""
    total = sum(w[0] for w in windows)
    heap = [(0, g) for g in range(max(1, -(-total // STEP_TOKENS)))]
    out = [0] * len(windows)
    for k in sorted(range(len(windows)), key=lambda k: (-windows[k][0], k)):
        load, g = heapq.heappop(heap)
        out[k] = g
        heapq.heappush(heap, (load + windows[k][0], g))
    return out


def packed(documents: DataFrame, tokenizer: str) -> DataFrame:
    """``documents(doc_id, text)`` packed with the vocabulary file ``tokenizer``: one row per piece."""

    bounded_batches(documents.sparkSession)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, at = encoder(tokenizer), TaskContext.get().partitionId() << 33
        n_seq = n_step = held = 0
        docs: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal n_seq, n_step, docs, held
            windows = pack([len(x) for _, x in docs])
            steps = _steps(windows)
            out = []
            for k, (size, pieces) in enumerate(windows):
                offset = 0
                for i, a, b in pieces:
                    doc_id, ids = docs[i]
                    out.append((doc_id, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()), len(ids), at + n_seq + k, offset, size, at + n_step + steps[k]))
                    offset += b - a
            n_seq, n_step = n_seq + len(windows), n_step + max(steps, default=-1) + 1
            docs, held = [], 0
            types = [pa.int32() if n == "tier" else pa.int64() for n in names]
            return pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

        for b in rows:
            doc_ids, texts = b.column(0).to_pylist(), b.column(1).cast(pa.large_string())
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            cuts = [0, *np.searchsorted(size, np.arange(BATCH_CHARS, size[-1], BATCH_CHARS)) + 1, len(b)] if len(b) else [0]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                for doc_id, ids in zip(doc_ids[i:j], enc.ids(texts[i:j]) if j > i else (), strict=True):
                    docs.append((doc_id, ids))
                    held += len(ids)
                    if held >= GROUP_TOKENS:
                        yield flush()
            tidy()
        if docs:
            yield flush()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
