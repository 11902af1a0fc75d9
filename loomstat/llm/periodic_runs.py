"""Periodic runs inside documents, found by seed and extend along diagonals.

A run is a stretch of consecutive words with smallest period q (words q apart are the same), at least
``max(MIN_WORDS, 2 * q)`` words long, that neither neighbouring word extends. On the diagonal of lag q a run of n words
is a stretch of n - q equal pairs ``word[i] == word[i + q]``. The guaranteed overlap n - q is at least 6 for every lag and
at least q, so lags 1 to 11 are seeded by 6-grams and lags k to 2k - 1 by k-grams for k = 12, 24, 48, ...:

1. Names. The grams of 2**t words are named level by level (equal name = equal words of one document), so a k-gram is a
   pair of overlapping names and two stretches are compared in a logarithmic number of steps, exactly.
2. Seeds. Occurrences of a k-gram are sorted by position and paired within the lags of the step. Within a chain of
   occurrences whose gaps are at most k/2 (the gram itself is periodic) only the first one, the leader, is paired with all
   others: a pair of two followers continues the pair one gap before it on the same diagonal. A gram has at most a few
   leaders in any 2k words, so the seeds are linear in the words for each step, whatever the text.
3. Extension. For every (document, lag) a table holds the furthest position that an extension has covered; the next seed
   at or beyond it is extended to the left and right, seeds before it are passed over. Rounds take 1, 2, 4, ... such
   seeds of each lag at once.
4. A stretch found on several lags has the smallest of them as its period.

Documents are independent: batches of them are worked on as one array inside a task, nothing is shuffled. Memory is a few
arrays of ``CHUNK_WORDS`` words, or of the longest text, times the levels that still hold repeated grams.

Edge cases: null or empty texts have no words and no runs; repeated rows are told each; a null id is the empty decimal; very
long texts are taken whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.llm.common import bounded_batches, tidy

MIN_WORDS = 12
SEED = 6  # least overlap of a run with itself at its period: max(MIN_WORDS - q, q) >= 6
CHUNK_WORDS = 400_000

Words = list[bytes]
Rewrite = Callable[[str, Words], Words]


class Names:
    """Names of the grams of 2**t positions: equal and not negative where equal grams start; -1 where a gram occurs once."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.levels = [self._name(ids, np.arange(self.n))]
        while True:
            step, last = 1 << (len(self.levels) - 1), self.levels[-1]
            live = np.flatnonzero(last >= 0)
            live = live[live + step < self.n]
            live = live[last[live + step] >= 0]
            if not len(live):
                break
            level = self._name(last[live].astype(np.int64) * self.n + last[live + step], live)
            if not (level >= 0).any():
                break
            self.levels.append(level)

    def _name(self, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Names at the positions ``at`` with the given keys."""
        out = np.full(self.n, -1, np.int32)
        order = np.argsort(keys, kind="stable")
        new = np.r_[True, keys[order][1:] != keys[order][:-1]]
        first = np.flatnonzero(new)
        several = np.diff(np.r_[first, len(keys)]) > 1
        group = np.cumsum(new) - 1
        keep = several[group]
        out[at[order[keep]]] = group[keep]
        return out

    def gram(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions where a repeated gram of k words may start, and its name there."""
        t = k.bit_length() - 1
        if t >= len(self.levels):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        shift, level = k - (1 << t), self.levels[t]
        at = np.flatnonzero(level >= 0)
        at = at[at + shift < self.n]
        at = at[level[at + shift] >= 0]
        return at, level[at].astype(np.int64) * self.n + level[at + shift]

    def reach(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and j on are the same."""
        a, b = i.copy(), j.copy()
        for t in range(len(self.levels) - 1, -1, -1):
            level, step = self.levels[t], 1 << t
            x, y = np.minimum(a, self.n - 1), np.minimum(b, self.n - 1)
            same = (b < self.n) & (level[x] >= 0) & (level[x] == level[y])
            a += same * step
            b += same * step
        return a - i

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and j are the same."""
        a, b = i.copy(), j.copy()
        for t in range(len(self.levels) - 1, -1, -1):
            level, step = self.levels[t], 1 << t
            x, y = np.maximum(a - step, 0), np.maximum(b - step, 0)
            same = (a >= step) & (level[x] >= 0) & (level[x] == level[y])
            a -= same * step
            b -= same * step
        return i - a


def _seeds(names: Names, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Seed pairs (i, lag) of equal k-grams with least <= lag < 2k, one document each (names never span documents)."""
    at, key = names.gram(k)
    if not len(at):
        return at, at
    order = np.argsort(key, kind="stable")  # positions stay ascending within a gram
    key, at = key[order], at[order]
    group = np.cumsum(np.r_[False, key[1:] != key[:-1]])
    place = group * (4 * names.n) + at  # one axis for all grams, wider than any lag
    follower = np.r_[False, (group[1:] == group[:-1]) & (np.diff(at) <= k // 2)]
    lead = np.flatnonzero(~follower)

    def paired(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(place, lo), np.searchsorted(place, hi)
        n = np.maximum(b - a, 0)
        other = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return np.repeat(lead, n), other

    one, two = paired(place[lead] + least, place[lead] + 2 * k)
    three, four = paired(place[lead] - 2 * k + 1, place[lead] - least + 1)
    i, j = np.r_[at[one], at[four]], np.r_[at[two], at[three]]
    same = np.r_[group[one] == group[two], group[three] == group[four]]
    return i[same], (j - i)[same]


def stretches(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Runs of an array of word ids (ids of different documents differ; ``doc`` ascends): rows (start, length, period)."""
    n = len(ids)
    found = [np.empty((0, 3), np.int64)]
    if n < MIN_WORDS:
        return found[0]
    names, longest = Names(ids), int(np.bincount(doc).max())
    k = SEED
    while 2 * k <= longest:
        i, lag = _seeds(names, k, 1 if k == SEED else k)
        table = doc[i].astype(np.int64) * (2 * k) + lag  # one row for each document and lag
        order = np.lexsort((i, table))
        i, lag, table = i[order], lag[order], table[order]
        head = np.flatnonzero(np.r_[True, table[1:] != table[:-1]]) if len(table) else np.empty(0, np.int64)
        end = np.r_[head[1:], len(table)]
        axis = (np.cumsum(np.r_[False, table[1:] != table[:-1]]) if len(table) else table) * (n + 1) + i
        row, width = np.arange(len(head)), 1
        while len(head):
            take = np.minimum(width, end - head)
            begin = np.r_[0, np.cumsum(take)[:-1]]
            at = np.repeat(head - begin, take) + np.arange(take.sum())
            a, q = i[at], lag[at]
            reached = a + names.reach(a, a + q)
            start = a - names.back(a, a + q)
            length = reached + q - start
            long = length >= np.maximum(MIN_WORDS, 2 * q)
            found.append(np.c_[start, length, q][long])
            furthest = np.maximum.reduceat(reached, begin)  # covered up to here on this document's lag
            head = np.maximum(head + take, np.searchsorted(axis, row * (n + 1) + furthest))
            more = head < end
            head, end, row = head[more], end[more], row[more]
            width *= 2  # a lag with many stretches takes few rounds
        k *= 2
    got = np.concatenate(found)
    got = got[np.lexsort((got[:, 2], got[:, 1], got[:, 0]))]
    smallest = np.r_[True, (got[1:, :2] != got[:-1, :2]).any(axis=1)] if len(got) else np.empty(0, bool)
    return got[smallest]


def _collapsed(words: Words, spans: np.ndarray) -> str:
    """The words that no run holds beyond its first period, joined by single spaces."""
    if len(spans):
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, spans[:, 0] + spans[:, 2], 1)
        np.add.at(edge, spans[:, 0] + spans[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
    return b" ".join(words).decode("utf-8", "replace")


def _chunk(texts: list[Words]) -> list[tuple[np.ndarray, str]]:
    """Runs and collapsed text of each text, worked on as one array."""
    sizes = np.array([len(w) for w in texts], np.int64)
    first = np.r_[0, np.cumsum(sizes)]
    doc = np.repeat(np.arange(len(texts)), sizes)
    flat = np.empty(int(first[-1]), object)
    flat[:] = [w for ws in texts for w in ws]
    ids = pd.factorize(flat)[0].astype(np.int64) * len(texts) + doc
    got = stretches(ids, doc)
    cut = np.searchsorted(got[:, 0], first)
    out = []
    for k, words in enumerate(texts):
        mine = got[cut[k] : cut[k + 1]] - np.array([first[k], 0, 0])
        mine = mine[np.lexsort((mine[:, 2], mine[:, 0]))]
        out.append((mine, _collapsed(words, mine)))
    return out


def _told(rows: Iterator[pd.DataFrame], rewrite: Rewrite | None) -> Iterator[pd.DataFrame]:
    for batch in rows:
        ids, texts = list(batch["_id"]), list(batch["_text"])
        a, held, size = 0, [], 0
        for b, text in enumerate(texts):
            words = text.encode("utf-8", "surrogatepass").split() if text else []
            held.append(rewrite(ids[b], words) if rewrite else words)
            size += len(words)
            if size >= CHUNK_WORDS or b + 1 == len(texts):
                told = _chunk(held)
                yield pd.DataFrame({
                    "_row": batch["_row"].iloc[a : b + 1].to_numpy(), "n_words": [len(w) for w in held],
                    "runs": [[{"start": int(s), "length": int(n), "period": int(q)} for s, n, q in spans] for spans, _ in told],
                    "collapsed": [text for _, text in told]})
                a, held, size = b + 1, [], 0
    tidy()


def periodic_runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Rewrite | None = None) -> DataFrame:
    """Per row of ``documents``: ``id_col``, n_words, runs (array of start, length, period by start, then period) and collapsed
    (the text without the repetitions). ``rewrite(decimal id, words)`` may replace a document's words beforehand."""
    bounded_batches(documents.sparkSession)
    kind = documents.schema[id_col].dataType.simpleString()
    given = documents.select(F.col(id_col).alias("_row"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.col(text_col).alias("_text"))
    out = given.mapInPandas(lambda rows: _told(rows, rewrite),
                            f"_row {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("_row", id_col)


def planted(doc_id: str, words: Words) -> Words:
    """Every tenth document (by crc32 of its decimal id) repeats itself from some word on; fixed by the digest's contract."""
    g, h = divmod(zlib.crc32(doc_id.encode()), 10)
    n = len(words)
    if h or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * -(-(n - a) // len(unit)))[: n - a]


def _best(of: str) -> Column:
    """A field of the longest run; ties go to the smaller start, then the smaller period."""
    return F.expr(f"array_max(transform(runs, r -> named_struct('length', r.length, 'start', -r.start, 'period', -r.period))).{of}")


def digest(runs: DataFrame) -> DataFrame:
    """Number of runs, the longest one, and hashes of all runs and of the collapsed text, from ``periodic_runs``."""
    length, start, period = _best("length"), -_best("start"), -_best("period")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
                       F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
                       F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
