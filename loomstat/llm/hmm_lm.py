"""Hidden Markov language model: Baum-Welch counts aggregated across partitions, exact likelihood by scaled forward recursion.

The ``SYMBOLS`` most frequent training words are symbols of their own (a bounded table that every task holds); any other
word falls into one of ``CLASSES`` classes by its ending. A hidden state emits symbols; a word of class r has probability
(c + 0.1) / (N_r + 0.1 (V_r + 1)) within it, from counts over the whole corpus, and one such share is left to all unseen
words. The probability of a text (its words, then one end) is the forward sum over states times these shares, so the
model is normalised. Counts of words outside the bounded table are joined by word; frequent words, which would make that
join uneven, are in the table.

Training: expected counts of every training text are summed per task, then over tasks, in ``ROUNDS`` Baum-Welch rounds
over the whole corpus, from the corpus distribution of symbols with fixed noise in each state; no sample takes part. Emissions
are smoothed towards the corpus distribution of symbols. For trials, ``quick_start`` first runs rounds on a sample of at most
``SAMPLE_TEXTS`` whole texts of any length, which ends with the text that reaches ``SAMPLE_TOKENS`` tokens a text of ``SAMPLE_TEXTS``.

Edge cases: null and empty texts consist of the end alone; a null id counts as empty text in the held-out rule; repeated
rows are scored each; without training rows every base token has probability 1 and the model is uniform. Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.llm.common import Scratch, held_out, tidy

STATES = 8
SYMBOLS = 49_152
CLASSES = 1024
END = 0  # symbol of the end; words follow, then classes
ROUNDS = 5
SAMPLE_TEXTS = 1500  # of a quick start only
SAMPLE_TOKENS = 1500  # on average, if there are SAMPLE_TEXTS texts
SAMPLE_ROUNDS = 12
SMOOTH = 100.0  # pseudo-counts of the corpus distribution in each state's emissions
BATCH_TOKENS = 400_000  # tokens of a batch, or one text
BATCH_BYTES = 1 << 24  # text that is split into words at once


def word_class(word: Column) -> Column:
    """Class of a word (binary) outside the symbol table: by its last three bytes."""
    return (F.crc32(F.substring(word, -3, 3)) % CLASSES).cast("int")


def _words(texts: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Words of texts as binary, and the number of words of each text; a bounded part of the texts at a time."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    cuts = [0, *np.searchsorted(size, np.arange(BATCH_BYTES, size[-1], BATCH_BYTES)) + 1, len(texts)] if len(texts) else [0]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        if j > i:
            lists = pc.ascii_split_whitespace(pc.ascii_lower(texts[i:j]))
            n = pc.list_value_length(lists)
            flat = lists.flatten().cast(pa.large_binary())
            full = pc.greater(pc.binary_length(flat), 0)  # white space at an end leaves an empty word
            row = np.repeat(np.arange(j - i), n.to_numpy(zero_copy_only=False))[full.to_numpy(zero_copy_only=False)]
            yield flat.filter(full), np.bincount(row, minlength=j - i)


def _counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows:
        for words, _ in _words(b.column(0)):
            c = words.value_counts()
            yield pa.record_batch([c.field("values").cast(pa.binary()), c.field("counts")], names=["word", "n"])
        tidy()


class Model:
    """Start, transition and emission probabilities with the bounded tables of the corpus."""

    def __init__(self, prior: np.ndarray):
        n = len(prior)
        self.prior = prior
        rng = np.random.default_rng(7)
        self.start = np.full(STATES, 1 / STATES)
        self.move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
        emit = prior * rng.gamma(1.0, 1.0, (STATES, n)) + 1e-300
        self._set((emit / emit.sum(axis=1, keepdims=True)).T)

    def update(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        """From expected counts; emit is by symbol."""
        self.start = (start + 0.5) / (start + 0.5).sum()
        self.move = (move + 0.5) / (move + 0.5).sum(axis=1, keepdims=True)
        e = emit + SMOOTH * self.prior[:, None]
        self._set(e / e.sum(axis=0))

    def _set(self, emit: np.ndarray) -> None:
        """Emissions by symbol."""
        self.emit = np.ascontiguousarray(emit)
        self.emit32 = self.emit.astype(np.float32)


def batches(texts: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Texts by falling length, as (indices, cuts, symbols): the symbols of all texts' first positions, then of their
    second ones, and so on without padding; position t is ``symbols[cuts[t] : cuts[t + 1]]``, in the order of indices."""
    order = sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i))
    size = np.cumsum([len(texts[i]) for i in order])
    a = 0
    while a < len(order):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + BATCH_TOKENS, side="right")))
        own = order[a:b]
        lengths = np.array([len(texts[i]) for i in own])
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # texts longer than t
        cuts = np.r_[0, np.cumsum(active)]
        sym = np.empty(cuts[-1], np.int32)
        for j, i in enumerate(own):
            sym[cuts[: lengths[j]] + j] = texts[i]
        yield own, cuts, sym
        a = b


def _forward(m: Model, cuts: np.ndarray, sym: np.ndarray, keep: bool) -> tuple:
    """Scaled forward recursion: scales by cell; with ``keep`` (in single precision) also emissions and states."""
    kind = np.float32 if keep else np.float64
    emit, move = (m.emit32 if keep else m.emit).take(sym, axis=0), m.move.astype(kind)
    alphas = np.empty_like(emit) if keep else None
    scales = np.empty(len(sym), kind)
    a = m.start.astype(kind) * emit[: cuts[1]]
    for t in range(len(cuts) - 1):
        lo, hi = cuts[t], cuts[t + 1]
        if t:
            a = (a[: hi - lo] @ move) * emit[lo:hi]
        s = a.sum(axis=1)
        a /= s[:, None]
        scales[lo:hi] = s
        if keep:
            alphas[lo:hi] = a
    return scales, emit, alphas


def log_likelihood(m: Model, cuts: np.ndarray, sym: np.ndarray) -> np.ndarray:
    """log10 likelihood of each text of a batch."""
    logs = np.log10(_forward(m, cuts, sym, False)[0])
    row = np.arange(len(sym)) - np.repeat(cuts[:-1], np.diff(cuts))
    return np.bincount(row, logs, cuts[1])


def expected(m: Model, texts: list[np.ndarray], n_symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts of starts, transitions and emissions (by symbol): sums in double precision of posteriors in
    single precision."""
    start, moves, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((n_symbols, STATES))
    back = np.ascontiguousarray(m.move.T.astype(np.float32))
    for _, cuts, sym in batches(texts):
        scales, e, alphas = _forward(m, cuts, sym, True)
        e /= scales[:, None]
        beta = np.ones((cuts[1], STATES), np.float32)
        for t in range(len(cuts) - 3, -1, -1):
            lo, mid, hi = cuts[t], cuts[t + 1], cuts[t + 2]
            n = hi - mid
            ahead = e[mid:hi]
            ahead *= beta[:n]  # from here on e holds what lies ahead of t
            moves += alphas[lo : lo + n].T @ ahead
            beta[:n] = ahead @ back
            alphas[lo : lo + n] *= beta[:n]  # the posterior; texts that end at t keep their state
        start += alphas[: cuts[1]].sum(axis=0, dtype=float)
        for k, g in enumerate(np.ascontiguousarray(alphas.T)):
            emit[:, k] += np.bincount(sym, g, n_symbols)
    return start, moves * m.move, emit


def _sample(coded: DataFrame, n: int) -> DataFrame:
    """Whole texts of any length in the order of a hash, until SAMPLE_TEXTS texts or SAMPLE_TEXTS x SAMPLE_TOKENS tokens
    are reached; the text that reaches them is in, so there is one at least."""
    order = F.pmod(F.xxhash64("rid", "n_tokens"), F.lit(1 << 20))
    draw = order < F.lit(int((1 << 20) * min(1.0, SAMPLE_TEXTS / n)) + 1)
    drawn = sorted(coded.where(draw).select(order, "rid", "n_tokens").limit(2 * SAMPLE_TEXTS).collect())
    before = np.cumsum([0, *(r["n_tokens"] for r in drawn)])[:-1]
    own = [r["rid"] for r, size in zip(drawn[:SAMPLE_TEXTS], before, strict=False) if size < SAMPLE_TEXTS * SAMPLE_TOKENS]
    return coded.where(F.col("rid").isin(own))


def _corpus_counts(coded: DataFrame, m: Model, n_symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``expected`` over all rows of ``coded(sym)``, summed per task and then over tasks."""
    schema = "item long, " + ", ".join(f"s{k} double" for k in range(STATES))
    now = coded.sparkSession.sparkContext.broadcast(m)

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in rows:
            got = expected(now.value, [np.frombuffer(x, np.uint16) for x in b["sym"]], n_symbols)
            total = got if total is None else tuple(x + y for x, y in zip(total, got, strict=True))
            tidy()
        if total is not None:
            start, move, emit = total
            seen = np.flatnonzero(emit.any(axis=1))
            rows_ = np.vstack([start[None], move, emit[seen]])
            item = np.r_[-1, -2 - np.arange(STATES), seen]
            yield pd.DataFrame({"item": item, **{f"s{k}": rows_[:, k] for k in range(STATES)}})

    sums = coded.select("sym").mapInPandas(run, schema).groupBy("item").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(STATES)])
    got = sums.toPandas().set_index("item")  # at most SYMBOLS + CLASSES + STATES + 2 rows
    start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((n_symbols, STATES))
    values, items = got.to_numpy(), got.index.to_numpy()
    emit[items[items >= 0]] = values[items >= 0]
    for i, v in zip(items, values, strict=True):
        if i == -1:
            start = v
        elif i < -1:
            move[-2 - i] = v
    now.unpersist()
    return start, move, emit


def _train(coded: DataFrame, m: Model, n_symbols: int, quick_start: bool = False) -> None:
    """ROUNDS rounds over all rows of ``coded(rid, n_tokens, sym)``; with ``quick_start`` after SAMPLE_ROUNDS on a sample."""
    n = coded.count()
    if not n:
        return
    if quick_start:
        sample = _sample(coded, n)
        for _ in range(SAMPLE_ROUNDS):
            m.update(*_corpus_counts(sample, m, n_symbols))
    for _ in range(ROUNDS):
        m.update(*_corpus_counts(coded, m, n_symbols))


def _cutoff(counts: DataFrame) -> int:
    """Smallest count that at most SYMBOLS words exceed, from histograms that refine the boundary bucket alone (a sorted
    limit would send SYMBOLS rows of every task to the driver)."""
    n, most = counts.agg(F.count(F.lit(1)), F.max("n")).first()
    if n <= SYMBOLS:
        return 0
    low, high, above = 1, most + 1, 0  # the count sought is in low .. high - 1
    while high - low > 1:
        width = -(-(high - low) // 1024)
        bucket = F.floor((F.col("n") - low) / width).cast("int")
        found = dict(counts.where((F.col("n") >= low) & (F.col("n") < high)).groupBy(bucket).count().collect())  # at most 1024 rows
        for k in sorted(found, reverse=True):
            if above + found[k] > SYMBOLS:
                low, high = low + k * width, min(high, low + (k + 1) * width)
                break
            above += found[k]
    return low


def score(documents: DataFrame, quick_start: bool = False) -> DataFrame:
    """Per row of ``documents(doc_id, text)``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "hmm")
    out_of = held_out(F.col("doc_id"), 10, 0)
    train = documents.where(~out_of)
    counts = scratch.pin(train.select("text").mapInArrow(_counted, "word binary, n long")
                         .groupBy("word").agg(F.sum("n").alias("n")).withColumn("class", word_class(F.col("word"))))
    texts = train.select("doc_id").count()
    words, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_all, v_all = words + texts, types + (texts > 0)
    cutoff = _cutoff(counts)
    top = sorted(counts.where(F.col("n") > cutoff).collect(), key=lambda r: (-r["n"], r["word"]))  # at most SYMBOLS rows
    table = {bytes(r["word"]): k + 1 for k, r in enumerate(top)}
    symbol_count = np.array([texts, *(r["n"] for r in top)], float)
    n_words = len(symbol_count)
    n_symbols = n_words + CLASSES
    if n_symbols > 65_536:
        raise ValueError("SYMBOLS and CLASSES have to fit 16 bits")
    rare = counts.where(F.col("n") <= cutoff)
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in rare.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # CLASSES rows
        class_n[r["class"]], class_v[r["class"]] = r["n"], r["v"]
    prior = np.r_[symbol_count, class_n] + 0.1
    m = Model(prior / prior.sum())

    lookup = spark.sparkContext.broadcast(table)

    def code(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = lookup.value.get
        for b in rows:
            at = 0
            for words, n in _words(b.column("text")):
                coded = words.dictionary_encode()
                distinct = coded.dictionary.to_pylist()
                known = np.array([get(w, 0) for w in distinct], np.uint16)
                new = known == 0
                known[new] = [n_words + zlib.crc32(w[-3:]) % CLASSES for w, k in zip(distinct, new, strict=True) if k]
                code_ = coded.indices.to_numpy(zero_copy_only=False)
                ends = np.cumsum(n)
                sym = np.insert(known[code_], ends, END).astype(np.uint16)  # an end after each text's words
                cuts = (ends + np.arange(1, len(n) + 1)) * 2
                other = new[code_]
                others = np.r_[0, np.cumsum(other)][np.r_[0, ends]]
                part = b.slice(at, len(n))
                at += len(n)
                yield pa.record_batch(
                    [part.column("rid"), part.column("doc_id"), part.column("held_out"), pa.array(n + 1, pa.int64()),
                     pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.r_[0, cuts].astype(np.int32)), pa.py_buffer(sym.tobytes())]),
                     pa.ListArray.from_arrays(pa.array(others, pa.int32()), words.filter(pa.array(other)).cast(pa.binary()))],
                    names=["rid", "doc_id", "held_out", "n_tokens", "sym", "other"])
            tidy()

    coded = documents.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), out_of.alias("held_out"), "text")
    coded = scratch.pin(coded.mapInArrow(code, "rid long, doc_id long, held_out boolean, n_tokens long, sym binary, other array<binary>"))
    _train(coded.where("NOT held_out"), m, n_symbols, quick_start)

    base_all = np.log10(n_all + 0.1 * (v_all + 1))
    base = np.r_[np.log10(symbol_count + 0.1), np.zeros(CLASSES)]
    known = np.r_[symbol_count > 0, np.zeros(CLASSES, bool)]
    share = np.log10(class_n + 0.1 * (class_v + 1))
    final = spark.sparkContext.broadcast((m, base, known, share))

    def scored(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, base_, known_, share_ = final.value
        for b in rows:
            s = [np.frombuffer(x, np.uint16) for x in b["sym"]]
            logs = np.empty(len(s))
            for own, cuts, sym in batches(s):
                logs[own] = log_likelihood(model, cuts, sym)
            tidy()
            logs -= [share_[x[x >= n_words] - n_words].sum() for x in s]
            yield pd.DataFrame({"rid": b["rid"], "doc_id": b["doc_id"], "held_out": b["held_out"], "n_tokens": b["n_tokens"],
                                "known": [int(known_[x].sum()) for x in s], "base": [base_[x].sum() for x in s], "hmm": logs})

    # ids travel as text: pandas has no nullable long without loss
    main = coded.drop("other").withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(scored, "rid long, doc_id string, held_out boolean, n_tokens long, known long, base double, hmm double")
    # words outside the table: their counts by a join (none of them is frequent)
    tail = coded.where(F.size("other") > 0).select("rid", F.explode("other").alias("word"))
    tail = tail.join(rare.select("word", "n"), "word", "left").groupBy("rid").agg(
        F.count("n").alias("others_known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("others_log"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return main.join(tail, "rid", "left").select(
        F.col("doc_id").cast("long").alias("doc_id"), "held_out", "n_tokens", (F.col("known") + zero("others_known")).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("others_log") - F.col("n_tokens") * F.lit(float(base_all))).alias("base_score"),
        (F.col("hmm") + zero("others_log")).alias("score"))
