"""Language identification by hierarchical discrimination with linear support vector machines.

A text becomes hashed counts of its letter 1- to 3-grams (whole text, letters lower-cased, everything else one space),
square-rooted and scaled to length 1. One-versus-one linear machines first choose the language family, then, within the
chosen family, one-versus-one machines choose the language. Languages are grouped by the table ``FAMILIES``; a language
that it does not name is a family of its own.

The machines are fitted on a bounded sample (about ``SAMPLE_ROWS`` labelled rows and twice that at most, spread evenly over
the languages, chosen by a hash of the id). The sample stays in Spark: its features are written once, every machine is
fitted in a task of its own on the rows of its two sides, and only weights (16 KB a machine) reach the driver and are
broadcast. Prediction is one pass over all texts.

Edge cases: null texts and texts without a letter are ``und`` with score 0; with no labelled training row everything is
``und``, with a single language that language is predicted with score 1; equal votes go to the larger summed margin, then
to the first name. Repeated rows are predicted each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.llm.common import Scratch, bounded_batches, held_out, tidy

BITS = 12
DIM = 1 << BITS
SAMPLE_ROWS = 6000
BLOCK = 1 << 20
UNKNOWN = "und"

# ISO 639 codes by family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "indic": "hi ur bn mr gu pa ne",
    "turkic": "tr az kk uz",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter; its lower case if that is one code point."""
    if not _TABLES:
        _TABLES["letter"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        _TABLES["lower"] = np.fromiter((ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(0x110000)), np.uint32, 0x110000)
    return _TABLES["letter"], _TABLES["lower"]


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of a text; None if it has no letter."""
    if not text:
        return None
    letter, lower = _tables()
    counts = np.zeros(DIM)
    for a in range(0, len(text), BLOCK):
        cp = np.frombuffer(text[a : a + BLOCK + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letter[cp]
        if not is_letter.any():
            continue
        cp = np.where(is_letter, lower[cp], 32)
        cp = cp[is_letter | np.r_[True, is_letter[:-1]]].astype(np.uint64)  # runs of other characters become one space
        h = cp * np.uint64(0x9E3779B97F4A7C15)
        two = (h[:-1] ^ (h[:-1] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + h[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) + h[2:]
        for g in (h, two * np.uint64(0xD6E8FEB86659FD93), three * np.uint64(0xA0761D6478BD642F)):
            counts += np.bincount((g >> np.uint64(64 - BITS)).astype(np.int64), minlength=DIM)
    if not counts.any():
        return None
    x = np.sqrt(counts)
    return (x / np.linalg.norm(x)).astype(np.float32)


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, cost: float = 20.0) -> np.ndarray:
    """Linear machine with squared hinge loss, both classes weighing the same. The last column of x is 1 (bias), y is +1 or -1."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    ahead, step = w, 1.0 / (1.0 + 2 * cost * 2.0)  # the loss is smooth: rows have norm sqrt(2) at most
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        grad = ahead - 2 * cost * (x.T @ (weight * y * slack))
        new = ahead - step * grad
        ahead, w = new + (k / (k + 3.0)) * (new - w), new
    return w


def _plan(langs: list[str]) -> list[tuple[str, str, str, dict[str, int]]]:
    """All machines as (where, a, b, side of each language): ``where`` is "" for families, else the family."""
    family = {c: _FAMILY.get(c, "=" + c) for c in langs}
    out = [("", a, b, {c: 1 if family[c] == a else -1 for c in langs if family[c] in (a, b)}) for a, b in combinations(sorted(set(family.values())), 2)]
    for f in sorted(set(family.values())):
        out += [(f, a, b, {a: 1, b: -1}) for a, b in combinations(sorted(c for c in langs if family[c] == f), 2)]
    return out


def machine(rows: pd.DataFrame) -> np.ndarray:
    """Weights and bias of one machine from rows (y, x as float16 bytes), in an order of their own so that reruns agree."""
    order = sorted(range(len(rows)), key=lambda i: (rows["y"].iat[i], rows["x"].iat[i]))
    x = np.ones((len(rows), DIM + 1), np.float32)
    for k, i in enumerate(order):
        x[k, :DIM] = np.frombuffer(rows["x"].iat[i], np.float16)
    return _fit(x, rows["y"].to_numpy(np.float32)[order])


def _machine_of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    w = machine(rows)
    tidy()
    return pd.DataFrame({"m": [key[0]], "w": [w.astype(np.float32).tobytes()]})


def assemble(langs: list[str], weights: list[np.ndarray]) -> dict:
    """Model from the languages and the machines of ``_plan``, in its order."""
    if not langs:
        return {}
    got: dict[str, dict] = {}
    family = {c: _FAMILY.get(c, "=" + c) for c in langs}
    for where in ["", *sorted(set(family.values()))]:
        got[where] = {"classes": sorted(set(family.values())) if where == "" else sorted(c for c in langs if family[c] == where), "pairs": [], "w": []}
    for (where, a, b, _), w in zip(_plan(langs), weights, strict=True):
        m = got[where]
        m["pairs"].append((m["classes"].index(a), m["classes"].index(b)))
        m["w"].append(w)
    for m in got.values():
        m["w"] = np.array(m["w"], np.float32).reshape(len(m["pairs"]), DIM + 1)
    return {"family": got.pop(""), "within": got}


def _vote(m: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class index and probability of each row of x."""
    n, k = len(x), len(m["classes"])
    wins, margins, least = np.zeros((n, k)), np.zeros((n, k)), np.full((n, k), np.inf)
    out = x @ m["w"][:, :DIM].T + m["w"][:, DIM]
    for j, (a, b) in enumerate(m["pairs"]):
        for c, v in ((a, out[:, j]), (b, -out[:, j])):
            wins[:, c] += v > 0 if c == a else v >= 0
            margins[:, c] += v
            least[:, c] = np.minimum(least[:, c], v)
    best = np.lexsort((np.broadcast_to(-np.arange(k), (n, k)), margins, wins))[:, -1]
    return best, 1 / (1 + np.exp(-4 * np.maximum(least[np.arange(n), best], -50)))


def predict(model: dict, texts: pd.Series, block: int = 256) -> tuple[list[str], list[float]]:
    lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    texts = list(texts)
    for a in range(0, len(texts) if model else 0, block):
        got = [(i, x) for i in range(a, min(a + block, len(texts))) if (x := features(texts[i])) is not None]
        if not got:
            continue
        rows, x = np.array([i for i, _ in got]), np.array([v for _, v in got])
        fam, p = _vote(model["family"], x)
        for f in set(fam):
            sel = np.flatnonzero(fam == f)
            m = model["within"][model["family"]["classes"][f]]
            best, q = _vote(m, x[sel])
            for r, c, s in zip(rows[sel], best, p[sel] * q, strict=True):
                lang[r], score[r] = m["classes"][c], float(s)
    return lang, score


def _features_of(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in rows:
        x = [features(t) for t in b["text"]]
        ok = [i for i, v in enumerate(x) if v is not None]
        yield pd.DataFrame({"lang": b["lang"].iloc[ok].to_numpy(), "x": [x[i].astype(np.float16).tobytes() for i in ok]})
    tidy()


def train(documents: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    """Fit on a sample of the training rows (not held out, with a language) of at most about ``rows`` rows."""
    known = documents.where(~held_out(F.col("doc_id"), 4, 2) & F.col("lang").isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return {}
    share = max(1, rows // len(counts))
    part = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        part = F.when(F.col("lang") == lang, min(1.0, share / n)).otherwise(part)
    draw = F.pmod(F.xxhash64(F.lit(5), "doc_id", F.length("text")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = known.select("lang", "text", draw.alias("d"), part.alias("p")).where("d < p").select("lang", "text")
    scratch = Scratch(documents.sparkSession, "langid")
    points = scratch.pin(sample.mapInPandas(_features_of, "lang string, x binary").limit(2 * rows))
    langs = sorted(r[0] for r in points.select("lang").distinct().collect())  # at most one row a language
    plan = _plan(langs)
    sides = [(i, lang, side) for i, (_, _, _, of) in enumerate(plan) for lang, side in of.items()]
    weights = {}
    if sides:
        dealt = points.join(documents.sparkSession.createDataFrame(sides, "m int, lang string, y int"), "lang").select("m", "y", "x")
        fitted = dealt.groupBy("m").applyInPandas(_machine_of, "m int, w binary")
        weights = {r["m"]: np.frombuffer(r["w"], np.float32) for r in fitted.toLocalIterator()}  # 16 KB a machine
    scratch.drop(points)
    return assemble(langs, [weights[i] for i in range(len(plan))])


def language(documents: DataFrame, text: Column) -> Column:
    """Struct (lang, score) of a text, by a model fitted on ``documents``."""
    bounded_batches(documents.sparkSession)
    model = documents.sparkSession.sparkContext.broadcast(train(documents))

    @F.pandas_udf("lang string, score double")
    def identify(t: pd.Series) -> pd.DataFrame:
        lang, score = predict(model.value, t)
        tidy()
        return pd.DataFrame({"lang": lang, "score": score})

    return identify(text)


def identify(documents: DataFrame) -> DataFrame:
    """Per row of ``documents(doc_id, text, lang)``: doc_id, held_out, lang_pred, score."""
    told = documents.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), language(documents, F.col("text")).alias("r"))
    return told.select("doc_id", "held_out", F.col("r.lang").alias("lang_pred"), F.col("r.score").alias("score"))


def known_language(documents: DataFrame) -> DataFrame:
    """``documents`` without those whose text has no recognisable language (``und``)."""
    return documents.where(language(documents, F.col("text"))["lang"] != UNKNOWN)
