"""Quality by co-training a text view and a page-metadata view.

The text view sees the content: hashed byte pairs of the raw text and its layout (lines, shares of digits, capitals,
signs and blanks, repeated lines and words).  The metadata view sees what is recorded beside the text: source, language, both
together, and the recorded number of characters.  No feature is in both.  Each view is a logistic regression.

In every round both views score all unlabelled rows.  From the distribution of their scores (counted in 1,000 steps, whatever
the number of rows) comes the cut beyond which the surest ``SHARE`` of all rows lies; those rows get pseudo-labels, which the
other view learns from.  Both are then calibrated on labelled rows kept aside, and their evidence added, to score every document.

A fit holds at most about ``LABELLED`` labelled rows, and as many pseudo-labelled ones for each view, drawn by a hash of the
id from all that there are: the documented bound of the fit's sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.rows import SPACE, Chunk, small_batches, steady, text_chunks

DIMS = 2048
LABELLED = 6000
ROUNDS = 3
#: share of the unlabelled rows that a view labels in a round, and how sure it must be of them
SHARE, SURE = 0.05, 0.8
_LAYOUT = 11
_TEXT = DIMS + _LAYOUT
_SIZES, _SOURCES, _LANGS, _BOTH = 24, 64, 32, 128
_META = 2 + _SIZES + _SOURCES + _LANGS + _BOTH


def text_view(chunk: Chunk) -> np.ndarray:
    """Unit vectors of 1 + ln of the hashed byte pairs, then numbers of the layout."""
    out = np.zeros((len(chunk), _TEXT), np.float32)
    d = chunk.data
    wide = d.astype(np.uint32)
    pairs = ((wide[:-1] | (wide[1:] << 8)) * np.uint32(0x9E3779B1) >> np.uint32(21)).astype(np.int64)
    for i in range(len(chunk)):
        a, b = int(chunk.bounds[i]), int(chunk.bounds[i + 1])
        if b - a > 1:
            out[i, :DIMS] = np.bincount(pairs[a : b - 1], minlength=DIMS)
        body = d[a:b].tobytes()
        lines, parts = body.split(b"\n"), body.split()
        out[i, DIMS + 9] = 1 - len(set(lines)) / len(lines)
        out[i, DIMS + 10] = 1 - len(set(parts)) / max(1, len(parts))
    grams = np.log1p(out[:, :DIMS])
    out[:, :DIMS] = grams / np.maximum(np.sqrt((grams * grams).sum(axis=1, keepdims=True)), 1e-12)
    signs = ((d >= 33) & (d <= 47)) | ((d >= 58) & (d <= 64)) | ((d >= 91) & (d <= 96)) | ((d >= 123) & (d <= 126))
    sums = []
    for m in ((d >= 48) & (d <= 57), (d >= 65) & (d <= 90), signs, SPACE[d], d == 0x0A, (d & 0xC0) != 0x80):
        total = np.zeros(len(d) + 1, np.int64)
        np.cumsum(m, out=total[1:])
        sums.append((total[chunk.bounds[1:]] - total[chunk.bounds[:-1]]).astype(np.float64))
    digits, capitals, signs, blanks, breaks, chars = sums
    size = np.maximum(chars, 1)
    numbers = np.log1p(chars) / 10, np.log1p(breaks) / 5, np.log1p(chars / (breaks + 1)) / 8, *(5 * x / size for x in (digits, capitals, signs, blanks)), (5 * signs / size) ** 2, (5 * capitals / size) ** 2
    for j, x in enumerate(numbers):
        out[:, DIMS + j] = x
    return out


def meta_view(sources: list[str | None], langs: list[str | None], sizes: list[int | None]) -> np.ndarray:
    """The recorded length and its power of two, hashed source, language and both together; a null is a value of its own."""
    out = np.zeros((len(sources), _META), np.float32)
    at = np.cumsum([2, _SIZES, _SOURCES, _LANGS])
    for i, (source, lang, size) in enumerate(zip(sources, langs, sizes, strict=True)):
        names = [repr(x).encode() for x in (source, lang, (source, lang))]
        out[i, 0], out[i, 1] = size is None, np.log1p(max(0, size or 0)) / 10
        out[i, at[0] + min(_SIZES - 1, max(0, size or 0).bit_length())] = 1
        for base, name, width in zip(at[1:], names, (_SOURCES, _LANGS, _BOTH), strict=True):
            out[i, base + crc32(name) % width] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, start: np.ndarray | None = None, rounds: int = 120) -> np.ndarray:
    """Weights (the last is the bias) by accelerated gradient steps, from zero or from earlier weights."""
    n = len(x)
    step = 1.0 / (0.25 * (float(np.einsum("ij,ij->i", x, x).max()) + 1) + ridge)
    w = np.zeros(x.shape[1] + 1) if start is None else start.copy()
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        wrong = (1 / (1 + np.exp(-np.clip(margin(x, ahead), -30, 30))) - y) / n
        new = ahead - step * (np.append(wrong.astype(x.dtype) @ x, wrong.sum()) + ridge * ahead)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (before - 1) / t * (new - w)
        w = new
    return w


def margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1].astype(x.dtype) + w[-1]


def platt(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into log-odds; the identity where one class is missing."""
    if len(np.unique(y)) < 2:
        return 1.0, 0.0
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((y - p) * m).sum() - 0.01 * (a - 1), (y - p).sum() - 0.01 * b])
        v = p * (1 - p)
        h = np.array([[(v * m * m).sum() + 0.01, (v * m).sum()], [(v * m).sum(), v.sum() + 0.01]])
        a, b = (np.array([a, b]) + np.clip(np.linalg.solve(h, g), -3, 3)).tolist()
    return a, b


def chances(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


class Model:
    """Weights and calibration of both views, the prior log-odds, and how many rows each view labelled in each round."""

    def __init__(self, weights: list[np.ndarray], marks: list[tuple[float, float]], prior: float, taken: list[tuple[int, int]]):
        self.weights, self.marks, self.prior, self.taken = weights, marks, prior, taken

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality by text, by metadata, and by both: log-odds of independent views add up, the prior once."""
        t, m = (a * margin(x, w) + b for x, w, (a, b) in zip((text, meta), self.weights, self.marks, strict=True))
        return chances(t), chances(m), chances(t + m - self.prior)


def _base(docs: DataFrame) -> DataFrame:
    have = set(docs.columns)
    meta = [F.col(c).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in (("source", "string"), ("lang", "string"), ("n_chars", "long"))]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *meta)


def _views(batch: pa.RecordBatch, at: int) -> Iterator[tuple[Chunk, np.ndarray, np.ndarray]]:
    """Both views of the rows of a batch, whose text, source, lang and n_chars begin at a column."""
    recorded = [batch.column(at + i).to_pylist() for i in (1, 2, 3)]
    for chunk in text_chunks(batch.column(at)):
        yield chunk, text_view(chunk), meta_view(*(x[chunk.first : chunk.first + len(chunk)] for x in recorded))


def _features(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both views and the label of (doc_id, text, source, lang, n_chars, y), in the order of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, text, meta in _views(batch, 1):
                blobs = [pa.array([r.astype(np.float16).tobytes() for r in v], pa.binary()) for v in (text, meta)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), batch.column(5).slice(chunk.first, len(chunk)), *blobs], ["doc_id", "y", "text", "meta"])

    found = rows.select("doc_id", "text", "source", "lang", "n_chars", F.col("y").cast("double").alias("y")).mapInArrow(run, "doc_id long, y double, text binary, meta binary")
    found = found.toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])

    def matrix(name: str, width: int) -> np.ndarray:
        return np.frombuffer(b"".join(found.column(name).to_pylist()), np.float16).reshape(-1, width).astype(np.float32)

    return matrix("text", _TEXT), matrix("meta", _META), found.column("y").to_numpy().astype(float)


def _drawn(rows: DataFrame, n: int, bound: int, seed: int) -> DataFrame:
    """About ``bound`` of ``n`` rows by a hash of the id; all of them if there are no more."""
    share = min(1.0, bound / max(1, n))
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 20)) < share * (1 << 20))


def _cuts(scored: DataFrame, view: str, good: float, share: float) -> tuple[float, float]:
    """The scores below and above which the surest ``share`` of the rows lies, split as good and bad are; at least ``SURE``."""
    steps = scored.groupBy(F.floor(F.col(view) * 1000).cast("int").alias("s")).count().collect()  # 1,001 rows at most
    counts = np.zeros(1001)
    for r in steps:
        counts[min(1000, max(0, r["s"]))] += r["count"]
    upto = np.cumsum(counts)
    low = int(np.searchsorted(upto, upto[-1] * share * (1 - good))) / 1000
    high = int(np.searchsorted(upto, upto[-1] * (1 - share * good), "right")) / 1000
    return min(max(low, 0.001), 1 - SURE), max(min(high, 0.999), SURE)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, share: float = SHARE) -> Model:
    """Co-train on ``labels`` (doc_id, quality) of ``docs``.

    Null labels and null ids are left out; of several labels of one id the largest counts.  Repeated rows are rows like any other; rows of one id
    are drawn together.  Without labels, or with those of one class only, no pseudo-labels are given.  Empty tables give a model that scores 0.5.
    """
    small_batches(docs.sparkSession)
    known = steady(labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") > 0).cast("double")).alias("y")))
    base = _base(docs).where("doc_id is not null")
    some = steady(_drawn(known, known.count(), labelled, 5))  # about ``labelled`` rows at most
    text, meta, y = _features(base.join(F.broadcast(some), "doc_id"))
    if not len(y):
        return Model([np.zeros(_TEXT + 1), np.zeros(_META + 1)], [(1.0, 0.0)] * 2, 0.0, [])
    views, ridges = (text, meta), (1e-5, 1e-4)
    aside = np.arange(len(y)) % 5 == 4  # every fifth row is kept for calibration
    if not aside.any():
        aside = np.ones(len(y), bool)
    own = ~aside if (~aside).any() else aside
    good = float(np.clip(y[own].mean(), 0.01, 0.99))
    weights = [logistic(views[v][own], y[own], ridges[v]) for v in (0, 1)]
    taken = []
    for turn in range(rounds if len(np.unique(y[own])) > 1 else 0):
        scored = steady(_scored(base, weights).join(known, "doc_id", "left_anti"))  # scores are shuffled, not texts
        counts = []
        for told in (1, 0):  # the view that learns; the other one labels
            view = ("text", "meta")[1 - told]
            low, high = _cuts(scored, view, good, share) if not scored.isEmpty() else (0.0, 1.0)
            sure = scored.where((F.col(view) < low) | (F.col(view) >= high)).select("doc_id", F.when(F.col(view) >= high, 1.0).otherwise(0.0).alias("y"))
            sure = sure.groupBy("doc_id").agg(F.max("y").alias("y"))
            counts.append(sure.count())
            some = steady(_drawn(sure, counts[-1], labelled, 11 + turn))  # about ``labelled`` ids at most
            extra = _features(base.join(F.broadcast(some), "doc_id"))
            x = np.concatenate([views[told][own], extra[told]])
            weights[told] = logistic(x, np.concatenate([y[own], extra[2]]), ridges[told], weights[told], 60)
        taken.append(tuple(counts))
    marks = [platt(margin(views[v][aside], weights[v]), y[aside]) for v in (0, 1)]
    return Model(weights, marks, float(np.log(good / (1 - good))), taken)


def _scored(rows: DataFrame, weights: list[np.ndarray]) -> DataFrame:
    """(doc_id, text, meta): what each view says of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, text, meta in _views(batch, 1):
                said = [pa.array(chances(margin(x, w)).astype(float)) for x, w in zip((text, meta), shared.value, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), *said], ["doc_id", "text", "meta"])

    return rows.mapInArrow(run, "doc_id long, text double, meta double")


def score(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Rows (doc_id, score_text, score_meta, score, keep), one for each row of ``docs``.

    Empty and null texts are scored like any other by the views' empty vectors; a missing source or language
    column counts as null.  Scores are symmetric about 0.5: without labels every score is 0.5.  An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, text, meta in _views(batch, 1):
                t, m, both = shared.value.scores(text, meta)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, len(chunk)), pa.array(t), pa.array(m), pa.array(both), pa.array(both >= least)],
                    ["doc_id", "score_text", "score_meta", "score", "keep"],
                )

    return _base(docs).mapInArrow(run, "doc_id long, score_text double, score_meta double, score double, keep boolean")
