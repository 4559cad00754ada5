"""Language identification by the nearest of several TF-IDF n-gram centroids per language.

Text is reduced to lower-case letters with single blanks between; byte 2- and 3-grams are hashed into
``DIMS`` features.  A document is the vector (1 + ln tf) * idf of unit length.  Document frequencies are
counted over all training documents; the centroids come from a spherical k-means per language over a
bounded hash sample of them (``sample`` documents in all).  The nearest centroid by cosine names the
language; a document farther than its language's rejection distance is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.rows import Chunk, driver_gives_back, give_back, ragged, small_batches, text_chunks

DIMS = 8192
#: training documents that the centroids are fitted on, all languages together
SAMPLE = 4000
#: centroids per language
CENTROIDS = 4
#: languages learned at most: their centroids (128 kB each) are held by every worker
LANGUAGES = 300
UNKNOWN = "und"
#: documents whose counts are held at once (32 kB each)
ROWS = 256

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def letters(chunk: Chunk) -> np.ndarray:
    """The bytes with A-Z and the Latin-1 capitals folded, letters kept and everything else blank.

    Bytes of 128 and more belong to code points beyond ASCII; of these the Latin-1 signs, general
    punctuation and emoji are blanked too, the rest is kept: these bytes make n-grams, ``has_letters`` decides on letters.
    """
    d = chunk.data
    out = _FOLD[d]
    if len(d) > 1:
        lead, tail = d[:-1], d[1:]
        big = (lead == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)
        out[1:][big] += 0x20
        sign = (lead == 0xC2) & (tail != 0xAA) & (tail != 0xB5) & (tail != 0xBA) | (lead == 0xC3) & ((tail == 0x97) | (tail == 0xB7))
        out[:-1][sign] = 0x20
        out[1:][sign] = 0x20
        wide = (lead == 0xE2) & (tail >= 0x80) & (tail <= 0xAF) | (lead == 0xE3) & (tail == 0x80) | (lead == 0xEF) & (tail == 0xBC) | (lead == 0xF0) & (tail == 0x9F)
        for at in np.flatnonzero(wide).tolist():
            out[at : at + (4 if d[at] == 0xF0 else 3)] = 0x20
    return out


def counts(chunk: Chunk) -> np.ndarray:
    """How often each document of the chunk has each hashed n-gram: documents x DIMS."""
    rows, text = len(chunk), letters(chunk)
    out = np.zeros((rows, DIMS), np.float32)
    n = len(text)
    if n < 2:
        return out
    wide = text.astype(np.uint32)
    two = wide[:-1] | (wide[1:] << 8)
    three = two[:-1] | (wide[2:] << 16) if n > 2 else np.zeros(0, np.uint32)
    shift = np.uint32(32 - (DIMS.bit_length() - 1))
    hashed = [((g * np.uint32(0x9E3779B1) + np.uint32(k * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> shift).astype(np.int32) for k, g in ((2, two), (3, three))]
    blank2 = two == 0x2020
    hashed[0][blank2] = -1
    hashed[1][blank2[: len(three)] | blank2[1 : len(three) + 1]] = -1
    bounds = chunk.bounds
    for r in range(rows):
        a, b = int(bounds[r]), int(bounds[r + 1])
        found = np.concatenate([hashed[0][a : max(a, b - 1)], hashed[1][a : max(a, b - 2)]])
        out[r] = np.bincount(found + 1, minlength=DIMS + 1)[1:]
    return out


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def has_letters(chunk: Chunk) -> np.ndarray:
    """Whether each document of the chunk has a code point of the Unicode letter categories."""
    total = np.zeros(len(chunk.data) + 1, np.int64)
    np.cumsum(_ASCII_LETTER[chunk.data], out=total[1:])
    found = total[chunk.bounds[1:]] > total[chunk.bounds[:-1]]
    for i in np.flatnonzero(~found).tolist():
        found[i] = any(map(str.isalpha, chunk.data[chunk.bounds[i] : chunk.bounds[i + 1]].tobytes().decode("utf-8", "replace")))
    return found


def unit_vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf)
    v *= idf
    v /= np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-12)[:, None]
    return v


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for chunk in text_chunks(batch.column(0), rows=ROWS):
            total += (counts(chunk) > 0).sum(axis=0)
            n += len(chunk)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS)), pa.array(np.concatenate([[n], total]))], ["feature", "df"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in text_chunks(batch.column(1), rows=ROWS):
            tf = counts(chunk)
            rows, features = np.nonzero(tf)
            per = np.bincount(rows, minlength=len(chunk))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(chunk.first, len(chunk)), ragged(features, per, pa.int32()), ragged(tf[rows, features], per, pa.float32())],
                ["lang", "features", "tf"],
            )


def clusters(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Unit centroids of a spherical k-means, begun at rows far from each other."""
    mean = x.mean(axis=0)
    chosen = [int(np.argmax(x @ mean))]
    nearest = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    centres = x[chosen]
    for _ in range(rounds):
        member = np.argmax(x @ centres.T, axis=1)
        sums = np.array([(member == j).astype(x.dtype) @ x if (member == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


class Model:
    """idf (DIMS), unit centroids, the language of each centroid, and each language's least cosine."""

    def __init__(self, idf: np.ndarray, centres: np.ndarray, langs: list[str], least: dict[str, float]):
        self.idf, self.centres, self.langs, self.least = idf, centres, langs, least

    def predict(self, chunk: Chunk) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, confidence, nearest cosine and whether the document is accepted."""
        known = has_letters(chunk)
        if not self.langs:
            n = len(chunk)
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.zeros(n, bool)
        cos = unit_vectors(counts(chunk), self.idf) @ self.centres.T
        names = sorted(set(self.langs))
        owner = np.array(self.langs)
        per = np.stack([cos[:, owner == name].max(axis=1) for name in names], axis=1).astype(np.float64)
        best = per.argmax(axis=1)
        near = per[np.arange(len(chunk)), best]
        weight = np.exp(30 * (per - near[:, None]))
        score = np.where(known, 1 / weight.sum(axis=1), 0.0)
        lang = [names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
        accepted = known & (near >= np.array([self.least[name] for name in names])[best])
        return lang, score, np.where(known, near, 0.0), accepted


def fit(train: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, languages: int = LANGUAGES) -> Model:
    """Fit on ``train`` (doc_id, text, lang), rows with null lang left out.

    Document frequencies cover every row.  The centroids come from about ``sample`` rows, drawn evenly
    over the languages by a hash of doc_id; what reaches the driver is that sample in sparse form.
    At most ``languages`` values of lang are learned, the commonest (ties: the first by name), which bounds the model.
    The rejection threshold of a language is half the cosine that 99.5 % of its sample reaches.
    """
    small_batches(train.sparkSession)
    train = train.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not sizes:
        return Model(np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), [], {})
    df = np.zeros(DIMS + 1, np.int64)
    for r in train.select("text").mapInArrow(_frequencies, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect():
        df[r["feature"] + 1] = r["df"]
    idf = (np.log((1 + df[0]) / (1 + df[1:])) + 1).astype(np.float32)
    each = max(1, sample // len(sizes))
    share = F.create_map(*(F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, each / n))))
    drawn = F.pmod(F.xxhash64(F.lit(7), F.col("doc_id")), F.lit(1 << 20)) < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)) * (1 << 20)
    rows = train.where(drawn).select("lang", "text").mapInArrow(_sparse, "lang string, features array<int>, tf array<float>").toArrow()
    centres, langs, least = [], [], {}
    column = rows.column("lang").to_pylist()
    for name in sorted(set(column)):
        at = [i for i, x in enumerate(column) if x == name]
        tf = np.zeros((len(at), DIMS), np.float32)
        for j, i in enumerate(at):
            tf[j, rows.column("features")[i].values.to_numpy()] = rows.column("tf")[i].values.to_numpy()
        tf = tf[tf.any(axis=1)]
        if not len(tf):
            continue
        x = unit_vectors(tf, idf)
        del tf
        found = clusters(x, centroids)
        least[name] = float(0.5 * np.quantile((x @ found.T).max(axis=1), 0.005))
        centres.append(found)
        langs += [name] * len(found)
        del x
    del rows
    give_back()
    driver_gives_back(train.sparkSession)
    return Model(idf, np.concatenate(centres) if centres else np.zeros((0, DIMS), np.float32), langs, least)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, lang_pred, score, cosine, accepted), one for each row of ``docs`` (doc_id, text, ...).

    A null text or one without letters gets ``und``, score 0 and is not accepted.  Ties between languages
    go to the first by name.  Only doc_id and text are read; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred kB a language, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1), rows=ROWS):
                lang, score, cosine, accepted = shared.value.predict(chunk)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, len(chunk)), pa.array(lang, pa.string()), pa.array(score), pa.array(cosine), pa.array(accepted)],
                    ["doc_id", "lang_pred", "score", "cosine", "accepted"],
                )

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, lang_pred string, score double, cosine double, accepted boolean")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder ``fold``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def accepted_rows(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text the model accepts, all columns kept.

    Null texts, texts without a letter and all texts under a model without languages are not accepted; repeated rows are each
    kept or each dropped.  An empty table gives an empty result with the same columns.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [shared.value.predict(chunk)[3] for chunk in text_chunks(batch.column(at), rows=ROWS)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
