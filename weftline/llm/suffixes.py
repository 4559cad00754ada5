"""Repeated passages by sparse suffix arrays.

Only suffixes that begin at minimiser positions are kept: a word position is a minimiser when the hash of
its ``SEED`` next words is the least of some ``SPAN`` consecutive ones.  Equal passages choose equal positions,
and any passage of SPAN + SEED - 1 words holds at least one.  A suffix is represented by the hashes of
its next four blocks of ``BLOCK`` words, which order suffixes as a suffix array over blocks does (beyond 64 words by document;
what is found does not depend on that order, see below).  Suffixes
are range-partitioned and sorted by these blocks; neighbours with an equal first block are compared on the
documents' words and extended to the left and right as far as they agree.  Matches of ``min_words`` words count.

A neighbour in suffix order has the longest common continuation, but another suffix may agree further to the
left.  So the windows of ``min_words`` words around all suffixes that share their first block are grouped by
hash, except those inside a match whose other side comes first: these are settled, and a window's first
occurrence is never among them.  Any passage that occurs twice is found, and told from its first occurrence.

A range partition may end inside a group of equal suffixes, so a group of any size is dealt over tasks; the
first and last row of each partition are compared afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.rows import (
    U64,
    chars_before,
    mix,
    of_ids,
    small_batches,
    span_hashes,
    steady,
    text_chunks,
    windows,
    word_hashes,
    words,
)

MIN_WORDS = 50
SEED, SPAN, BLOCK = 8, 32, 16


def minimisers(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Positions of the minimisers of each document among concatenated word hashes.

    Of a run of minimisers with one hash (a text that repeats itself) the first and the last stay.
    """
    seeds = windows(hashes, SEED)
    n = len(seeds) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = seeds
    for step in (1, 2, 4, 8, 16):
        least = np.minimum(least[:-step], least[step:])
    doc_end = np.repeat(firsts[1:], np.diff(firsts))[:n]
    least = np.where(np.arange(n) + SPAN + SEED - 1 <= doc_end, least, U64(0))  # a window inside one document
    most = np.concatenate([np.zeros(SPAN - 1, U64), least, np.zeros(SPAN - 1, U64)])
    for step in (1, 2, 4, 8, 16):
        most = np.maximum(most[:-step], most[step:])
    at = np.flatnonzero((seeds == most[: len(seeds)]) & (most[: len(seeds)] > 0))
    if len(at) > 2:
        near = (seeds[at[1:]] == seeds[at[:-1]]) & (np.diff(at) <= SPAN)
        at = at[~np.concatenate([[False], near[:-1] & near[1:], [False]])]
    return at


def _suffixes(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                starts, ends, firsts = words(chunk)
                hashes = word_hashes(chunk, starts, ends)
                at = minimisers(hashes, firsts)
                doc = np.searchsorted(firsts, at, "right") - 1
                size = np.diff(firsts)[doc]
                ok = (size >= min_words) & (at + BLOCK <= firsts[doc + 1])
                at, doc = at[ok], doc[ok]
                limit = firsts[doc + 1]
                blocks = [span_hashes(hashes, np.minimum(at + BLOCK * i, limit), np.minimum(at + BLOCK * (i + 1), limit)).view(np.int64) for i in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(b) for b in blocks), batch.column(0).take(pa.array(doc + chunk.first)), pa.array((at - firsts[doc]).astype(np.int32))],
                    ["b0", "b1", "b2", "b3", "doc_id", "pos"],
                )

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes to pairs of neighbours with an equal first block, and the partition's first and last row."""
    part = TaskContext.get().partitionId()
    last = None
    names = ["part", "edge", "b0", "x", "x_pos", "y", "y_pos"]

    def out(edge, b0, x, x_pos, y, y_pos) -> pa.RecordBatch:
        n = len(b0)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, edge, np.int32)), *(pa.array(v) for v in (b0, x, x_pos, y, y_pos))], names
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        b0, doc, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 4, 5))
        if last is None:
            yield out(0, b0[:1], doc[:1], pos[:1], doc[:1], pos[:1])
        else:
            b0, doc, pos = (np.concatenate([a, b]) for a, b in zip(last, (b0, doc, pos), strict=True))
        i = np.flatnonzero(b0[1:] == b0[:-1])
        if len(i):
            yield out(-1, b0[i], doc[i], pos[i], doc[i + 1], pos[i + 1])
        last = b0[-1:], doc[-1:], pos[-1:]
    if last is not None:
        yield out(1, last[0], last[1], last[2], last[1], last[2])


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as arrays of 32-bit word hashes."""
    for batch in batches:
        for chunk in text_chunks(batch.column(1)):
            starts, ends, firsts = words(chunk)
            hashes = (word_hashes(chunk, starts, ends) >> U64(32)).astype(np.uint32)
            rows = pa.array([hashes[a:b].tobytes() for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), rows], ["doc_id", "words"])


def common_runs(x: np.ndarray, y: np.ndarray, anchors: list[tuple[int, int]], least: int, same: bool) -> list[tuple[int, int, int]]:
    """Maximal runs (start in x, start in y, length) of ``least`` equal words through the anchors (position in x, in y).

    In one document (``same``) the two sides may not overlap.
    """
    out = []
    by: dict[int, list[int]] = {}
    for a, b in anchors:
        by.setdefault(b - a, []).append(a)
    for shift, at in by.items():
        a, b = max(0, -shift), min(len(x), len(y) - shift)
        if b - a < least:
            continue
        equal = np.zeros(b - a + 2, bool)
        equal[1:-1] = x[a:b] == y[a + shift : b + shift]
        edges = np.flatnonzero(equal[1:] != equal[:-1])
        froms, tos = edges[::2], edges[1::2]
        run = np.unique(np.searchsorted(froms, np.array(at) - a, "right") - 1)
        for r in run[run >= 0].tolist():
            n = int(tos[r] - froms[r])
            if same:
                n = min(n, abs(shift))
            if n >= least:
                out.append((int(froms[r]) + a, int(froms[r]) + a + shift, n))
    return out


def _windows_around(min_words: int):
    """(doc_id, positions, matches, words) to the hashes of the windows that hold a suffix's first block and lie
    in no match whose other side comes first; ``known`` are those inside another match."""

    def covered(spans: list[dict], n: int) -> np.ndarray:
        mark = np.zeros(n + 1, np.int64)
        for s in spans:
            mark[s["a"]] += 1
            mark[s["b"] - min_words + 1] -= 1
        return np.cumsum(mark)[:n] > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, starts, counts, inside = [], [], [], []
            for i in range(batch.num_rows):
                at, spans = np.array(batch.column(1)[i].as_py(), np.int64), batch.column(2)[i].as_py() or []
                own = np.frombuffer(batch.column(3)[i].as_py(), np.uint32).astype(U64)
                n = max(0, len(own) - min_words + 1)
                mark = np.zeros(len(own) + 1, np.int64)
                np.add.at(mark, np.maximum(0, at - SPAN + 1), 1)
                np.add.at(mark, at + 1, -1)
                start = np.flatnonzero((np.cumsum(mark)[:n] > 0) & ~covered([s for s in spans if s["again"]], n))
                hashes.append(span_hashes(mix(own), start, start + min_words))
                starts.append(start)
                counts.append(len(start))
                inside.append(covered(spans, n)[start])
            if counts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(hashes).view(np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts))), pa.array(np.concatenate(starts).astype(np.int32)),
                     pa.array(np.concatenate(inside))],
                    ["h", "doc_id", "a", "known"],
                )

    return run


def _extend(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, bool]] = []
            for i in range(batch.num_rows):
                x, y, xs, ys, xw, yw = (batch.column(j)[i].as_py() for j in range(6))
                found = common_runs(np.frombuffer(xw, np.uint32), np.frombuffer(yw, np.uint32), list(zip(xs, ys, strict=True)), min_words, x == y)
                for a, b, n in found:
                    first = (x, a) < (y, b)
                    out.append((x, a, a + n, not first))
                    out.append((y, b, b + n, first))
            doc, a, b, again = zip(*sorted(set(out)), strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(again, pa.bool_())], ["doc_id", "a", "b", "again"])

    return run


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (doc_id, a, b, again): word spans that occur elsewhere too, at least ``min_words`` long.

    ``again`` says that the other occurrence comes first by (doc_id, position).  Words are compared with A-Z
    lower-cased, runs of white space do not matter.  Occurrences within one text count where they do not overlap.  Null ids
    and texts and shorter texts have none; of rows that repeat a doc_id the largest text is read.  Only doc_id and text are
    read; an empty table gives an empty result.
    """
    _check(min_words)
    return _repeats(_base(docs), min_words)


def _check(min_words: int) -> None:
    if min_words < SPAN + BLOCK:
        raise ValueError(f"passages of {SPAN + BLOCK} words and more are found")


def _base(docs: DataFrame) -> DataFrame:
    """(doc_id, text) without nulls; of rows that repeat a doc_id the largest text."""
    small_batches(docs.sparkSession)
    base = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    twice = steady(base.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if twice.isEmpty():  # so that texts need no shuffle by id
        return base
    return base.join(twice, "doc_id", "left_anti").unionAll(of_ids(base, twice, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text")))


def _repeats(base: DataFrame, min_words: int) -> DataFrame:
    kind = "b0 long, b1 long, b2 long, b3 long, doc_id long, pos int"
    suffixes = base.mapInArrow(_suffixes(min_words), kind)
    twice = suffixes.groupBy("b0").count().where("count > 1").select("b0")
    shared = suffixes.join(twice, "b0", "left_semi")
    order = ["b0", "b1", "b2", "b3", "doc_id", "pos"]
    shared = steady(shared.select(*order))
    pairs = steady(
        shared.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, "part int, edge int, b0 long, x long, x_pos int, y long, y_pos int")
    )
    # two rows for each partition: a window over them is small whatever the input
    line = Window.orderBy("part", "edge")
    border = pairs.where("edge >= 0").select(
        "edge", "b0", "y", "y_pos", F.lag("b0").over(line).alias("c0"), F.lag("x").over(line).alias("x"), F.lag("x_pos").over(line).alias("x_pos"))
    border = border.where("edge = 0 and b0 = c0").select("x", "x_pos", "y", "y_pos")
    pairs = pairs.where("edge < 0").select("x", "x_pos", "y", "y_pos").unionAll(border)
    swap = F.col("x") > F.col("y")
    pairs = pairs.select(
        F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"),
        F.when(swap, F.col("y_pos")).otherwise(F.col("x_pos")).alias("x_pos"), F.when(swap, F.col("x_pos")).otherwise(F.col("y_pos")).alias("y_pos"))
    grouped = pairs.groupBy("x", "y").agg(F.sort_array(F.collect_list(F.struct("x_pos", "y_pos"))).alias("at"))
    grouped = steady(grouped.select("x", "y", F.col("at.x_pos").alias("xs"), F.col("at.y_pos").alias("ys")))
    asked = steady(grouped.select(F.col("x").alias("doc_id")).unionAll(grouped.select("y")).distinct())
    texts = steady(of_ids(base, asked, "doc_id").mapInArrow(_word_rows, "doc_id long, words binary"))
    sides = [texts.select(F.col("doc_id").alias(c), F.col("words").alias(c + "w")) for c in "xy"]
    spans = "doc_id long, a int, b int, again boolean"

    both = grouped.join(sides[0], "x").join(sides[1], "y").select("x", "y", "xs", "ys", "xw", "yw")
    matched = steady(both.mapInArrow(_extend(min_words), spans).distinct())

    covered = matched.groupBy("doc_id").agg(F.collect_set(F.struct("a", "b", "again")).alias("spans"))
    around = shared.groupBy("doc_id").agg(F.collect_set("pos").alias("at")).join(covered, "doc_id", "left")
    looked = around.join(texts, "doc_id").select("doc_id", "at", "spans", "words").mapInArrow(_windows_around(min_words), "h long, doc_id long, a int, known boolean")
    # the largest position of a text that repeats itself must lie clear of the first, as in matches
    twice = looked.groupBy("h").agg(F.min(F.struct("doc_id", "a")).alias("f"), F.max(F.struct("doc_id", "a")).alias("l"))
    twice = twice.where(f"f.doc_id < l.doc_id or f.a + {min_words} <= l.a").drop("l")
    # in one job, so that what lies under both sides is shuffled once; a hot window is left to the adaptive skew join
    more = looked.join(twice, "h").select("doc_id", "a", (F.col("a") + min_words).alias("b"), F.expr(f"f.doc_id < doc_id or f.a + {min_words} <= a").alias("again"), "known")
    return matched.unionAll(more.where("again or not known").drop("known"))


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) to character spans."""
    kind = pa.list_(pa.struct([("at", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        spans = batch.column(2).to_pylist()
        for chunk in text_chunks(batch.column(1)):
            starts, ends, firsts = words(chunk)
            chars = chars_before(chunk)
            rows = []
            for i in range(len(chunk)):
                zero = chars[chunk.bounds[i]]
                cut = [[(s["a"], s["b"]) for s in spans[chunk.first + i] if s["again"] or not removed] for removed in (False, True)]
                rows.append([[{"at": int(chars[starts[firsts[i] + a]] - zero), "end": int(chars[ends[firsts[i] + b - 1]] - zero)} for a, b in _joined(c)] for c in cut])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(chunk.first, len(chunk)), pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], kind)], ["doc_id", "repeated", "removed"]
            )


def passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (doc_id, repeated, removed), one for each document with a repeated passage.

    Both are merged character spans [at, end): the passages that occur elsewhere, and those of them with an
    earlier occurrence, which deduplication removes.  Nulls, short texts, repeated rows and empty tables as in ``repeats``.
    """
    _check(min_words)
    base = _base(docs)
    spans = _repeats(base, min_words).groupBy("doc_id").agg(F.collect_set(F.struct("a", "b", "again")).alias("spans"))
    spans = steady(spans)
    own = of_ids(base, steady(spans.select("doc_id")), "doc_id").join(spans, "doc_id").select("doc_id", "text", "spans")
    struct = "array<struct<at: long, end: long>>"
    return own.mapInArrow(_offsets, f"doc_id long, repeated {struct}, removed {struct}")
