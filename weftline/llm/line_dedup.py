"""Removal of repeated lines and sentences by global grouping of unit digests.

Units are lines and the sentences within them (a sentence ends at ``.``, ``!`` or ``?`` before white space).  A unit is normalised to its words with A-Z lower-cased, so case and
spacing do not matter, and counts when it has at least ``min_words`` words.  The occurrence that ranks first
by (doc_id, position) stays; every other one is cut, and the surviving text keeps its original offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.rows import U64, Chunk, chars_before, dealt_join, mix, small_batches, span_hashes, steady, text_chunks, word_hashes, words

MIN_LINE_WORDS = 5
MIN_SENTENCE_WORDS = 10
_UNIT = "d1 long, d2 long, doc_id long, at long, end long"


def _units(least_line: int, least_sentence: int):
    def of(chunk: Chunk) -> tuple[np.ndarray, ...]:
        """Two digests, document and character span of every unit that counts."""
        data, n = chunk.data, len(chunk.data)
        starts, ends, _ = words(chunk)
        hashes = word_hashes(chunk, starts, ends)
        if not len(starts):
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        chars = chars_before(chunk)
        breaks = np.flatnonzero(data == 0x0A)
        lines = np.unique(np.concatenate([chunk.bounds[:-1], breaks + 1]))
        lines = lines[lines < n]
        stop = np.isin(data[ends - 1], np.frombuffer(b".!?", np.uint8))
        follow = starts[1:][stop[:-1]]  # a word after one that ends a sentence
        out = []
        for firsts, least in ((lines, least_line), (np.union1d(lines, follow), least_sentence)):
            a = np.searchsorted(starts, firsts)
            b = np.append(a[1:], len(starts))
            ok = b - a >= least
            a, b, at = a[ok], b[ok], firsts[ok]
            key = span_hashes(hashes, a, b)
            row = np.searchsorted(chunk.bounds, at, "right") - 1
            end = ends[b - 1]
            origin = chars[chunk.bounds[row]]
            begin = starts[a]
            out.append((key, span_hashes(mix(hashes + U64(77)), a, b), row, chars[begin] - origin, chars[end] - origin))
        spans = [(row << 40) + at for _, _, row, at, _ in out], [(row << 40) + end for _, _, row, _, end in out]
        whole = np.isin(spans[0][1], spans[0][0]) & np.isin(spans[1][1], spans[1][0])
        out[1] = tuple(x[~whole] for x in out[1])  # a sentence that is its line is that line
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for chunk in text_chunks(batch.column(1)):
                d1, d2, row, at, end = of(chunk)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), ids.take(pa.array(row + chunk.first)), pa.array(at), pa.array(end)],
                    ["d1", "d2", "doc_id", "at", "end"],
                )

    return run


def repeated_units(docs: DataFrame, min_line_words: int = MIN_LINE_WORDS, min_sentence_words: int = MIN_SENTENCE_WORDS) -> DataFrame:
    """Rows (doc_id, at, end, first_doc, first_at): units to remove, in code points, and their first occurrence.

    Null or wordless texts have no units.  Rows with a null doc_id neither remove nor lose anything.
    Of rows that repeat a doc_id, equal positions count as one occurrence.
    """
    small_batches(docs.sparkSession)
    base = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    units = base.mapInArrow(_units(min_line_words, min_sentence_words), _UNIT)
    first = units.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "at")).alias("f"), F.max(F.struct("doc_id", "at")).alias("l"), F.count("*").alias("n"))
    first = steady(first.where("f < l").select("d1", "d2", "f", "n"))
    again = dealt_join(units, first.drop("n"), ["d1", "d2"], "doc_id", hubs=first).where("struct(doc_id, at) > f")
    found = again.select("doc_id", "at", "end", F.col("f.doc_id").alias("first_doc"), F.col("f.at").alias("first_at"))
    return found


def _cut(ids_at: int, text_at: int, cuts_at: int):
    """Replace the text by what remains of it; drop the column of cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            for i, cuts in enumerate(batch.column(cuts_at).to_pylist()):
                if cuts and texts[i] is not None:
                    texts[i] = without(texts[i], [(c["at"], c["end"]) for c in cuts])[0]
            columns = [pa.array(texts, batch.schema.types[text_at]) if j == text_at else batch.column(j) for j in range(batch.num_columns) if j != cuts_at]
            yield pa.RecordBatch.from_arrays(columns, [x for j, x in enumerate(batch.schema.names) if j != cuts_at])

    return run


def merged(cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint spans that cover the same positions."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(cuts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def without(text: str, cuts: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the spans, and the original span of each piece that is left.

    A piece of white space only goes too, unless nothing was cut.
    """
    pieces, at = [], 0
    for a, b in [*merged(cuts), (len(text), len(text))]:
        if text[at:a].strip():
            pieces.append((at, a))
        at = max(at, b)
    return "".join(text[a:b] for a, b in pieces), pieces


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [merged([(c["at"], c["end"]) for c in cuts or ()]) for cuts in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x or ()) for x in batch.column(1).to_pylist()], pa.int64()), pa.array([sum(b - a for a, b in r) for r in rows], pa.int64()),
             pa.array([[{"at": a, "end": b} for a, b in r] for r in rows], pa.list_(pa.struct([("at", pa.int64()), ("end", pa.int64())])))],
            ["doc_id", "n_units", "removed_chars", "removed"],
        )


def removals(units: DataFrame) -> DataFrame:
    """Rows (doc_id, n_units, removed_chars, removed): per document with repeats the spans that go, merged."""
    grouped = units.select("doc_id", "at", "end").distinct().groupBy("doc_id").agg(F.collect_list(F.struct("at", "end")).alias("cuts"))
    return grouped.mapInArrow(_report, "doc_id long, n_units long, removed_chars long, removed array<struct<at: long, end: long>>")


def remove_repeats(docs: DataFrame, units: DataFrame) -> DataFrame:
    """``docs`` with the repeated units cut from their texts; all columns and rows stay.

    A text that consists of repeats only becomes empty.  Null texts and ids pass through.
    """
    small_batches(docs.sparkSession)
    cuts = units.select("doc_id", "at", "end").distinct().groupBy("doc_id").agg(F.collect_list(F.struct("at", "end")).alias("cuts"))
    cuts = cuts.select(F.col("doc_id").alias("_cut_id"), F.col("cuts").alias("_cuts"))
    both = docs.join(cuts, docs["doc_id"] == cuts["_cut_id"], "left").drop("_cut_id")
    names = docs.columns
    return both.mapInArrow(_cut(names.index("doc_id"), names.index("text"), len(names)), docs.schema)
