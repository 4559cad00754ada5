"""Near-duplicate classes by HyperMinHash signatures, banding and exact confirmation.

A document's set holds its distinct word shingles.  For each of ``bands * rows`` hash functions the
smallest value over the set is kept as a 16-bit register: the number of leading zeros (6 bits) and the
10 bits after the first one (the mantissa).  Every register sees the whole set (k minima rather than one
pass split over buckets), so a text of seven words fills all registers as a long one does.

Documents whose sets are equal collapse to one representative first.  Representatives that agree on all
registers of a band meet in a bucket; each is compared with the bucket's smallest id first.  The number of
equal registers gives a Jaccard estimate corrected for chance collisions; pairs far below the
threshold go, the others are confirmed on the full sets.  Buckets that then still hold several components
are compared block by block over all pairs of different components, so a pair that shares any bucket is
never lost.

At a Jaccard similarity of exactly 0.85 the 25 bands of 5 registers miss a pair with probability
(1 - 0.85^5)^25 < 5e-7; the estimate, 5 standard deviations below the threshold, adds about 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.graph import components, joined
from weftline.llm.rows import (
    U64,
    blobs,
    dealt_join,
    give_back,
    mix,
    of_ids,
    shingle_sets,
    small_batches,
    steady,
    stream,
    text_chunks,
    word_hashes,
    words,
)

BANDS, ROWS = 25, 5
MANTISSA = 10
_SLICE = 1024
_MUL = stream(101, 512) | U64(1)
_ADD = stream(202, 512)
_BAND = stream(303, 512) | U64(1)


def registers(minima: np.ndarray) -> np.ndarray:
    """Leading-zero count and mantissa bits of 64-bit minima as uint16 registers."""
    zeros = np.zeros(minima.shape, np.int64)
    rest = minima.copy()
    for step in (32, 16, 8, 4, 2, 1):
        low = rest < (U64(1) << U64(64 - step))
        zeros[low] += step
        rest[low] <<= U64(step)
    mantissa = (rest << U64(1)) >> U64(64 - MANTISSA)
    return ((zeros.astype(np.uint16) << MANTISSA) | mantissa.astype(np.uint16)).astype(np.uint16)


def minima_of(shingles: np.ndarray, k: int) -> np.ndarray:
    """The smallest value of each of ``k`` hash functions over a non-empty set."""
    best = np.full(k, np.iinfo(np.uint64).max, U64)
    for a in range(0, len(shingles), _SLICE):
        part = shingles[a : a + _SLICE, None] * _MUL[None, :k]
        part += _ADD[None, :k]
        np.minimum(best, part.min(axis=0), out=best)
    return best


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of disjoint sets of sizes n and m agree.

    The minima are nearly exponential with rates n and m; within a power of two a register cell has the
    width 2^-MANTISSA of that power, 1 / (2 ln 2) of the value on average.
    """
    n, m = n.astype(float), m.astype(float)
    return np.minimum(0.5, n * m / (n + m) ** 2 / (2 * np.log(2)) * 2.0**-MANTISSA)


def jaccard_estimate(equal: np.ndarray, k: int, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the count of equal registers, corrected for chance collisions."""
    c = chance(n, m)
    return np.clip((equal / k - c) / (1 - c), 0, 1)


def _signatures(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                starts, ends, firsts = words(chunk)
                sizes, sums, minima = [], [], []
                for s in shingle_sets(word_hashes(chunk, starts, ends), firsts, width):
                    sizes.append(len(s))
                    sums.append((mix(s).sum(dtype=U64), mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)))
                    minima.append(minima_of(s, k) if len(s) else np.zeros(k, U64))
                found = registers(np.array(minima, U64))
                d = np.array(sums, U64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, len(chunk)), pa.array(sizes, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), blobs(list(found))],
                    ["doc_id", "n_shingles", "d1", "d2", "sig"],
                )

    return run


def _bands(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, bands, rows)
            keys = np.broadcast_to(_BAND[:bands], (batch.num_rows, bands)).copy()
            for r in range(rows):
                keys = mix(keys + sig[:, :, r].astype(U64) * _MUL[r])
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            nth = np.tile(np.arange(bands, dtype=np.int16), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids, bands)), pa.array(nth)], ["band", "id", "nth"])

    return run


def _estimate(k: int, least: float):
    """(u, v, su, sv, nu, nv) to the pairs (u, v) whose estimate reaches ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, k) for i in (2, 3))
            n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
            near = jaccard_estimate((a == b).sum(axis=1), k, n, m) >= least
            yield batch.select([0, 1]).filter(pa.array(near))

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                starts, ends, firsts = words(chunk)
                found = list(shingle_sets(word_hashes(chunk, starts, ends), firsts, width))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), blobs(found)], ["id", "shingles"])

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a & b| >= percent * |a | b| for two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(percent: int):
    """(u, v, set u, set v) to the pairs that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [
                linked(np.frombuffer(a, U64), np.frombuffer(b, U64), percent)
                for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))
            give_back()

    return run


def _cross(k: int, rows: int, least: float, percent: int):
    """Links between two blocks of one bucket that join different components, confirmed on the full sets.

    Within the two blocks, components that a link has joined are not compared again, so what comes out is
    at most a link for each row.  A pair that shares an earlier bucket too is left to that one.
    """

    def side(row: dict, p: str) -> tuple:
        sigs = np.frombuffer(b"".join(row[f"{p}_sigs"]), np.uint16).reshape(-1, k)
        return np.array(row[f"{p}_ids"]), row[f"{p}_roots"], sigs, np.array(row[f"{p}_sizes"]), row[f"{p}_sets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                (xi, xr, xs, xn, xt), (yi, yr, ys, yn, yt) = side(row, "x"), side(row, "y")
                over: dict[int, int] = {}

                def top(r: int, over: dict[int, int] = over) -> int:
                    while (s := over.get(r, r)) != r:
                        r = s
                    return r

                codes = {r: i for i, r in enumerate(dict.fromkeys([*xr, *yr]))}
                yc = np.array([codes[r] for r in yr])
                same = row["x_block"] == row["y_block"]
                for i in range(len(xi)):
                    other = np.flatnonzero((yc != codes[xr[i]]) & ((yi < xi[i]) | (not same)))
                    if not len(other):
                        continue
                    equal = ys[other] == xs[i]
                    estimate = jaccard_estimate(equal.sum(axis=1), k, yn[other], np.full(len(other), xn[i]))
                    shared = equal.reshape(len(other), -1, rows).all(axis=2)
                    shared[:, int(row["nth"])] = True
                    mine = (shared.argmax(axis=1) == row["nth"]) & (estimate >= least)
                    a = np.frombuffer(xt[i], U64)
                    for j in other[mine][np.argsort(-estimate[mine], kind="stable")].tolist():
                        p, q = top(xr[i]), top(yr[j])
                        if p != q and linked(a, np.frombuffer(yt[j], U64), percent):
                            over[max(p, q)] = min(p, q)
                            us.append(max(xi[i], yi[j]))
                            vs.append(min(xi[i], yi[j]))
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
            give_back()

    return run


def near_duplicates(
    docs: DataFrame, percent: int = 85, width: int = 5, bands: int = BANDS, rows: int = ROWS, block: int = 256
) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of ``docs`` (doc_id, text, ...).

    Two documents are linked when 100 * intersection >= ``percent`` * union of their shingle sets;
    ``component_id`` is the smallest doc_id reachable over links, ``kept`` says that it is the own one.

    Null or wordless text: an empty set (n_shingles 0), linked with nothing.  Null doc_id: linked with
    nothing, component_id null, kept.  Repeated rows come back repeated; two texts under one doc_id tie
    their components together.  Columns other than doc_id and text are not looked at.
    An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    k = bands * rows
    least = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / k) ** 0.5
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "doc_id long, n_shingles long, d1 long, d2 long, sig binary"
    signed = steady(base.mapInArrow(_signatures(k, width), kind))
    whole = signed.where("n_shingles > 0 and doc_id is not null")
    reps = whole.groupBy("n_shingles", "d1", "d2").agg(F.min(F.struct("doc_id", "sig")).alias("r"))
    reps = steady(reps.select(F.col("r.doc_id").alias("id"), "n_shingles", "d1", "d2", F.col("r.sig").alias("sig")))
    signs = reps.select("id", "sig", "n_shingles")

    bucketed = reps.select("id", "sig").mapInArrow(_bands(bands, rows), "band long, id long, nth short")
    least_id = steady(bucketed.groupBy("band").agg(F.min("id").alias("m"), F.count("*").alias("n")).where("n > 1"))
    members = steady(dealt_join(bucketed, least_id, ["band"], "id", hubs=least_id))
    stars = steady(members.where("id > m").select(F.col("id").alias("u"), F.col("m").alias("v")).distinct())

    def near(pairs: DataFrame) -> DataFrame:
        sides = [signs.select(F.col("id").alias(c), F.col("sig").alias("s" + c), F.col("n_shingles").alias("n" + c)) for c in "uv"]
        both = dealt_join(pairs.join(sides[0], "u"), sides[1], ["v"], "u", hubs=pairs.groupBy("v").agg(F.count("*").alias("n"))).select("u", "v", "su", "sv", "nu", "nv")
        return both.mapInArrow(_estimate(k, least), "u long, v long")

    def sets_of(ids: DataFrame) -> DataFrame:
        return of_ids(base, steady(ids.distinct()), "doc_id").mapInArrow(_sets(width), "id long, shingles binary")

    def confirmed(pairs: DataFrame) -> DataFrame:
        sets = steady(sets_of(pairs.select(F.col("u").alias("doc_id")).unionAll(pairs.select("v"))))
        sides = [sets.select(F.col("id").alias(c), F.col("shingles").alias("s" + c)) for c in "uv"]
        both = dealt_join(pairs.join(sides[0], "u"), sides[1], ["v"], "u", hubs=pairs.groupBy("v").agg(F.count("*").alias("n"))).select("u", "v", "su", "sv")
        return both.mapInArrow(_confirm(percent), "u long, v long")

    links = steady(confirmed(steady(near(stars))))
    roots = components(links)

    # pairs with the bucket's smallest id have been compared: what is left are pairs of the others
    placed = members.where("id > m").join(roots, members["id"] == roots["node"], "left")
    placed = steady(placed.select("band", "nth", "id", F.coalesce("root", "id").alias("root")))
    spread = placed.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n")).where("a < b")
    spread = steady(spread)
    mixed = steady(dealt_join(placed, spread, ["band"], "id", hubs=spread).join(signs, "id"))
    sets = sets_of(mixed.select(F.col("id").alias("doc_id")))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / (4096 * block)))
    bulk = mixed.groupBy("band").agg(F.sum(F.col("n_shingles") * 8).alias("bytes"))
    packed = (
        dealt_join(mixed, bulk, ["band"], "id", hubs=spread)
        .join(sets, "id")
        .withColumn("rest", F.col("root") > F.col("a"))
        .groupBy("band", "nth", "rest", F.pmod(F.xxhash64("id"), blocks).alias("block"))
        .agg(*(F.collect_list(a).alias(b) for a, b in (("id", "ids"), ("root", "roots"), ("sig", "sigs"), ("n_shingles", "sizes"), ("shingles", "sets"))))
    )
    packed = steady(packed.withColumn("block", F.col("block") + F.when(F.col("rest"), 1 << 40).otherwise(0)))
    sides = [packed.select("band", "nth", *(F.col(c).alias(f"{p}_{c}") for c in ("rest", "block", "ids", "roots", "sigs", "sizes", "sets"))) for p in ("x", "y")]
    facing = dealt_join(sides[0], sides[1], ["band", "nth"], "x_block", hot=4).where("x_rest and (not y_rest or x_block <= y_block)")
    more = steady(facing.mapInArrow(_cross(k, rows, least, percent), "u long, v long"))
    if not more.isEmpty():
        roots = joined(roots, more)

    classes = reps.join(roots, reps["id"] == roots["node"], "left").select("n_shingles", "d1", "d2", F.coalesce("root", "id").alias("root"))
    placed = dealt_join(signed.drop("sig"), classes, ["n_shingles", "d1", "d2"], "doc_id", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return placed.select("doc_id", "n_shingles", own.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
