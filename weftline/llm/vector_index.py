"""Approximate nearest neighbours: inverted lists of coarse centroids, product-quantised residuals, exact reranking.

Coarse centroids and the sub-quantisers of the residuals are fitted on a bounded hash sample; every vector is
then indexed as (list, 16 code bytes, one correction term).  A query probes the nearest lists; the asymmetric
distance of a member is  |q - c|^2 + (|r|^2 + 2 c.r) - 2 q.r  with r the decoded residual: the first part
is one number for each list, the second is stored with the member, the third a sum of looked-up table entries.
The best ``rerank`` members by that distance are measured exactly on the original vectors.

How many lists a query probes is measured, not set: on the sample, the number of nearest lists that hold the share ``RECALL`` of
the true neighbours of sample vectors.  Vectors with clusters need few, vectors without any need most of them.  The neighbours of
a sample lie further away than those among all vectors, so the number errs to the safe side.  A query probes further lists
where those hold fewer than ``rerank`` members, so that a small table is searched in full.

Lists are dealt into groups of about ``BLOCK`` members; a group that holds more (a hot list) is split by
a hash of the id.  Queries meet blocks of members, not members, in the join, so no key gathers unbounded rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.rows import ragged, steady

#: vectors that the quantisers are fitted on
SAMPLE = 20_000
BLOCK = 8192
QUERY_BLOCK = 128
SUBSPACES = 16
#: share of the true neighbours that the probed lists should hold, sample vectors that it is measured on, and candidates
#: measured exactly for each query
RECALL, PROBE_QUERIES = 0.97, 512
RERANK = 256


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T, axis=1)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's iteration from distinct random rows; an empty cluster keeps its centre."""
    distinct = np.unique(x, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]].astype(np.float64)
    for _ in range(rounds):
        member = nearest(x, centres)
        order = np.argsort(member, kind="stable")
        found, starts = np.unique(member[order], return_index=True)
        centres[found] = np.add.reduceat(x[order], starts, axis=0) / np.diff(np.append(starts, len(x)))[:, None]
    return centres


class Quantiser:
    """Coarse centroids (lists x dim) and residual codebooks (one of up to 256 entries for each slice of dims)."""

    def __init__(self, x: np.ndarray, lists: int):
        self.coarse = kmeans(x, lists)
        rest = x - self.coarse[nearest(x, self.coarse)]
        self.slices = np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1]))
        self.books = [kmeans(rest[:, s], 256, 8) for s in self.slices]

    def probes(self, x: np.ndarray, k: int, recall: float) -> int:
        """The nearest lists of a vector that hold ``recall`` of its ``k`` neighbours, measured on the first rows of the sample."""
        if len(x) < 2:
            return 1
        at, ranks = nearest(x, self.coarse), []
        for q in range(min(PROBE_QUERIES, len(x))):
            far = ((x - x[q]) ** 2).sum(axis=1)
            far[q] = np.inf
            own = at[np.argsort(far, kind="stable")[: min(k, len(x) - 1)]]
            place = np.empty(len(self.coarse), np.int64)
            place[np.argsort(((self.coarse - x[q]) ** 2).sum(axis=1), kind="stable")] = np.arange(len(self.coarse))
            ranks.append(place[own])
        return 1 + int(np.quantile(np.concatenate(ranks), recall, method="higher"))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and correction term of each vector."""
        at = nearest(x, self.coarse)
        rest = x - self.coarse[at]
        codes = np.stack([nearest(rest[:, s], b) for s, b in zip(self.slices, self.books, strict=True)], axis=1).astype(np.uint8)
        near = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)
        return at, codes, (near**2).sum(axis=1) + 2 * (self.coarse[at] * near).sum(axis=1)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """Dot products of a query's slices with the codebook entries."""
        return [b @ q[s] for s, b in zip(self.slices, self.books, strict=True)]


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def search(vectors: DataFrame, queries: Column, k: int = 10, recall: float = RECALL, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` nearest found for each row that ``queries`` holds for.

    ``vectors`` has vec_id and embedding.  At most 1,024 lists are fitted, on about ``sample`` vectors.  Score is the Euclidean distance in double precision on the original
    vectors; ties go to the smaller vec_id; a query is not its own neighbour.  Vectors that are null, empty, zero or
    hold a null or non-finite component take no part, nor those of another than the most common length (the
    larger one on a tie), nor null ids.  Of rows that repeat a vec_id the smallest vector counts.
    Empty tables and tables without queries give an empty result.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    base = base.where("vec_id is not null").where(usable(F.col("v")))
    base = steady(base.groupBy("vec_id").agg(F.min("v").alias("v")))
    lengths = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = lengths["n"], lengths["count"]
    base = base.where(F.size("v") == dim)
    drawn = base.where(F.pmod(F.xxhash64(F.lit(9), "vec_id"), F.lit(1 << 20)) <= min(1.0, sample / n) * (1 << 20))
    found = drawn.select("vec_id", "v").toArrow().sort_by("vec_id").column("v").combine_chunks()
    fitted = _matrix(found, dim)
    quantiser = Quantiser(fitted, max(1, min(1024, round(n**0.5))))
    probed = quantiser.probes(fitted[np.random.default_rng(3).permutation(len(fitted))], k, recall)
    shared = spark.sparkContext.broadcast(quantiser)  # at most 1024 x dim + 256 x dim numbers
    lists = len(quantiser.coarse)
    groups = max(1, -(-n // BLOCK))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, codes, term = shared.value.encode(_matrix(batch.column(1), dim))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at % groups), batch.column(0), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(term)],
                    ["grp", "vec_id", "list", "codes", "term"],
                )

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and group of lists that it probes."""
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column(1), dim)
            coarse = shared.value.coarse
            far = (q**2).sum(axis=1)[:, None] + (coarse**2).sum(axis=1)[None, :] - 2 * q @ coarse.T
            order = np.argsort(far, axis=1, kind="stable")
            enough = (np.cumsum(held[order], axis=1) <= rerank).sum(axis=1) + 1  # the query itself is one of them
            rows, grp, mine, size = [], [], [], []
            for i in range(len(q)):
                near = order[i, : max(probed, enough[i])]
                for g in np.unique(near % groups):
                    rows.append(i)
                    grp.append(g)
                    mine.append(near[near % groups == g])
                    size.append(len(mine[-1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(grp, pa.int64()), batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), ragged(np.concatenate(mine), np.array(size), pa.int32())],
                ["grp", "query_id", "v", "lists"],
            )

    asked = base.where(queries)
    members = base.mapInArrow(encode, "grp long, vec_id long, list int, codes binary, term double")
    members = steady(members)
    held = np.zeros(lists, np.int64)  # at most 1,024 numbers
    for r in members.groupBy("list").count().collect():
        held[r["list"]] = r["count"]
    sizes = members.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    blocks = members.join(sizes, "grp").groupBy("grp", F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part"))
    blocks = blocks.agg(*(F.collect_list(c).alias("m_" + c) for c in ("vec_id", "list", "codes", "term"))).drop("part")
    aimed = steady(asked.mapInArrow(aim, "grp long, query_id long, v array<double>, lists array<int>"))
    parts = aimed.groupBy("grp").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("parts"))
    bundles = aimed.join(parts, "grp").groupBy("grp", F.pmod(F.xxhash64("query_id"), F.col("parts")).alias("part"))
    bundles = bundles.agg(*(F.collect_list(c).alias("q_" + c) for c in ("query_id", "v", "lists"))).drop("part")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query of the row's bundle against the row's block: the best by asymmetric distance."""
        model = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, lists_of, codes, term, q_ids, q_vs, q_lists = (batch.column(j)[i].as_py() for j in range(1, 8))
                ids, lists_of, term = np.array(ids), np.array(lists_of), np.array(term)
                codes = np.frombuffer(b"".join(codes), np.uint8).reshape(len(ids), -1).T
                out_q, out_v, out_d = [], [], []
                for q_id, v, probes_of in zip(q_ids, q_vs, q_lists, strict=True):
                    q = np.array(v)
                    asked_lists = np.zeros(lists, bool)
                    asked_lists[probes_of] = True
                    on = np.flatnonzero(asked_lists[lists_of] & (ids != q_id))
                    if not len(on):
                        continue
                    coarse = ((model.coarse[probes_of] - q) ** 2).sum(axis=1)
                    base_of = np.zeros(lists)
                    base_of[probes_of] = coarse
                    d = base_of[lists_of[on]] + term[on]
                    for table, code in zip(model.tables(q), codes, strict=True):
                        d -= 2 * table[code[on]]
                    d = np.round(d, 9)
                    if len(on) > rerank:
                        edge = np.partition(d, rerank - 1)[rerank - 1]
                        best = np.flatnonzero(d <= edge)
                        best = best[np.lexsort((ids[on[best]], d[best]))[:rerank]]
                    else:
                        best = np.arange(len(on))
                    out_q.append(np.full(len(best), q_id))
                    out_v.append(ids[on[best]])
                    out_d.append(d[best])
                if out_q:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_v, out_d)], ["query_id", "vec_id", "d"])

    found = bundles.join(blocks, "grp").select("grp", "m_vec_id", "m_list", "m_codes", "m_term", "q_query_id", "q_v", "q_lists")
    found = found.mapInArrow(scan, "query_id long, vec_id long, d double")
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))).where(F.col("n") <= rerank)
    exact = best.select("query_id", "vec_id").join(base, "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    squares = F.aggregate(F.zip_with("v", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    exact = exact.select("query_id", "vec_id", F.sqrt(squares).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return exact.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
