"""Polynomial blocks, low-pass Fourier fits and low-rank factors of weight matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import numeric as N


def _literal(row: np.ndarray) -> Column:
    return F.array(*(F.lit(float(x)) for x in row))


def polynomial_blocks(blocks: DataFrame, size: int, degree: int) -> DataFrame:
    """Adds ``coeffs`` and ``y``: a least-squares polynomial over t in [-1, 1] for each block ``x``, padded at its end with
    its last value; coefficients rounded to half precision.

    The pseudo-inverse depends on the size alone, so a fit is a dot product a coefficient within the row.
    """
    if size < degree + 2:
        raise ValueError("a block needs degree + 2 values")
    t = np.linspace(-1, 1, size)
    design = np.vander(t, degree + 1, increasing=True)
    inverse = np.linalg.pinv(design)
    full = F.concat(F.col("x"), F.array_repeat(F.element_at("x", -1), F.lit(size) - F.size("x")))
    out = blocks.withColumn("full", full)
    out = out.withColumn("coeffs", F.array(*(N.fp16(N.dot("full", _literal(r))).cast("double") for r in inverse)))
    rebuilt = F.array(*(N.dot("coeffs", _literal(r)) for r in design))
    return out.withColumn("y", F.slice(rebuilt, F.lit(1), F.size("x"))).drop("full")


def fourier(rows: DataFrame, n_rows: int, n_cols: int, cutoff: int) -> DataFrame:
    """Rows (row_freq, col_freq, re, im): the low frequencies of the 2-D Fourier transform of (row_id, vec).

    Separable: each row's column frequencies are dot products with fixed cosine tables within the row; then one
    map-side combined sum over rows for each pair of frequencies.
    """
    safe = min(cutoff, max(0, (n_rows - 1) // 2))
    freqs = [f for f in range(n_rows) if min(f, n_rows - f) <= safe]
    col_cut = min(cutoff, n_cols // 2)
    turn = -2 * np.pi * np.arange(n_cols) / n_cols
    parts = [F.struct(F.lit(f).alias("col_freq"), N.dot("vec", _literal(np.cos(turn * f))).alias("re"), N.dot("vec", _literal(np.sin(turn * f))).alias("im")) for f in range(col_cut + 1)]
    cols = rows.select("row_id", F.explode(F.array(*parts)).alias("p")).select("row_id", "p.*")
    angle = F.col("row_id") * F.col("row_freq") * (-2 * np.pi / n_rows)
    both = cols.withColumn("row_freq", F.explode(F.array(*(F.lit(f) for f in freqs))))
    c, s = F.cos(angle), F.sin(angle)
    return both.groupBy("row_freq", "col_freq").agg(F.sum(F.col("re") * c - F.col("im") * s).alias("re"), F.sum(F.col("re") * s + F.col("im") * c).alias("im"))


def _mixed(re: Column, im: Column):
    return lambda c, s: re * c - im * s


def fourier_values(rows: DataFrame, spectrum: list[tuple[int, int, float, float]], n_rows: int, n_cols: int) -> DataFrame:
    """Adds ``y``, the matrix row rebuilt from (row_freq, col_freq, re, im); the coefficients are a bounded argument.

    A column frequency f stands for its mirror image too unless it is 0 or the middle one.
    """
    by_col: dict[int, list[tuple[int, float, float]]] = {}
    for r, c, re, im in spectrum:
        by_col.setdefault(c, []).append((r, re, im))
    angle = F.col("row_id") * (2 * np.pi / n_rows)
    y = None
    j = np.arange(n_cols)
    for f, terms in by_col.items():
        twice = 1.0 if f == 0 or 2 * f == n_cols else 2.0
        re = sum((F.cos(angle * r) * re - F.sin(angle * r) * im for r, re, im in terms), F.lit(0.0)) * (twice / (n_rows * n_cols))
        im = sum((F.sin(angle * r) * re + F.cos(angle * r) * im for r, re, im in terms), F.lit(0.0)) * (twice / (n_rows * n_cols))
        wave = F.zip_with(_literal(np.cos(2 * np.pi * f * j / n_cols)), _literal(np.sin(2 * np.pi * f * j / n_cols)), _mixed(re, im))
        y = wave if y is None else F.zip_with(y, wave, lambda a, b: a + b)
    return rows.withColumn("y", y)


def gram(rows: DataFrame) -> DataFrame:
    """Rows (i, j, g), i <= j: the Gram matrix of the columns of (vec), from one matrix product a batch.

    A task gives dims * (dims + 1) / 2 sums, whatever its rows.  Vectors of unequal lengths are an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "g"])

    found = rows.select(F.col("vec").cast("array<double>").alias("vec")).where("vec is not null").mapInArrow(run, "i int, j int, g double")
    return found.groupBy("i", "j").agg(F.sum("g").alias("g"))


def low_rank(rows: DataFrame, dims: int, rank: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Rows with ``u`` (balanced left factor), the singular values, and the balanced right factor (dims x rank).

    Singular vectors come from the eigenvectors of the Gram matrix, which is dims x dims and solved on the driver; the left factor is a
    projection of each row where it lies.  The sign of each vector makes its largest component positive.
    """
    g = np.zeros((dims, dims))
    for r in gram(rows).collect():  # dims * (dims + 1) / 2 numbers
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["g"]
    values, vectors = np.linalg.eigh(g)
    order = np.argsort(values)[::-1][:rank]
    v = vectors[:, order]
    v *= np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    s = np.sqrt(np.maximum(values[order], 0))
    root = np.sqrt(s)
    left = [N.fp16(N.dot("vec", _literal(v[:, k] / (root[k] if root[k] > 0 else 1.0)))).cast("double") for k in range(len(order))]
    right = (v * root).astype(np.float16).astype(np.float64)
    return rows.withColumn("u", F.array(*left)), s, right


def low_rank_values(factored: DataFrame, right: np.ndarray) -> DataFrame:
    """Adds ``y`` = u V^T within each row."""
    return factored.withColumn("y", F.array(*(N.dot("u", _literal(r)) for r in right)))


def mlp_values(rows: DataFrame, params: dict[str, np.ndarray]) -> DataFrame:
    """Adds ``y``: for each (row_id, col) a small network on row and column embeddings, tanh hidden layer, fixed weights.

    ``params`` (row_emb, col_emb, w1, b1, w2, b2, mean, std) is a bounded artefact; scoring is a batch of matrix products.
    """
    shared = rows.sparkSession.sparkContext.broadcast(params)
    names = rows.columns
    at = names.index("row_id"), names.index("col")

    def run(batches):
        p = shared.value
        for batch in batches:
            r, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in at)
            x = np.concatenate([p["row_emb"][r % len(p["row_emb"])], p["col_emb"][c % len(p["col_emb"])]], axis=1)
            y = np.tanh(x @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(y.ravel() * p["std"] + p["mean"])], [*names, "y"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kind}, y double")
