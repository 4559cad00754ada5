"""Whole-checkpoint codec: logarithmic codes of float tensors, raw bytes of the rest, deflated with digests."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.packing import inflate

LEVELS = 256
TINY = float(np.finfo(np.float32).tiny)


def plan(rows: DataFrame, preserve_small: int) -> DataFrame:
    """Adds ``kind``: "log" for float tensors above the size, else "raw"; raises on non-finite values of the former."""
    return rows.withColumn("kind", F.when(F.col("dtype").isin("F32", "F16", "BF16", "F64") & (F.size("vec") > preserve_small), "log").otherwise("raw"))


def parameters(rows: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """Adds ``scale`` (median magnitude, or of the nonzero ones, or a hundredth of the largest, or 1) and ``zmax``."""
    a = F.array_sort(F.transform("vec", lambda x: F.abs(x.cast("double"))))

    def median(x):
        n = F.size(x)
        mid = F.floor((n - 1) / 2).cast("int")
        return F.when(n > 0, (F.element_at(x, mid + 1) + F.element_at(x, F.floor(n / 2).cast("int") + 1)) / 2)

    positive = F.filter("a", lambda x: x > 0)
    full = median(F.col("a"))
    scale = F.coalesce(F.when(full > 0, full), median(positive), F.lit(1.0))
    top = F.coalesce(F.array_max("a"), F.lit(0.0))
    out = rows.withColumn("a", a).withColumn("scale", F.greatest(scale * multiplier, F.lit(TINY))).withColumn("zmax", F.log1p(top / F.col("scale")))
    return out.drop("a")


def compress(rows: DataFrame) -> DataFrame:
    """Rows (tensor, kind, n, scale, zmax, raw_bytes, sha256, payload) of planned rows with parameters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, payloads, counts = [], [], [], []
            for i in range(batch.num_rows):
                kind, scale, zmax = (batch.column(j)[i].as_py() for j in (1, 3, 4))
                x = batch.column(2)[i].values.to_numpy(zero_copy_only=False)
                counts.append(len(x))
                if kind == "log":
                    if not np.isfinite(x).all():
                        raise ValueError(f"tensor {batch.column(0)[i]} is not finite")
                    raw = encode(x.astype(np.float64), scale, zmax).tobytes()
                else:
                    raw = x.astype("<f4").tobytes()
                sizes.append(len(raw))
                digests.append(hashlib.sha256(raw).hexdigest())
                payloads.append(zlib.compress(raw, 9))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), batch.column(3), batch.column(4), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(payloads, pa.binary())],
                ["tensor", "kind", "n", "scale", "zmax", "raw_bytes", "sha256", "payload"],
            )

    return rows.select("tensor", "kind", "vec", "scale", "zmax").mapInArrow(run, "tensor long, kind string, n long, scale double, zmax double, raw_bytes long, sha256 string, payload binary")


def encode(x: np.ndarray, scale: float, zmax: float) -> np.ndarray:
    if zmax <= 0:
        return np.zeros(len(x), np.uint8)
    z = np.sign(x) * np.log1p(np.abs(x) / scale)
    return np.clip(np.rint((z / zmax + 1) * ((LEVELS - 1) / 2)), 0, LEVELS - 1).astype(np.uint8)


def decode(codes: np.ndarray, scale: float, zmax: float) -> np.ndarray:
    z = (codes * (2 / (LEVELS - 1)) - 1) * zmax if zmax > 0 else np.zeros(len(codes))
    return np.sign(z) * np.expm1(np.abs(z)) * scale


def decompress(archive: DataFrame) -> DataFrame:
    """Rows (tensor, kind, vec) of an archive; payloads are inflated in bounded pieces and checked by length and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                tensor, kind, scale, zmax, size, digest, payload = (batch.column(j)[i].as_py() for j in range(7))
                raw = b"".join(inflate(payload))
                if len(raw) != size or hashlib.sha256(raw).hexdigest() != digest:
                    raise ValueError(f"tensor {tensor} is damaged")
                out.append(decode(np.frombuffer(raw, np.uint8), scale, zmax) if kind == "log" else np.frombuffer(raw, "<f4").astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], ["tensor", "kind", "vec"])

    return archive.select("tensor", "kind", "scale", "zmax", "raw_bytes", "sha256", "payload").mapInArrow(run, "tensor long, kind string, vec array<double>")


def verify(archive: DataFrame) -> DataFrame:
    """Rows (tensor, ok): whether the payload has the recorded length and digest; nothing but flags leaves a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for i in range(batch.num_rows):
                size, digest, payload = (batch.column(j)[i].as_py() for j in (1, 2, 3))
                seen, n = hashlib.sha256(), 0
                try:
                    for piece in inflate(payload):
                        seen.update(piece)
                        n += len(piece)
                except (ValueError, zlib.error):
                    n = -1
                ok.append(n == size and seen.hexdigest() == digest)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ok)], ["tensor", "ok"])

    return archive.select("tensor", "raw_bytes", "sha256", "payload").mapInArrow(run, "tensor long, ok boolean")


#: forms that ``candidates`` tries, in order
FORMS = {
    "log": lambda x, scale, zmax: encode(x.astype(np.float64), scale, zmax).tobytes(),
    "fp16": lambda x, scale, zmax: x.astype("<f2").tobytes(),
    "planes": lambda x, scale, zmax: x.astype("<f4").view(np.uint8).reshape(-1, 4).T.tobytes(),
    "raw": lambda x, scale, zmax: x.astype("<f4").tobytes(),
}


def candidates(rows: DataFrame, forms: tuple[str, ...] = tuple(FORMS)) -> DataFrame:
    """Rows (tensor, place, codec, bytes): the deflated size of each form of each tensor (vec, scale, zmax)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for i in range(batch.num_rows):
                x = batch.column(1)[i].values.to_numpy(zero_copy_only=False)
                sizes += [len(zlib.compress(FORMS[f](x, batch.column(2)[i].as_py(), batch.column(3)[i].as_py()), 9)) for f in forms]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(n), len(forms)))), pa.array(np.tile(np.arange(len(forms), dtype=np.int32), n)), pa.array(list(forms) * n, pa.string()), pa.array(sizes, pa.int64())],
                ["tensor", "place", "codec", "bytes"],
            )

    return rows.select("tensor", "vec", "scale", "zmax").mapInArrow(run, "tensor long, place int, codec string, bytes long")


def smallest(candidates: DataFrame) -> DataFrame:
    """The smallest codec of each tensor among (tensor, place, codec, bytes); the first by place on ties."""
    best = F.min_by(F.struct("codec", "bytes"), F.struct("bytes", "place"))
    return candidates.groupBy("tensor").agg(best.alias("b")).select("tensor", "b.*")


def shards(manifest: DataFrame, limit: int) -> DataFrame:
    """Adds ``shard`` to a manifest (place, bytes): a new one begins where the next tensor would pass the limit.

    Sequential by its nature; the manifest has one row a tensor and streams through one task in order.
    """
    names = manifest.columns
    at = names.index("bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, filled = 1, 0
        for batch in batches:
            out = []
            for size in batch.column(at).to_pylist():
                if filled and filled + size > limit:
                    shard, filled = shard + 1, 0
                filled += size
                out.append(shard)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], [*names, "shard"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in manifest.schema.fields)
    return manifest.repartition(1).sortWithinPartitions("place").mapInArrow(run, f"{kind}, shard int")


def shard_names(packed: DataFrame) -> DataFrame:
    n = F.max("shard").over(Window.partitionBy())
    name = F.when(n == 1, "model.safetensors").otherwise(F.format_string("model-%05d-of-%05d.safetensors", "shard", n))
    return packed.withColumn("file", name)
