"""Column expressions for half-precision rounding, scalar quantisers, metrics and small array algebra.

All of them are built-in functions, so they stay inside the JVM.  Arithmetic that must match 32-bit floats is
cast back to FLOAT after each step, since Spark widens on division.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_to(x: Column | str, mantissa: int, least: int, limit: float | None) -> Column:
    """Round to ``mantissa`` fraction bits (ties to even), subnormal below 2^least, infinite from ``limit`` on."""
    x = _col(x).cast("double")
    unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))), F.lit(least)) - mantissa)
    rounded = F.when((x == 0) | F.isnan(x) | (F.abs(x) == INF), x).otherwise(F.rint(x / unit) * unit)
    if limit is not None:
        rounded = F.when(F.abs(x) >= limit, F.signum(x) * INF).otherwise(rounded)
    return rounded.cast("float")


def fp16(x: Column | str) -> Column:
    return round_to(x, 10, -14, 65520.0)


def bf16(x: Column | str) -> Column:
    return round_to(x, 7, -126, None)


def finite(x: Column | str) -> Column:
    x = _col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INF)


def clamp(x: Column, low: int, high: int) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


# 4-bit blocks: the signed value of the first largest magnitude is mapped to code 0.


def block_scale(block: Column) -> Column:
    """The block's 32-bit scale; the first of equal magnitudes counts, an all-zero block has scale 0."""
    top = F.aggregate(block, F.lit(0.0).cast("float"), lambda a, v: F.when(F.abs(v) > F.abs(a), v).otherwise(a))
    return (top / F.lit(-8.0)).cast("float")


def block_codes(block: Column, scale: Column) -> Column:
    inverse = F.when(scale != 0, (F.lit(1.0) / scale).cast("float")).otherwise(F.lit(0.0).cast("float"))
    half = F.lit(8.5).cast("float")
    return F.transform(block, lambda v: clamp(F.floor((v * inverse).cast("float") + half), 0, 15).cast("int"))


def block_values(codes: Column, scale: Column) -> Column:
    """Codes times the scale as stored in half precision."""
    stored = fp16(scale)
    return F.transform(codes, lambda c: ((c - 8).cast("float") * stored).cast("float"))


# Uniform and logarithmic scalar quantisers.


def uniform_code(x: Column, low: Column, high: Column, levels: int) -> Column:
    step = (high - low) / (levels - 1)
    return F.when(step > 0, clamp(F.rint((x - low) / step), 0, levels - 1).cast("int")).otherwise(F.lit(0))


def uniform_value(code: Column, low: Column, high: Column, levels: int) -> Column:
    return low + code * ((high - low) / (levels - 1))


def log_code(x: Column, scale: Column, zmax: Column, levels: int) -> Column:
    z = F.signum(x) * F.log1p(F.abs(x) / scale)
    return F.when(zmax > 0, clamp(F.rint((z / zmax + 1) * ((levels - 1) / 2)), 0, levels - 1).cast("int")).otherwise(F.lit(0))


def log_value(code: Column, scale: Column, zmax: Column, levels: int) -> Column:
    z = (code * (2.0 / (levels - 1)) - 1) * zmax
    return F.signum(z) * F.expm1(F.abs(z)) * scale


# Codebooks.


def midpoints(centres: Column) -> Column:
    """Bounds between neighbours of a sorted codebook."""
    n = F.size(centres)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: (F.element_at(centres, i) + F.element_at(centres, i + 1)) / 2)).otherwise(
        F.array().cast("array<double>")
    )


def nearest_code(x: Column, bounds: Column) -> Column:
    """How many bounds are not above x: a value on a bound goes up."""
    return F.size(F.filter(bounds, lambda b: b <= x))


# Vectors.


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))


# Sizes, names, shapes.


def varint_length(delta: Column) -> Column:
    """Bytes of an unsigned LEB128 number of up to 63 bits."""
    out = F.lit(1)
    for k in range(1, 9):
        out = out + (delta >= (1 << (7 * k))).cast("int")
    return out


def numel(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x)


def shape_text(shape: Column) -> Column:
    return F.when(F.size(shape) == 0, F.lit("scalar")).otherwise(F.array_join(F.transform(shape, lambda x: x.cast("string")), "x"))


def index_bits(k: Column) -> Column:
    return F.when(k <= 1, F.lit(0)).otherwise(F.ceil(F.log2(k.cast("double"))).cast("int"))


def safe_name(name: Column) -> Column:
    return F.right(F.regexp_replace(name, "[^A-Za-z0-9_.-]+", "_"), F.lit(100))


LAYER = r"(?i)^(.*?(?:^|\.)(?:layers|blocks|h|layer|block)\.\d+)(?:\.|$)"


def scope_key(name: Column, scope: Column) -> Column:
    """Codebook scope: one for all, one for each numbered layer, or one for each tensor; a tensor without a
    layer number stays alone."""
    layer = F.regexp_extract(name, LAYER, 1)
    alone = F.concat(F.lit("tensor::"), name)
    return F.when(scope == "global", F.lit("global")).when((scope == "layer") & (layer != ""), F.concat(F.lit("layer::"), layer)).otherwise(alone)


def silu_gate(gate: Column, up: Column) -> Column:
    return gate / (1 + F.exp(-gate)) * up
