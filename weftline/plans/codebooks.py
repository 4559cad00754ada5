"""Queries of codebooks: fits, assignment, lookup, row-wise codebooks, sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import numeric as N
from weftline.operators import codebook as K
from weftline.operators import metrics as M
from weftline.plans.profile import rounded
from weftline.plans.registry import W, Registry, bf16, fp16, metrics_sql
from weftline.sources.tables import matrix, weights

R = Registry()

# Seeds at even ranks and Lloyd steps, as chained table expressions.
_SEED = """v AS (SELECT label, CAST(value AS DOUBLE) AS v, CAST(count(*) AS DOUBLE) AS w FROM w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM v),
c0 AS (SELECT label, list(DISTINCT v ORDER BY v) AS c FROM r, (SELECT unnest(range({k})) AS j) WHERE i = CAST(round_even(j * (n - 1) / {m}, 0) AS BIGINT) GROUP BY 1)"""


def _step(n: int) -> str:
    return f"""c{n + 1} AS (SELECT label, list(m ORDER BY m) AS c FROM (SELECT v.label, len(list_filter(range(1, len(c)), lambda t: (c[t] + c[t + 1]) / 2 <= v)) AS code, sum(v * w) / sum(w) AS m
  FROM v JOIN c{n} USING (label) GROUP BY ALL) GROUP BY label)"""


def _fitted(k: int, steps: int) -> str:
    return ", ".join([W, _SEED.format(k=k, m=f"{k - 1}.0"), *(_step(i) for i in range(steps))])


def lloyd(spark, sf, k=8, steps=3):
    """Counted values of each label, and their codebook after some Lloyd steps from even ranks."""
    values = K.counted(weights(matrix(spark, sf)), ["label"])
    centres = K.rank_seeds(values, ["label"], k)
    for _ in range(steps):
        centres = K.lloyd_step(values, centres, ["label"])
    return centres


def listed(centres):
    return centres.select("label", F.posexplode("centres").alias("idx", "centre")).select("label", "idx", F.round("centre", 6).alias("centre"))


_LIST = "SELECT label, CAST(unnest(range(len(c))) AS INTEGER) AS idx, round(CAST(unnest(c) AS DOUBLE), 6) AS centre FROM {}"


@R.query(f"WITH {_fitted(8, 3)} {_LIST.format('c3')}")
def fit_kmeans1d(spark, sf):
    return listed(lloyd(spark, sf))


@R.query()
def fit_kmeans1d_converged(spark, sf):
    """Both seedings, run to convergence; checked against a plain implementation in the tests."""
    return listed(K.fit_kmeans(K.counted(weights(matrix(spark, sf)), ["label"]), "label", 16))


@R.query(f"WITH {_fitted(8, 2)}, a AS (SELECT tensor, flat_index, CAST(value AS DOUBLE) AS v, c FROM w JOIN c2 USING (label)) SELECT tensor, flat_index, CAST(len(list_filter(range(1, len(c)), lambda t: (c[t] + c[t + 1]) / 2 <= v)) AS INTEGER) AS code FROM a")
def jn_nearest_center(spark, sf):
    return K.assign(weights(matrix(spark, sf)), lloyd(spark, sf, 8, 2), ["label"]).select("tensor", "flat_index", "code")


_CODED = f"{_fitted(8, 2)}, a AS (SELECT tensor, label, value, c, len(list_filter(range(1, len(c)), lambda t: (c[t] + c[t + 1]) / 2 <= CAST(value AS DOUBLE))) AS code FROM w JOIN c2 USING (label)), z AS (SELECT *, c[code + 1] AS centre FROM a)"


@R.query(f"WITH {_CODED} {metrics_sql('z', 'label', 'value', 'centre')}")
def jn_codebook_lookup(spark, sf):
    coded = K.assign(weights(matrix(spark, sf)), lloyd(spark, sf, 8, 2), ["label"])
    return M.error_metrics(coded, ["label"], "value", "centre")


@R.query(f"WITH {_fitted(8, 1)}, x AS (SELECT label, unnest(c) AS c FROM c1), p AS (SELECT label, {fp16('c')} AS h, {bf16('c')} AS b FROM x) SELECT label, 'fp16' AS dtype, count(DISTINCT h) AS n, round(sum(DISTINCT CAST(h AS DOUBLE)), 6) AS total FROM p GROUP BY 1 UNION ALL SELECT label, 'bf16', count(DISTINCT b), round(sum(DISTINCT CAST(b AS DOUBLE)), 6) FROM p GROUP BY 1")
def fn_cast_codebook(spark, sf):
    """Codebooks in half precision; centres that rounding merges count once."""
    c = lloyd(spark, sf, 8, 1)
    cast = c.select("label", F.explode(F.create_map(*(x for d in ("fp16", "bf16") for x in (F.lit(d), K.cast_codebook(F.col("centres"), d))))).alias("dtype", "book"))
    return cast.select("label", "dtype", F.size("book").cast("long").alias("n"), F.round(F.aggregate("book", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


_ROW = """s AS (SELECT vec_id AS tensor, [CAST(x AS DOUBLE) FOR x IN embedding] AS vec, list_transform(range(4), lambda j: CAST(list_sort(embedding)[CAST(floor((j + 0.5) * len(embedding) / 4) AS BIGINT) + 1] AS DOUBLE)) AS c FROM embeddings)"""


def _row_step(a: str, b: str) -> str:
    code = "len(list_filter([1, 2, 3], lambda t: (c[t] + c[t + 1]) / 2 <= x))"
    return f"""{b} AS (SELECT tensor, vec, list_sort(list_transform(range(4), lambda j: CASE WHEN len(list_filter(codes, lambda q: q = j)) > 0
  THEN list_sum([vec[t] FOR t IN range(1, len(vec) + 1) IF codes[t] = j]) / len(list_filter(codes, lambda q: q = j)) ELSE c[j + 1] END)) AS c FROM (SELECT *, list_transform(vec, lambda x: {code}) AS codes FROM {a}))"""


@R.query(f"WITH {_ROW}, {_row_step('s', 't')} SELECT tensor, CAST(unnest(range(4)) AS INTEGER) AS idx, round(unnest(c), 6) AS centre FROM t")
def fit_kmeans_rowwise(spark, sf):
    # an outer explode: the other one makes the optimiser copy the whole nested expression into a filter on the array's size
    rows = K.rowwise_step(K.rowwise_seeds(matrix(spark, sf), 4))
    return rows.select("tensor", F.posexplode_outer("centres").alias("idx", "centre")).select("tensor", "idx", F.round("centre", 6).alias("centre"))


@R.query(f"WITH {_ROW}, x AS (SELECT tensor, unnest(range(len(vec))) AS i, unnest(vec) AS v, c FROM s) SELECT tensor, i AS flat_index, CAST(len(list_filter([1, 2, 3], lambda t: (c[t] + c[t + 1]) / 2 <= v)) AS INTEGER) AS code FROM x")
def jn_nearest_rowwise(spark, sf):
    rows = K.rowwise_seeds(matrix(spark, sf), 4).withColumn("bounds", N.midpoints(F.col("centres")))
    coded = rows.withColumn("codes", F.transform("vec", lambda v: N.nearest_code(v.cast("double"), F.col("bounds"))))
    return coded.select("tensor", F.posexplode_outer("codes").alias("flat_index", "code")).withColumn("flat_index", F.col("flat_index").cast("long"))


_SWEEP = " UNION ALL ".join(
    f"SELECT * FROM (WITH {_fitted(k, 1)}, a AS (SELECT label, CAST(value AS DOUBLE) AS v, c, len(list_filter(range(1, len(c)), lambda t: (c[t] + c[t + 1]) / 2 <= CAST(value AS DOUBLE))) AS code FROM w JOIN c1 USING (label)) SELECT {k} AS k, label, round(sqrt(avg((v - c[code + 1]) * (v - c[code + 1]))), 6) AS rmse FROM a GROUP BY label)"
    for k in (2, 4, 8)
)


@R.query(_SWEEP)
def fit_sweep(spark, sf):
    """Codebook sizes against error for each label: the values are counted once for all sizes."""
    values = K.counted(weights(matrix(spark, sf)), ["label"])
    out = None
    for k in (2, 4, 8):
        centres = K.lloyd_step(values, K.rank_seeds(values, ["label"], k), ["label"])
        coded = K.assign(values, centres, ["label"], "v")
        e = F.col("v") - F.col("centre")
        found = coded.groupBy("label").agg(F.round(F.sqrt(F.sum(e * e * F.col("w")) / F.sum("w")), 6).alias("rmse")).select(F.lit(k).alias("k"), "label", "rmse")
        out = found if out is None else out.unionByName(found)
    return out


# Scalar quantisers.

_RANGE = f"{W}, r AS (SELECT label, min(CAST(value AS DOUBLE)) AS lo, max(CAST(value AS DOUBLE)) AS hi, median(abs(CAST(value AS DOUBLE))) AS scale, max(abs(CAST(value AS DOUBLE))) AS top FROM w GROUP BY 1), x AS (SELECT w.*, CAST(value AS DOUBLE) AS v, lo, hi, scale, ln(1 + top / scale) AS zmax FROM w JOIN r USING (label))"
_UNIFORM = f"{_RANGE}, q AS (SELECT *, CAST(least(255, greatest(0, round_even((v - lo) / ((hi - lo) / 255), 0))) AS INTEGER) AS code FROM x)"
_LOG = f"{_RANGE}, q AS (SELECT *, CAST(least(255, greatest(0, round_even((sign(v) * ln(1 + abs(v) / scale) / zmax + 1) * 127.5, 0))) AS INTEGER) AS code FROM x)"


def ranges(spark, sf):
    w = weights(matrix(spark, sf))
    v = F.col("value").cast("double")
    r = w.groupBy("label").agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.median(F.abs(v)).alias("scale"), F.max(F.abs(v)).alias("top"))
    return w.withColumn("v", v).join(r.withColumn("zmax", F.log1p(F.col("top") / F.col("scale"))), "label")


@R.query(f"WITH {_UNIFORM} SELECT tensor, flat_index, code FROM q")
def fn_uniform_quant(spark, sf):
    return ranges(spark, sf).select("tensor", "flat_index", N.uniform_code(F.col("v"), F.col("lo"), F.col("hi"), 256).alias("code"))


@R.query(f"WITH {_UNIFORM}, z AS (SELECT label, v, lo + code * ((hi - lo) / 255) AS y FROM q) {metrics_sql('z', 'label', 'v', 'y').replace('*, CAST(v AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y', 'label, CAST(v AS DOUBLE) AS x, y')}")
def fn_uniform_dec(spark, sf):
    r = ranges(spark, sf)
    code = N.uniform_code(F.col("v"), F.col("lo"), F.col("hi"), 256)
    return M.error_metrics(r.withColumn("y", N.uniform_value(code, F.col("lo"), F.col("hi"), 256)), ["label"], "v", "y")


@R.query(f"WITH {_LOG} SELECT tensor, flat_index, code FROM q")
def fn_log_quant(spark, sf):
    return ranges(spark, sf).select("tensor", "flat_index", N.log_code(F.col("v"), F.col("scale"), F.col("zmax"), 256).alias("code"))


@R.query(f"WITH {_LOG}, y AS (SELECT label, v, (code * (2.0 / 255) - 1) * zmax AS z, scale FROM q), z AS (SELECT label, v AS x, sign(z) * (exp(abs(z)) - 1) * scale AS y FROM y) {metrics_sql('z', 'label', 'x', 'y').replace('*, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y', '*')}")
def fn_log_dec(spark, sf):
    r = ranges(spark, sf)
    code = N.log_code(F.col("v"), F.col("scale"), F.col("zmax"), 256)
    return M.error_metrics(r.withColumn("y", N.log_value(code, F.col("scale"), F.col("zmax"), 256)), ["label"], "v", "y")


@R.query(f"WITH {_RANGE} SELECT label, round(any_value(scale), 6) AS scale, round(any_value(zmax), 6) AS zmax FROM x GROUP BY 1")
def fn_log_params(spark, sf):
    v = F.abs(F.col("value").cast("double"))
    p = weights(matrix(spark, sf)).groupBy("label").agg(F.median(v).alias("scale"), F.log1p(F.max(v) / F.median(v)).alias("zmax"))
    return rounded(p)


# NF4: the sixteen levels of the 4-bit normal float, fixed values from the QLoRA paper.
NF4 = [
    -1.0, -0.6961928009986877, -0.5250730514526367, -0.39491748809814453, -0.28444138169288635, -0.18477343022823334, -0.09105003625154495, 0.0,
    0.07958029955625534, 0.16093020141124725, 0.24611230194568634, 0.33791524171829224, 0.44070982933044434, 0.5626170039176941, 0.7229568362236023, 1.0,
]


@R.query(f"""WITH {W}, b AS (SELECT *, flat_index // 64 AS block, max(abs(CAST(value AS DOUBLE))) OVER (PARTITION BY tensor, flat_index // 64) AS top, {NF4} AS c FROM w),
q AS (SELECT *, len(list_filter(range(1, 16), lambda t: (c[t] + c[t + 1]) / 2 <= CAST(value AS DOUBLE) / top)) AS code FROM b)
SELECT tensor, flat_index, CAST(code AS INTEGER) AS code, round(c[code + 1] * top, 6) AS rebuilt FROM q""")
def fn_dequant_nf4(spark, sf):
    """Codes and values of 4-bit normal floats over blocks of 64, within each row."""
    levels = F.array(*(F.lit(x) for x in NF4))
    m = matrix(spark, sf).withColumn("top", F.aggregate("vec", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v.cast("double")))))
    bounds = F.array(*(F.lit((a + b) / 2) for a, b in zip(NF4, NF4[1:], strict=False)))
    w = m.select("tensor", "top", F.posexplode("vec").alias("flat_index", "value")).withColumn("code", N.nearest_code(F.col("value").cast("double") / F.col("top"), bounds))
    return w.select("tensor", F.col("flat_index").cast("long").alias("flat_index"), "code", F.round(F.element_at(levels, F.col("code") + 1) * F.col("top"), 6).alias("rebuilt"))
