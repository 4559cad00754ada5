"""Queries of tensor profiles, histograms, scopes and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import numeric as N
from weftline.operators import profile as P
from weftline.plans.registry import W, Registry, fp16
from weftline.sources.tables import matrix, table, weights

R = Registry()
_NAME = "CASE WHEN label = 9 THEN 'embed.t' || tensor ELSE 'model.layers.' || label || '.t' || tensor || '.weight' END"


def named(spark, sf):
    """Weights with a tensor name made of label and id; label 9 has no layer number."""
    w = weights(matrix(spark, sf))
    t = F.col("tensor").cast("string")
    return w, F.when(F.col("label") == 9, F.concat(F.lit("embed.t"), t)).otherwise(F.concat(F.lit("model.layers."), F.col("label").cast("string"), F.lit(".t"), t, F.lit(".weight")))


def rounded(df, *keep):
    """Doubles rounded to 6 places, other columns as they are."""
    return df.select(*(F.round(c, 6).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes))


_PROFILE = """count(*) AS numel, count(*) AS finite, CAST(0 AS BIGINT) AS nonfinite, count(*) FILTER (v = 0) AS zeros, round(min(v), 6) AS min, round(max(v), 6) AS max,
  round(avg(v), 6) AS mean, round(sqrt(greatest(0.0, avg(v * v) - avg(v) * avg(v))), 6) AS std, round(count(*) FILTER (v = 0) / count(*), 6) AS zero_fraction"""


@R.query(f"WITH {W} SELECT tensor, {_PROFILE} FROM (SELECT tensor, CAST(value AS DOUBLE) AS v FROM w) GROUP BY tensor")
def agg_tensor_profile(spark, sf):
    return rounded(P.tensor_profile(weights(matrix(spark, sf)), ["tensor"]))


@R.query(f"SELECT * FROM (SELECT 'quantity' AS name, {_PROFILE} FROM (SELECT l_quantity AS v FROM lineitem) UNION ALL SELECT 'discount' AS name, {_PROFILE} FROM (SELECT l_discount AS v FROM lineitem))")
def agg_tensor_profile_columns(spark, sf):
    """Profiles of table columns as tensors: one scan, the columns stacked within each row."""
    columns = F.explode(F.create_map(F.lit("quantity"), F.col("l_quantity"), F.lit("discount"), F.col("l_discount"))).alias("name", "value")
    return rounded(P.tensor_profile(table(spark, sf, "lineitem").select(columns), ["name"]))


@R.query(f"WITH {W} SELECT label, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM (SELECT label, CAST(value AS DOUBLE) AS v FROM w) GROUP BY label")
def agg_global_moments(spark, sf):
    return rounded(P.merged_moments(P.tensor_profile(weights(matrix(spark, sf)), ["label", "tensor"]), ["label"]))


@R.query("SELECT label, count(DISTINCT x) AS n_patterns FROM (SELECT label, unnest(embedding) AS x FROM embeddings) GROUP BY 1")
def agg_distinct32_capped(spark, sf):
    """Distinct 32-bit patterns, null above five million; equal to distinct values, as there is no -0 or NaN."""
    bits = P.bit_patterns(weights(matrix(spark, sf)).select("label", "value"))
    return bits.groupBy("label").agg(P.capped_distinct(F.col("bits"), 5_000_000).alias("n_patterns"))


@R.query(f"WITH {W} SELECT label, h AS value16, count(*) AS n FROM (SELECT label, round(CAST({fp16('value')} AS DOUBLE), 9) AS h FROM w) GROUP BY ALL")
def agg_bit_hist16(spark, sf):
    """Histogram of half-precision patterns, shown by their value."""
    w = weights(matrix(spark, sf)).select("label", "value")
    return P.bit_patterns(w, "f16").groupBy("label", "bits").agg(F.count("*").alias("n"), F.first(N.fp16("value")).alias("h")).select("label", F.round(F.col("h").cast("double"), 9).alias("value16"), "n")


@R.query("""SELECT event_id, (CASE WHEN event_id % 7 = 0 THEN 'NaN' WHEN event_id % 11 = 0 THEN 'Inf' ELSE 'finite' END) = 'finite' AS kept FROM events WHERE NOT (event_id % 7 = 0 OR event_id % 11 = 0)""")
def flt_finite(spark, sf):
    """Values with NaN and infinities put in, and filtered."""
    i = F.col("event_id")
    v = F.when(i % 7 == 0, F.lit(float("nan"))).when(i % 11 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return table(spark, sf, "events").withColumn("v", v).where(N.finite("v")).select("event_id", F.lit(True).alias("kept"))


@R.query("SELECT label, approx AS n FROM (SELECT label, count(DISTINCT x) AS approx FROM (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings) WHERE i % 4 = 0 GROUP BY 1)")
def agg_sample_unique(spark, sf):
    return weights(matrix(spark, sf)).where("flat_index % 4 = 0").groupBy("label").agg(F.count_distinct("value").alias("n"))


_CODES = f"{W}, r AS (SELECT label, min(CAST(value AS DOUBLE)) AS lo, max(CAST(value AS DOUBLE)) AS hi FROM w GROUP BY 1), c AS (SELECT w.*, lo, hi, CAST(least(15, greatest(0, round_even((CAST(value AS DOUBLE) - lo) / ((hi - lo) / 15), 0))) AS INTEGER) AS code FROM w JOIN r USING (label))"


def codes(spark, sf, levels=16):
    """16-level codes of every weight between its label's extremes; two scans, the ranges joined back."""
    w = weights(matrix(spark, sf))
    v = F.col("value").cast("double")
    ranges = w.groupBy("label").agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    return w.join(ranges, "label").withColumn("code", N.uniform_code(v, F.col("lo"), F.col("hi"), levels))


@R.query(f"WITH {_CODES} SELECT label, code, count(*) AS n FROM c GROUP BY ALL")
def agg_symbol_hist(spark, sf):
    return P.histogram(codes(spark, sf), ["label"])


@R.query(f"""WITH {_CODES}, h AS (SELECT label, code, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT label, CAST(sum(n) AS BIGINT) AS total, CAST(count(*) AS INTEGER) AS used, sum(n * log2(n)) AS s FROM h GROUP BY 1),
e AS (SELECT *, greatest(0.0, log2(total) - s / total) AS h, CASE WHEN used <= 1 THEN 0 ELSE CAST(ceil(log2(used)) AS INTEGER) END AS fixed_bits FROM t)
SELECT label, total, used, round(h, 6) AS entropy, fixed_bits, round(CASE WHEN fixed_bits > 0 THEN (1 - h / fixed_bits) * 100 ELSE 0 END, 6) AS saving_percent FROM e""")
def agg_entropy(spark, sf):
    return rounded(P.entropy(P.histogram(codes(spark, sf), ["label"]), ["label"]))


@R.query(f"WITH {_CODES}, h AS (SELECT label, code, count(*) AS n FROM c GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, code DESC) AS place FROM h) SELECT label, code, n, CAST(place AS INTEGER) AS place FROM k WHERE place <= 10")
def top_rep_freq(spark, sf):
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), F.desc("code")))
    return P.histogram(codes(spark, sf), ["label"]).withColumn("place", place).where("place <= 10").select("label", "code", "n", "place")


@R.query(f"""WITH {_CODES}, f AS (SELECT tensor, flat_index, coalesce(CAST(code <> lag(code) OVER (PARTITION BY tensor ORDER BY flat_index) AS INTEGER), 1) AS change FROM c),
i AS (SELECT tensor, run, count(*) AS n FROM (SELECT *, sum(change) OVER (PARTITION BY tensor ORDER BY flat_index) AS run FROM f) GROUP BY ALL)
SELECT tensor, count(*) AS runs, max(n) AS longest, round(sum(n) / count(*), 6) AS average, round(CASE WHEN sum(n) > 1 THEN (count(*) - 1) / (sum(n) - 1) ELSE 0 END, 6) AS transition_rate FROM i GROUP BY 1""")
def win_runs(spark, sf):
    return rounded(P.runs(codes(spark, sf), ["tensor"], "flat_index"))


_SCOPED = f"""{W}, nm AS (SELECT *, {_NAME} AS name FROM w), sc AS (
  SELECT *, 'global' AS scope, 'global' AS scope_key FROM nm UNION ALL
  SELECT *, 'layer' AS scope, CASE WHEN label = 9 THEN 'tensor::' || name ELSE 'layer::model.layers.' || label END AS scope_key FROM nm UNION ALL
  SELECT *, 'tensor' AS scope, 'tensor::' || name AS scope_key FROM nm)"""


@R.query(f"WITH {_SCOPED} SELECT scope, scope_key, count(*) AS n, round(avg(CAST(value AS DOUBLE)), 6) AS mean, round(stddev_pop(CAST(value AS DOUBLE)), 6) AS std FROM sc GROUP BY ALL")
def agg_grouped_scopes(spark, sf):
    s = P.scoped(*named(spark, sf))
    v = F.col("value").cast("double")
    return s.groupBy("scope", "scope_key").agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"))


@R.query(f"WITH {_SCOPED} SELECT DISTINCT name, scope, scope_key FROM sc WHERE flat_index = 0")
def prj_group_key(spark, sf):
    w, name = named(spark, sf)
    return P.scoped(w.where("flat_index = 0"), name).select("name", "scope", "scope_key")


fn_names = "SELECT DISTINCT label, regexp_extract('Model.Blocks.' || label || '.Mlp', '(?i)^(.*?(?:^|\\.)(?:layers|blocks|h|layer|block)\\.\\d+)(?:\\.|$)', 1) AS prefix, CAST(regexp_extract('model.layers.' || label || '.mlp.up', '(?:^|\\.)layers\\.(\\d+)\\.mlp(?:\\.|$)', 1) AS INTEGER) AS layer FROM embeddings"


@R.query(fn_names)
def fn_layer_regex(spark, sf):
    label = F.col("label").cast("string")
    prefix = F.regexp_extract(F.concat(F.lit("Model.Blocks."), label, F.lit(".Mlp")), N.LAYER, 1)
    layer = F.regexp_extract(F.concat(F.lit("model.layers."), label, F.lit(".mlp.up")), r"(?:^|\.)layers\.(\d+)\.mlp(?:\.|$)", 1).cast("int")
    return matrix(spark, sf).select("label", prefix.alias("prefix"), layer.alias("layer")).distinct()


@R.query("SELECT n, k, bits, (n * bits + 7) // 8 AS index_bytes, CAST(k AS BIGINT) * 2 AS codebook_bytes, round(n * 2 / ((n * bits + 7) // 8 + k * 2), 6) AS ratio, round((1 - ((n * bits + 7) // 8 + k * 2) / (n * 2)) * 100, 6) AS saving_percent FROM (SELECT n, k, CASE WHEN k <= 1 THEN 0 ELSE CAST(ceil(log2(k)) AS INTEGER) END AS bits FROM (SELECT count(*) * 64 AS n FROM embeddings GROUP BY label), (SELECT unnest([1, 2, 3, 16, 100, 4096]) AS k))")
def agg_storage_cost(spark, sf):
    n = matrix(spark, sf).groupBy("label").agg((F.count("*") * 64).alias("n"))
    return P.storage_cost(n.select("n", F.explode(F.array(*(F.lit(k) for k in (1, 2, 3, 16, 100, 4096)))).alias("k")))


@R.query(f"""WITH {_CODES}, p AS (SELECT tensor, label, avg(pow(CAST(value AS DOUBLE) - (lo + code * ((hi - lo) / 15)), 2)) AS mse, count(*) AS n, tensor % 5 > 0 AS covered FROM c GROUP BY tensor, label)
SELECT label, round(sum(n * mse) FILTER (covered) / sum(n) FILTER (covered), 9) AS mse, round(sum(n) FILTER (covered) / sum(n) * 100, 6) AS coverage_percent FROM p GROUP BY 1""")
def agg_pop_weighted_err(spark, sf):
    """Error of each label weighted by tensor size, over the tensors that have a validation sample."""
    c = codes(spark, sf)
    e = F.col("value").cast("double") - N.uniform_value(F.col("code"), F.col("lo"), F.col("hi"), 16)
    p = c.groupBy("tensor", "label").agg(F.avg(e * e).alias("mse"), F.count("*").alias("n")).withColumn("covered", F.col("tensor") % 5 > 0)
    n = F.when(F.col("covered"), F.col("n"))
    return p.groupBy("label").agg(F.round(F.sum(n * F.col("mse")) / F.sum(n), 9).alias("mse"), F.round(F.sum(n) / F.sum("n") * 100, 6).alias("coverage_percent"))


@R.query("SELECT event_type, round(median(abs(value)), 6) AS m, round(coalesce(median(CASE WHEN abs(value) > 0 THEN abs(value) END), max(abs(value)) / 100, 1), 6) AS scale FROM events GROUP BY 1")
def agg_median_abs(spark, sf):
    """Median magnitude with fallbacks: of the nonzero values, then a hundredth of the largest, then 1."""
    a = F.abs("value")
    fall = F.coalesce(F.median(F.when(a > 0, a)), F.max(a) / 100, F.lit(1.0))
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.median(a), 6).alias("m"), F.round(fall, 6).alias("scale"))


@R.query("SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS mean FROM lineitem GROUP BY 1")
def agg_weighted_avg(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_quantity") * F.col("l_extendedprice")) / F.sum("l_quantity"), 4).alias("mean"))


@R.query("SELECT dtype, count(*) AS tensors, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT CASE WHEN label % 2 = 0 THEN 'F32' ELSE 'BF16' END AS dtype, len(embedding) * CASE WHEN label % 2 = 0 THEN 4 ELSE 2 END AS bytes FROM embeddings) GROUP BY 1")
def agg_counts_by_dtype(spark, sf):
    even = F.col("label") % 2 == 0
    m = matrix(spark, sf).select(F.when(even, "F32").otherwise("BF16").alias("dtype"), (F.size("vec") * F.when(even, 4).otherwise(2)).cast("long").alias("bytes"))
    return m.groupBy("dtype").agg(F.count("*").alias("tensors"), F.sum("bytes").alias("bytes"))


@R.query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1")
def agg_all_distinct_check(spark, sf):
    """Keys that repeat; empty where they are all distinct."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).where("n > 1")


# Windows over orders.


@R.query("""WITH v AS (SELECT l_returnflag, l_quantity AS v, count(*) AS c FROM lineitem GROUP BY ALL),
k AS (SELECT *, sum(c) OVER (PARTITION BY l_returnflag ORDER BY v) AS cum, sum(c) OVER (PARTITION BY l_returnflag) AS total FROM v),
t AS (SELECT DISTINCT l_returnflag, total, unnest(range(8)) AS j FROM k)
SELECT t.l_returnflag, CAST(t.j AS INTEGER) AS j, min(v) AS seed FROM t JOIN k ON t.l_returnflag = k.l_returnflag AND k.cum >= (t.j + 0.5) * t.total / 8 GROUP BY ALL""")
def win_cumweight(spark, sf):
    """Weighted-quantile seeds: distinct values are counted first, so the window sees each value once."""
    v = table(spark, sf, "lineitem").groupBy("l_returnflag", F.col("l_quantity").alias("v")).agg(F.count("*").alias("c"))
    all_of, upto = Window.partitionBy("l_returnflag"), Window.partitionBy("l_returnflag").orderBy("v")
    k = v.withColumn("cum", F.sum("c").over(upto)).withColumn("total", F.sum("c").over(all_of))
    # a value is the seed of every target that lies in (cum - c, cum]
    targets = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda j: ((j + 0.5) * F.col("total") / 8 <= F.col("cum")) & ((j + 0.5) * F.col("total") / 8 > F.col("cum") - F.col("c")))
    return k.select("l_returnflag", F.explode(targets).alias("j"), F.col("v").alias("seed"))


@R.query("""WITH v AS (SELECT DISTINCT l_returnflag, l_quantity AS v FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM v)
SELECT r.l_returnflag, CAST(j AS INTEGER) AS j, v AS seed FROM r, (SELECT unnest(range(8)) AS j) WHERE i = CAST(round_even(j * (n - 1) / 7.0, 0) AS BIGINT)""")
def win_rank_seed(spark, sf):
    v = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").alias("v")).distinct()
    r = v.withColumn("i", F.row_number().over(Window.partitionBy("l_returnflag").orderBy("v")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("l_returnflag")))
    hit = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda j: F.rint(j * (F.col("n") - 1) / 7.0) == F.col("i"))
    return r.select("l_returnflag", F.explode(hit).alias("j"), F.col("v").alias("seed"))


@R.query("SELECT vec_id AS tensor, unnest(range(8))::INTEGER AS j, round(CAST(list_sort(embedding)[CAST(floor((unnest(range(8)) + 0.5) * 64 / 8) AS BIGINT) + 1] AS DOUBLE), 6) AS seed FROM embeddings")
def win_row_quantile(spark, sf):
    """Order statistics of each row, within the row."""
    m = matrix(spark, sf).select("tensor", F.array_sort("vec").alias("s"))
    picks = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.struct(j.alias("j"), F.element_at("s", (F.floor((j + 0.5) * F.size("s") / 8) + 1).cast("int")).alias("v")))
    return m.select("tensor", F.explode(picks).alias("p")).select("tensor", "p.j", F.round(F.col("p.v").cast("double"), 6).alias("seed"))


@R.query("SELECT label, vec_id AS tensor, CAST(sum(len(embedding)) OVER (PARTITION BY label ORDER BY vec_id) - len(embedding) AS BIGINT) AS start_at FROM embeddings")
def win_global_offset(spark, sf):
    """Where each tensor begins in its file (the label): a running sum of sizes."""
    m = matrix(spark, sf).select("label", "tensor", F.size("vec").cast("long").alias("n"))
    return m.select("label", "tensor", (F.sum("n").over(Window.partitionBy("label").orderBy("tensor")) - F.col("n")).alias("start_at"))


@R.query("SELECT vec_id AS tensor, i // 32 AS block, count(*) AS n FROM (SELECT vec_id, unnest(range(64)) AS i FROM embeddings) GROUP BY ALL")
def win_block_carry(spark, sf):
    """Blocks across scan chunks: keyed by index, so that nothing is carried over."""
    return weights(matrix(spark, sf)).groupBy("tensor", F.floor(F.col("flat_index") / 32).alias("block")).agg(F.count("*").alias("n"))


@R.query(f"""WITH {W}, r AS (SELECT *, row_number() OVER (PARTITION BY tensor ORDER BY md5(CAST(tensor * 64 + flat_index AS VARCHAR)), flat_index) AS i, count(*) OVER (PARTITION BY tensor) AS n FROM w)
SELECT tensor, flat_index, i <= greatest(1, least(n - 1, CAST(round_even(n * 0.2, 0) AS BIGINT))) AS validation FROM r""")
def win_train_val_split(spark, sf):
    w = weights(matrix(spark, sf))
    place = F.row_number().over(Window.partitionBy("tensor").orderBy(F.md5((F.col("tensor") * 64 + F.col("flat_index")).cast("string")), "flat_index"))
    n = F.count("*").over(Window.partitionBy("tensor"))
    return w.select("tensor", "flat_index", (place <= F.greatest(F.lit(1), F.least(n - 1, F.rint(n * 0.2).cast("long")))).alias("validation"))


# Sampling.


@R.query(f"WITH {W}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(tensor * 64 + flat_index AS VARCHAR)), tensor, flat_index) AS i FROM w) SELECT label, tensor, flat_index FROM r WHERE i <= 100")
def smp_indices(spark, sf):
    """100 weights of each label without replacement, in hash order."""
    return _sampled(spark, sf).where("i <= 100").select("label", "tensor", "flat_index")


def _sampled(spark, sf, n=400):
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.md5((F.col("tensor") * 64 + F.col("flat_index")).cast("string")), "tensor", "flat_index"))
    return weights(matrix(spark, sf)).withColumn("i", place).where(F.col("i") <= n)


@R.query(f"WITH {W}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(tensor * 64 + flat_index AS VARCHAR)), tensor, flat_index) AS i FROM w) SELECT label, size, count(*) AS n, round(avg(CAST(value AS DOUBLE)), 6) AS mean FROM r, (SELECT unnest([50, 100, 200, 400]) AS size) WHERE i <= size GROUP BY ALL")
def smp_nested(spark, sf):
    """Nested samples: each is a prefix of the next in one hash order."""
    s = _sampled(spark, sf).withColumn("size", F.explode(F.filter(F.array(*(F.lit(n) for n in (50, 100, 200, 400))), lambda n: n >= F.col("i"))))
    return s.groupBy("label", "size").agg(F.count("*").alias("n"), F.round(F.avg(F.col("value").cast("double")), 6).alias("mean"))


@R.query(f"WITH {W}, r AS (SELECT label, count(*) AS numel, least(count(*), 100) AS n FROM w GROUP BY 1) SELECT label, n, round(numel / n, 6) AS weight FROM r")
def smp_weights(spark, sf):
    numel = weights(matrix(spark, sf)).groupBy("label").agg(F.count("*").alias("numel"))
    n = F.least("numel", F.lit(100).cast("long"))
    return numel.select("label", n.alias("n"), F.round(F.col("numel") / n, 6).alias("weight"))


@R.query("""WITH s AS (SELECT label, count(*) * 64 AS size FROM embeddings GROUP BY 1), b AS (SELECT *, least(size, 128) AS base FROM s), t AS (SELECT *, sum(size - base) OVER () AS cap, greatest(0, 5000 - sum(base) OVER ()) AS rest FROM b),
r AS (SELECT *, rest * (size - base) / CAST(cap AS DOUBLE) AS raw FROM t), f AS (SELECT *, row_number() OVER (ORDER BY raw - floor(raw) DESC, label) AS place, rest - sum(floor(raw)) OVER () AS left_over FROM r)
SELECT label, CAST(base + floor(raw) + CASE WHEN place <= left_over THEN 1 ELSE 0 END AS BIGINT) AS n FROM f""")
def smp_allocate(spark, sf):
    """Floors of 128 a stratum, the rest of a budget of 5000 by largest remainder over what is left of each."""
    from weftline.operators.sampling import allocate

    sizes = matrix(spark, sf).groupBy("label").agg((F.count("*") * 64).alias("size"))
    return allocate(sizes, "label", 5000, 128).select("label", "n")
