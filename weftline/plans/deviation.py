"""Queries of block quantisation: error metrics, thresholds, rankings, records and correction maps."""

from __future__ import annotations

from pyspark.sql import Window
import pyarrow as pa
from pyspark.sql import functions as F

from weftline.functions import numeric as N
from weftline.operators import blockquant as B
from weftline.operators import corrections as C
from weftline.operators import metrics as M
from weftline.plans.registry import Q4, W, Registry, bf16, fp16, metrics_sql
from weftline.sources.tables import eligible, matrix, table, weights

R = Registry()


def errors(spark, sf):
    return B.weight_errors(matrix(spark, sf))


@R.query(f"WITH {Q4} {metrics_sql('e', 'label', 'original', 'rebuilt')}")
def agg_error_metrics(spark, sf):
    return M.error_metrics(errors(spark, sf), ["label"], "original", "rebuilt")


for _name, _zero in {"null": "NULL", "zero": "0.0", "both": "CASE WHEN xx = 0 AND yy = 0 THEN 1.0 ELSE 0.0 END", "equal": "CASE WHEN se = 0 THEN 1.0 ELSE 0.0 END"}.items():
    # half the tensors rebuilt as zeros, so that the convention shows

    def _metrics(spark, sf, name=_name):
        e = errors(spark, sf).withColumn("rebuilt", F.when(F.col("tensor") % 2 == 0, F.col("rebuilt")).otherwise(F.lit(0.0).cast("float")))
        return M.error_metrics(e, ["tensor"], "original", "rebuilt", name)

    _metrics.__name__ = f"agg_error_metrics_{_name}"
    R.query(f"WITH {Q4}, z AS (SELECT tensor, original, CASE WHEN tensor % 2 = 0 THEN rebuilt ELSE CAST(0 AS FLOAT) END AS rebuilt FROM e) {metrics_sql('z', 'tensor', 'original', 'rebuilt', _zero)}")(_metrics)


@R.query(f"WITH {Q4} SELECT tensor, block, CAST(flat_index % 32 AS INTEGER) AS pos, code, round(CAST(stored AS DOUBLE), 9) AS scale FROM e")
def fn_q4_0_encode(spark, sf):
    cut = B.encode(matrix(spark, sf)).select("tensor", "block", F.posexplode("codes").alias("pos", "code"), "scale")
    return cut.select("tensor", "block", "pos", "code", F.round(N.fp16("scale").cast("double"), 9).alias("scale"))


@R.query(f"WITH {Q4} SELECT tensor, flat_index, round(CAST(rebuilt AS DOUBLE), 9) + 0.0 AS rebuilt FROM e")
def fn_q4_0_decode(spark, sf):
    return errors(spark, sf).select("tensor", "flat_index", (F.round(F.col("rebuilt").cast("double"), 9) + F.lit(0.0)).alias("rebuilt"))


@R.query(f"WITH {Q4} SELECT tensor, block, round(CAST(d AS DOUBLE) * -8, 6) AS signed_max FROM (SELECT DISTINCT tensor, block, d FROM e)")
def agg_block_absmax(spark, sf):
    return B.encode(matrix(spark, sf)).select("tensor", "block", F.round(F.col("scale").cast("double") * -8, 6).alias("signed_max"))


@R.query("SELECT vec_id AS tensor, CASE WHEN len(embedding) % 32 <> 0 THEN 'not a multiple of the block' END AS skip, CAST(len(embedding) AS INTEGER) AS n FROM embeddings")
def flt_q4_eligible(spark, sf):
    return eligible(matrix(spark, sf)).select("tensor", "skip", F.size("vec").alias("n"))


@R.query(f"WITH {Q4} SELECT tensor, flat_index, round(CAST(abs_error AS DOUBLE), 6) AS abs_error FROM e WHERE abs_error > 0.02")
def flt_threshold(spark, sf):
    return errors(spark, sf).where("abs_error > 0.02").select("tensor", "flat_index", F.round(F.col("abs_error").cast("double"), 6).alias("abs_error"))


_RECORD = """SELECT tensor, flat_index, '[' || (flat_index // 64) || ',' || (flat_index % 64) || ']' AS coordinates, flat_index // 32 AS block_index, flat_index % 32 AS position_in_block,
  round(CAST(original AS DOUBLE), 6) AS original, round(CAST(rebuilt AS DOUBLE), 6) + 0.0 AS rebuilt, round(CAST(error AS DOUBLE), 6) + 0.0 AS delta, round(CAST(abs_error AS DOUBLE), 6) AS absolute_error,
  round(CASE WHEN original <> 0 THEN CAST(abs_error AS DOUBLE) / abs(CAST(original AS DOUBLE)) * 100 END, 4) AS relative_error_percent,
  round(CASE WHEN step <> 0 THEN CAST(abs_error AS DOUBLE) / CAST(step AS DOUBLE) ELSE 0 END, 4) AS error_in_steps"""


@R.query(f"WITH {Q4} {_RECORD} FROM e")
def prj_weight_record(spark, sf):
    return B.records(errors(spark, sf), 64)


@R.query(f"WITH {W} SELECT tensor, flat_index, '[' || (flat_index // 16) || ',' || (flat_index % 16) || ']' AS coordinates FROM w")
def prj_coords(spark, sf):
    w = weights(matrix(spark, sf))
    return w.select("tensor", "flat_index", F.concat(F.lit("["), F.floor(F.col("flat_index") / 16).cast("string"), F.lit(","), F.pmod("flat_index", F.lit(16)).cast("string"), F.lit("]")).alias("coordinates"))


@R.query(f"""WITH {Q4}, b AS (
  SELECT tensor, block, count(*) FILTER (abs_error > 0.02) AS n_over, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (abs_error > 0.02) AS positions,
         CAST(arg_max(pos, {{'a': abs_error, 'p': -flat_index}}) AS INTEGER) AS worst, round(CAST(max(abs_error) AS DOUBLE), 6) AS max_error FROM e GROUP BY ALL)
SELECT * FROM b WHERE n_over > 0""")
def agg_block_over(spark, sf):
    return B.over_by_block(errors(spark, sf), 0.02)


@R.query(f"WITH {Q4} SELECT tensor, count(*) FILTER (abs_error > 0.03) AS weights_over, count(DISTINCT block) FILTER (abs_error > 0.03) AS blocks_over FROM e GROUP BY 1")
def agg_tensor_over(spark, sf):
    return B.over_by_tensor(errors(spark, sf), 0.03)


def _round(df, *names):
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


@R.query(f"""WITH {Q4}, t AS (SELECT tensor, arg_max({{'f': flat_index, 'o': original, 'r': rebuilt, 'a': abs_error}}, {{'a': abs_error, 'p': -flat_index}}) AS w FROM e GROUP BY 1)
SELECT tensor, w.f AS flat_index, round(CAST(w.o AS DOUBLE), 6) AS original, round(CAST(w.r AS DOUBLE), 6) AS rebuilt, round(CAST(w.a AS DOUBLE), 6) AS abs_error FROM t""")
def top1_per_tensor(spark, sf):
    return _round(B.worst_per_tensor(errors(spark, sf)), "original", "rebuilt", "abs_error")


_TOP = "SELECT tensor, flat_index, round(CAST(abs_error AS DOUBLE), 6) AS abs_error FROM e {} ORDER BY e.abs_error DESC, tensor, flat_index LIMIT {}"


@R.query(f"WITH {Q4} {_TOP.format('', 100)}")
def top_global_weights(spark, sf):
    return _round(B.top_weights(errors(spark, sf), 100).select("tensor", "flat_index", "abs_error"), "abs_error")


@R.query(f"WITH {Q4} {_TOP.format('WHERE e.abs_error > 0', 50)}")
def top_global_weights_nz(spark, sf):
    return _round(B.top_weights(errors(spark, sf), 50, nonzero=True).select("tensor", "flat_index", "abs_error"), "abs_error")


@R.query(f"WITH {Q4}, b AS (SELECT tensor, block, max(abs_error) AS worst, sum(CAST(abs_error AS DOUBLE)) AS total FROM e GROUP BY ALL) SELECT tensor, block, round(CAST(worst AS DOUBLE), 6) AS worst, round(total, 6) AS total FROM b ORDER BY b.worst DESC, tensor, block LIMIT 40")
def top_blocks(spark, sf):
    return _round(B.top_blocks(errors(spark, sf), 40), "worst", "total")


@R.query(f"WITH {Q4} SELECT tensor, max(abs_error) > 0.03 AS hit, count(*) FILTER (abs_error > 0.03) AS n_over, round(CAST(max(abs_error) AS DOUBLE), 6) AS max_error, row_number() OVER (ORDER BY count(*) FILTER (abs_error > 0.03) DESC, max(abs_error) DESC, tensor) AS place FROM e GROUP BY tensor ORDER BY place LIMIT 200")
def srt_tensor_err(spark, sf):
    g = errors(spark, sf).groupBy("tensor").agg(F.count_if(F.col("abs_error") > 0.03).alias("n_over"), F.max("abs_error").alias("m"))
    top = g.orderBy(F.desc("n_over"), F.desc("m"), "tensor").limit(200)
    place = F.row_number().over(Window.orderBy(F.desc("n_over"), F.desc("m"), "tensor")).cast("long")
    return top.select("tensor", (F.col("n_over") > 0).alias("hit"), "n_over", F.round(F.col("m").cast("double"), 6).alias("max_error"), place.alias("place"))


@R.query(f"WITH {Q4}, t AS (SELECT * FROM e ORDER BY abs_error DESC, tensor, flat_index LIMIT 60) SELECT row_number() OVER (ORDER BY abs_error DESC, tensor, flat_index) AS place, tensor, flat_index FROM t")
def win_csv_rank(spark, sf):
    top = B.top_weights(errors(spark, sf), 60)  # ranked after the limit: 60 rows
    return top.select(F.row_number().over(Window.orderBy(F.desc("abs_error"), "tensor", "flat_index")).cast("long").alias("place"), "tensor", "flat_index")


# Metrics with thresholds, three-way rollup, merged moments.


@R.query(f"WITH {Q4} SELECT label, count(*) AS n, count(*) FILTER (error <> 0) AS nonzero, count(*) FILTER (abs_error > CAST(0.01 AS DOUBLE)) AS over_0p01, count(*) FILTER (abs_error > CAST(0.02 AS DOUBLE)) AS over_0p02, count(*) FILTER (abs_error > CAST(0.04 AS DOUBLE)) AS over_0p04, round(sqrt(avg(pow(CAST(original AS DOUBLE) - CAST(rebuilt AS DOUBLE), 2))), 6) AS rmse FROM e GROUP BY 1")
def agg_metrics_add_finish(spark, sf):
    e = errors(spark, sf)
    d = F.col("original").cast("double") - F.col("rebuilt").cast("double")
    counts = M.threshold_counts(F.col("error").cast("double"), [0.01, 0.02, 0.04])
    return e.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("error") != 0).alias("nonzero"), *counts, F.round(F.sqrt(F.avg(d * d)), 6).alias("rmse"))


@R.query(f"""WITH {Q4}, s AS (SELECT CASE WHEN label < 5 THEN 'quantised' ELSE 'unquantised' END AS part, original, CASE WHEN label < 5 THEN rebuilt ELSE original END AS rebuilt FROM e),
u AS (SELECT 'overall' AS part, original, rebuilt FROM s UNION ALL SELECT * FROM s) {metrics_sql('u', 'part', 'original', 'rebuilt')}""")
def agg_three_way_rollup(spark, sf):
    e = errors(spark, sf).withColumn("part", F.when(F.col("label") < 5, "quantised").otherwise("unquantised"))
    e = e.withColumn("rebuilt", F.when(F.col("label") < 5, F.col("rebuilt")).otherwise(F.col("original")))
    sums = [v.alias(k) for k, v in M.sums(F.col("original"), F.col("rebuilt")).items()]
    rolled = e.rollup("part").agg(*sums).withColumn("part", F.coalesce("part", F.lit("overall")))
    return M.finish(rolled, ["part"])


@R.query(f"WITH {Q4} {metrics_sql('e', '', 'original', 'rebuilt')}")
def agg_mergeable_metrics(spark, sf):
    """Metrics of all weights from the partial sums of each label: the sums merge."""
    parts = errors(spark, sf).groupBy("label").agg(*(v.alias(k) for k, v in M.sums(F.col("original"), F.col("rebuilt")).items()))
    merged = parts.agg(*((F.max(k) if k == "me" else F.sum(k)).alias(k) for k in ("n", "se", "ae", "me", "xx", "yy", "xy", "sx")))
    return M.finish(merged, [])


# Correction maps.

THRESHOLDS = (0.005, 0.01, 0.02, 0.04)
_MAP = f"""{Q4}, t AS (SELECT unnest([0.005, 0.01, 0.02, 0.04]) AS threshold),
k AS (SELECT threshold, tensor, flat_index, block, {fp16("CAST(original - rebuilt AS FLOAT)")} AS residual FROM e JOIN t ON CAST(abs_error AS DOUBLE) > threshold),
g AS (SELECT *, tensor * 64 + flat_index AS global_index FROM k)"""


@R.query(f"WITH {_MAP} SELECT threshold, tensor, flat_index, round(CAST(residual AS DOUBLE), 6) AS residual FROM k")
def jn_pos_compare(spark, sf):
    return _round(C.corrections(errors(spark, sf), THRESHOLDS).select("threshold", "tensor", "flat_index", "residual"), "residual")


@R.query(f"WITH {_MAP} SELECT threshold, tensor, flat_index, flat_index - lag(flat_index, 1, -1) OVER (PARTITION BY threshold, tensor ORDER BY flat_index) AS delta FROM k")
def win_index_delta(spark, sf):
    return C.deltas(C.corrections(errors(spark, sf), THRESHOLDS)).select("threshold", "tensor", "flat_index", "delta")


_LEN = "(1 + " + " + ".join(f"CAST(delta >= {1 << 7 * k} AS INTEGER)" for k in range(1, 9)) + ")"


@R.query(f"""WITH {_MAP}, d AS (SELECT *, flat_index - lag(flat_index, 1, -1) OVER (PARTITION BY threshold, tensor ORDER BY flat_index) AS delta FROM k)
SELECT threshold, tensor, flat_index, {_LEN} + 2 AS bytes, CAST(sum({_LEN} + 2) OVER (PARTITION BY threshold, tensor ORDER BY flat_index) - ({_LEN} + 2) AS BIGINT) AS start_at FROM d""")
def win_record_offset(spark, sf):
    d = C.deltas(C.corrections(errors(spark, sf), THRESHOLDS)).withColumn("bytes", N.varint_length(F.col("delta")) + 2)
    w = Window.partitionBy("threshold", "tensor").orderBy("flat_index")
    return d.select("threshold", "tensor", "flat_index", "bytes", (F.sum("bytes").over(w) - F.col("bytes")).alias("start_at"))


@R.query(f"""WITH {_MAP}, d AS (SELECT *, flat_index - lag(flat_index, 1, -1) OVER (PARTITION BY threshold, tensor ORDER BY flat_index) AS delta FROM k),
s AS (SELECT threshold, tensor, sum(delta) OVER (PARTITION BY threshold, tensor ORDER BY flat_index) - 1 AS decoded, flat_index FROM d)
SELECT threshold, tensor, CAST(decoded AS BIGINT) AS decoded, decoded = flat_index AS same FROM s""")
def win_delta_decode(spark, sf):
    d = C.deltas(C.corrections(errors(spark, sf), THRESHOLDS))
    return C.undelta(d).select("threshold", "tensor", "decoded", (F.col("decoded") == F.col("flat_index")).alias("same"))


@R.query(f"""WITH {_MAP}, d AS (SELECT *, global_index - lag(global_index, 1, -1) OVER (PARTITION BY threshold ORDER BY global_index) AS delta FROM g)
SELECT threshold, tensor, flat_index, delta, {_LEN} AS index_bytes FROM d""")
def snk_corr_map_global(spark, sf):
    """Deltas over the index of all weights: each tensor's first delta follows from the last hit of an earlier tensor."""
    d = C.global_deltas(C.corrections(errors(spark, sf), THRESHOLDS), F.col("tensor") * 64)
    return d.select("threshold", "tensor", "flat_index", "delta", N.varint_length(F.col("delta")).alias("index_bytes"))


@R.query(f"""WITH {_MAP}, d AS (SELECT *, flat_index - lag(flat_index, 1, -1) OVER (PARTITION BY threshold, tensor ORDER BY flat_index) AS delta FROM k)
SELECT threshold, tensor, count(*) AS n, CAST(sum({_LEN} + 2) AS BIGINT) AS map_bytes FROM d GROUP BY ALL""")
def snk_corr_map_local(spark, sf):
    return C.encoded_maps(C.corrections(errors(spark, sf), THRESHOLDS)).select("threshold", "tensor", "n", F.octet_length("payload").cast("long").alias("map_bytes"))


@R.query(f"WITH {_MAP} SELECT threshold, tensor, flat_index, round(CAST(residual AS DOUBLE), 6) AS residual FROM k")
def src_corr_map(spark, sf):
    """Maps written as bytes and read back."""
    found = C.decoded_maps(C.encoded_maps(C.corrections(errors(spark, sf), THRESHOLDS)))
    return _round(found.select("threshold", "tensor", "flat_index", "residual"), "residual")


@R.query(f"""WITH {_MAP}, a AS (SELECT t.threshold, e.tensor, e.block, e.flat_index, CAST(original AS DOUBLE) AS o, CAST(e.error AS DOUBLE) AS e0, abs(CAST(e.abs_error AS DOUBLE)) > t.threshold AS hit,
  CASE WHEN CAST(abs_error AS DOUBLE) > t.threshold THEN CAST(rebuilt AS DOUBLE) + CAST({fp16("CAST(original - rebuilt AS FLOAT)")} AS DOUBLE) ELSE CAST(rebuilt AS DOUBLE) END AS y FROM e, t)
SELECT threshold, count(*) FILTER (hit) AS corrections, count(DISTINCT tensor * 1000 + block) FILTER (hit) AS blocks, count(DISTINCT tensor) FILTER (hit) AS tensors,
  round(max(abs(e0)), 6) AS max_before, round(max(abs(o - y)), 6) AS max_after, round(avg(abs(o - y)), 6) AS mae_after, round(sqrt(avg((o - y) * (o - y))), 6) AS rmse_after,
  count(*) FILTER (abs(o - y) > threshold) AS still_over FROM a GROUP BY 1""")
def agg_map_stats(spark, sf):
    return C.map_stats(errors(spark, sf), THRESHOLDS)


@R.query(f"""WITH {_MAP} SELECT threshold, count(DISTINCT tensor) AS tensors, count(DISTINCT tensor * 1000 + block) AS blocks FROM k GROUP BY 1""")
def set_distinct_affected(spark, sf):
    k = C.corrections(errors(spark, sf), THRESHOLDS)
    return k.groupBy("threshold").agg(F.count_distinct("tensor").alias("tensors"), F.count_distinct("tensor", "block").alias("blocks"))


@R.query(f"""WITH {_MAP}, x AS (SELECT vec_id AS token, unnest(range(64)) AS col, unnest(embedding) AS v FROM embeddings)
SELECT k.tensor AS row_id, x.token, round(sum(CAST(residual AS DOUBLE) * CAST(x.v AS DOUBLE)), 6) + 0.0 AS y FROM k JOIN x ON k.flat_index = x.col WHERE threshold = 0.02 GROUP BY ALL""")
def jn_sparse_matvec(spark, sf):
    k = C.corrections(errors(spark, sf), [0.02]).select(F.col("tensor").alias("row_id"), F.col("flat_index").alias("col"), "residual")
    x = weights(matrix(spark, sf)).select(F.col("tensor").alias("token"), F.col("flat_index").alias("col"), "value")
    return C.sparse_matvec(k, x, 6).select("row_id", "token", (F.col("y") + F.lit(0.0)).alias("y"))


@R.query(f"WITH {W} SELECT tensor, flat_index, round(CAST({bf16('value')} AS DOUBLE), 9) AS bf16, round(CAST({fp16('value')} AS DOUBLE), 9) AS fp16 FROM w")
def prj_dtype_cast(spark, sf):
    return weights(matrix(spark, sf)).select("tensor", "flat_index", *(F.round(f("value").cast("double"), 9).alias(n) for n, f in (("bf16", N.bf16), ("fp16", N.fp16))))


_KEYS = "SELECT event_id, unnest([CAST(event_id AS BIGINT), event_id * 97, event_id * 1048583, event_id * 68719476767]) AS delta FROM events"


@R.query(f"SELECT event_id, delta, {_LEN} AS bytes FROM ({_KEYS})")
def fn_uvarint_write(spark, sf):
    i = F.col("event_id")
    d = table(spark, sf, "events").select("event_id", F.explode(F.array(i, i * 97, i * 1048583, i * 68719476767)).alias("delta"))
    return d.select("event_id", "delta", N.varint_length(F.col("delta")).alias("bytes"))


@R.query(f"SELECT event_id, delta, delta AS back FROM ({_KEYS})")
def fn_uvarint_read(spark, sf):
    """Variable-length numbers written and read again."""

    def run(batches):
        for batch in batches:
            coded = C.leb128(batch.column(1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([C.read_leb128(b, 0)[0] for b in coded], pa.int64())], ["event_id", "delta", "back"])

    i = F.col("event_id").cast("long")
    d = table(spark, sf, "events").select(i.alias("event_id"), F.explode(F.array(i, i * 97, i * 1048583, i * 68719476767)).alias("delta"))
    return d.mapInArrow(run, "event_id long, delta long, back long")
