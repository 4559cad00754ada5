"""Properties of quantisers, codecs and fits on small fixtures."""

import json
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import numeric as N
from weftline.functions import packing
from weftline.operators import blockquant, codebook, codec, corrections, pairs, predictive, profile, sampling, spectral
from weftline.sources import safetensors


def vectors(spark, rows, label=0):
    return spark.createDataFrame([(i, label, [float(np.float32(x)) for x in r]) for i, r in enumerate(rows)], "tensor long, label int, vec array<float>")


@given(st.integers(0, 10), st.integers(0, 200), st.randoms())
@settings(max_examples=50, deadline=None)
def test_bit_planes_round_trip(bits, n, rnd):
    x = np.array([rnd.randrange(1 << bits) for _ in range(n)], np.uint32)
    data = packing.pack_planes(x, bits)
    assert len(data) == bits * ((n + 7) // 8)
    assert (packing.unpack_planes(data, n, bits) == x).all()


def test_nibbles_with_odd_count():
    x = np.array([0, 15, 7, 2, 9], np.uint8)
    assert (packing.unpack_nibbles(packing.pack_nibbles(x), 5) == x).all()


def test_inflate_is_bounded_and_strict():
    import zlib

    raw = bytes(range(256)) * 100
    data = zlib.compress(raw, 9)
    pieces = list(packing.inflate(data, 1000))
    assert b"".join(pieces) == raw and max(map(len, pieces)) <= 1000
    with pytest.raises(ValueError):
        list(packing.inflate(data[:-5]))


@given(st.lists(st.integers(0, (1 << 62) - 1), min_size=1, max_size=30))
@settings(max_examples=50, deadline=None)
def test_leb128_round_trip(numbers):
    data, at, back = b"".join(corrections.leb128(np.array(numbers))), 0, []
    while at < len(data):
        n, at = corrections.read_leb128(data, at)
        back.append(n)
    assert back == numbers
    with pytest.raises(ValueError):
        corrections.read_leb128(b"\x80", 0)


def test_half_precision_rounding(spark):
    x = np.concatenate([np.random.default_rng(1).normal(0, 3, 2000), [0, 65519, 65520, -70000, 6e-8, 5.9e-8, 1e-9]]).astype(np.float32)
    got = spark.createDataFrame([(float(v),) for v in x], "x float").select(N.fp16("x").alias("y")).toPandas()["y"].to_numpy()
    with np.errstate(over="ignore"):
        assert np.array_equal(got.astype(np.float32), x.astype(np.float16).astype(np.float32))


def q4(x):
    out = np.zeros_like(x)
    for i in range(0, len(x), 32):
        b = x[i : i + 32]
        d = np.float32(b[np.argmax(np.abs(b))] / np.float32(-8))
        inv = np.float32(1) / d if d else np.float32(0)
        codes = np.clip(np.floor(b * inv + np.float32(8.5)), 0, 15)
        out[i : i + 32] = (codes - 8).astype(np.float32) * np.float32(np.float16(d))
    return out


def test_block_quantiser_equals_numpy(spark):
    x = np.random.default_rng(2).normal(0, 0.02, (20, 64)).astype(np.float32)
    x[3, :32] = 0
    x[4, 1] = -x[4, 0]
    got = blockquant.weight_errors(vectors(spark, x)).orderBy("tensor", "flat_index").toPandas()
    assert np.array_equal(got["rebuilt"].to_numpy().astype(np.float32), np.concatenate([q4(r) for r in x]))


def test_ragged_rows_are_skipped(spark):
    df = spark.createDataFrame([(0, 0, [1.0] * 33), (1, 0, []), (2, 0, None), (3, 0, [1.0] * 32)], "tensor long, label int, vec array<float>")
    assert {r.tensor for r in blockquant.encode(df).select("tensor").distinct().collect()} == {3}


def test_corrections_bring_errors_below_the_threshold(spark):
    x = np.random.default_rng(3).normal(0, 0.05, (10, 64)).astype(np.float32)
    e = blockquant.weight_errors(vectors(spark, x))
    stats = {r.threshold: r for r in corrections.map_stats(e, [0.001, 0.01]).collect()}
    assert stats[0.001].corrections > stats[0.01].corrections > 0
    assert all(r.still_over == 0 for r in stats.values())
    found = corrections.corrections(e, [0.001])
    back = corrections.decoded_maps(corrections.encoded_maps(found))
    key = ["threshold", "tensor", "flat_index", "residual"]
    assert sorted(map(tuple, back.select(key).collect())) == sorted(map(tuple, found.select(key).collect()))


def test_uniform_error_is_half_a_step(spark):
    x = np.linspace(-1, 2, 1001)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").withColumn("y", N.uniform_value(N.uniform_code(F.col("x"), F.lit(-1.0), F.lit(2.0), 64), F.lit(-1.0), F.lit(2.0), 64))
    assert df.select(F.max(F.abs(F.col("x") - F.col("y")))).first()[0] <= 3 / 63 / 2 + 1e-9


def test_kmeans_finds_three_modes(spark):
    rng = np.random.default_rng(456)
    x = np.concatenate([rng.normal(-2, 0.12, 500), rng.normal(0.3, 0.08, 300), rng.normal(3.5, 0.2, 200)])
    df = spark.createDataFrame([(0, float(v)) for v in x], "label int, value double")
    values = codebook.counted(df, ["label"])
    centres = np.array(codebook.fit_kmeans(values, "label", 16).first()["centres"])
    nearest = centres[np.abs(x[:, None] - centres[None, :]).argmin(axis=1)]
    assert np.sqrt(((x - nearest) ** 2).mean()) < 0.1 * x.std()
    assert (np.diff(centres) > 0).all()


def test_kmeans_with_fewer_values_than_centres():
    assert codebook.weighted_kmeans(np.array([1.0, 2.0]), np.ones(2), 8).tolist() == [1.0, 2.0]
    assert codebook.weighted_kmeans(np.array([1.0, 4.0]), np.array([3.0, 1.0]), 1).tolist() == [1.75]


def test_value_on_a_midpoint_goes_up(spark):
    row = spark.range(1).select(N.nearest_code(F.lit(1.5), N.midpoints(F.array(F.lit(1.0), F.lit(2.0)))).alias("c")).first()
    assert row.c == 1


def test_profile_counts_non_finite_values(spark):
    df = spark.createDataFrame([(0, v) for v in (0.0, 1.0, float("nan"), float("inf"), None)], "t int, value double")
    r = profile.tensor_profile(df, ["t"]).first()
    assert (r.numel, r.finite, r.nonfinite, r.zeros, r.min, r.max, r.mean) == (5, 2, 3, 1, 0.0, 1.0, 0.5)


def test_skewed_symbols_have_low_entropy(spark):
    df = spark.createDataFrame([(0, 0)] * 900 + [(0, 1)] * 100, "t int, code int")
    r = profile.entropy(profile.histogram(df, ["t"]), ["t"]).first()
    assert r.entropy < 1 and r.used == 2


def test_allocation_keeps_to_budget_and_floors(spark):
    sizes = spark.createDataFrame([(i, n) for i, n in enumerate([5, 100, 1000, 37])], "k int, size long")
    got = {r.k: r.n for r in sampling.allocate(sizes, "k", 300, 20).collect()}
    assert sum(got.values()) == 300 and got[0] == 5 and all(n >= 20 for k, n in got.items() if k)
    tight = {r.k: r.n for r in sampling.allocate(sizes, "k", 10, 20).collect()}
    assert sum(tight.values()) == 10


def test_joint_sign_flip_is_one_pair(spark):
    rng = np.random.default_rng(5)
    g, u, d = rng.normal(size=(3, 3, 8))
    g[1], u[1], d[1] = g[0], -u[0], -d[0]
    df = spark.createDataFrame([(i, g[i].tolist(), u[i].tolist(), d[i].tolist()) for i in range(3)], "id long, gate array<double>, up array<double>, down array<double>")
    found = pairs.cosine_pairs(df, ["gate", "up", "down"], 0.99, ("up", "down")).collect()
    assert [(r.a, r.b) for r in found] == [(0, 1)]


def test_blocks_of_pairs_cover_everything(spark):
    x = np.random.default_rng(6).normal(size=(40, 5))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    assert pairs.cosine_pairs(df, ["v"], 0.0, size=7).count() == 40 * 39 // 2


def test_merge_of_proportional_traces(spark):
    a = np.arange(1.0, 65)
    acts = spark.createDataFrame([(t, n, float(v)) for t in range(64) for n, v in enumerate([a[t], 2 * a[t], np.sin(1.731 * t)])], "token long, neuron long, value double")
    found = pairs.traces(acts)
    down = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, -1.0]), (2, [1.0, 1.0])], "id long, vec array<double>")
    r = pairs.merge_errors(pairs.correlations(found), found, down, 1.0).where("a = 0 and b = 1").first()
    assert abs(r["corr"] - 1) < 1e-9 and abs(r.alpha - 0.5) < 1e-12 and r.pair_error < 1e-6


def test_predicted_map_is_lossless(spark):
    codes = np.tile([0, 1, 2, 3, 3, 2, 1, 0], (20, 1))
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(codes)], "row_id long, codes array<int>")
    cells = predictive.contexts(rows, 4)
    table = predictive.predictor(cells, 4)
    found = predictive.residuals(cells, table, 4)
    lookup = [r.predicted for r in table.orderBy("ctx").collect()]
    back = np.zeros_like(codes)
    for r in predictive.decode(found, lookup, 4).collect():
        back[r.row_id, r.col] = r.code
    assert (back == codes).all()
    assert found.select(F.avg((F.col("residual") == 0).cast("double"))).first()[0] > 0.9


def test_linear_blocks_are_fitted_exactly(spark):
    t = np.linspace(-1, 1, 64)
    x = np.concatenate([i * 0.05 + (i + 1) * 0.01 * t for i in range(4)])
    from weftline.sources.tables import blocks

    got = spectral.polynomial_blocks(blocks(vectors(spark, [x]), 64), 64, 1).select(F.explode(F.arrays_zip("x", "y")).alias("z")).toPandas()
    assert max(abs(z["x"] - z["y"]) for z in got["z"]) < 1e-3


def test_low_frequencies_rebuild_a_smooth_matrix(spark):
    r, c = np.meshgrid(np.arange(32), np.arange(40), indexing="ij")
    x = 0.3 * np.sin(2 * np.pi * r / 32) + 0.2 * np.cos(2 * np.pi * 3 * c / 40) + 0.1 * np.sin(2 * np.pi * (2 * r / 32 + c / 40))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, vec array<double>")
    found = [tuple(s) for s in spectral.fourier(rows, 32, 40, 4).select("row_freq", "col_freq", "re", "im").collect()]
    assert len(found) == 9 * 5
    got = np.array([s.y for s in spectral.fourier_values(rows, found, 32, 40).orderBy("row_id").collect()])
    assert np.sqrt(((got - x) ** 2).mean()) < 1e-6


def test_low_rank_matrix_is_rebuilt(spark):
    rng = np.random.default_rng(123)
    x = rng.normal(size=(64, 4)) @ rng.normal(size=(48, 4)).T
    left, s, right = spectral.low_rank(vectors(spark, x), 48, 4)
    got = np.array([r.y for r in spectral.low_rank_values(left, right).orderBy("tensor").collect()])
    assert np.linalg.norm(got - x) / np.linalg.norm(x) < 0.01
    assert np.allclose(s, np.linalg.svd(x.astype(np.float32))[1][:4], rtol=1e-3)


def test_codec_round_trip_and_damage(spark):
    rng = np.random.default_rng(9)
    rows = [("F32", rng.normal(0, 0.02, 200)), ("I32", np.arange(50.0)), ("F32", np.zeros(80)), ("F32", rng.normal(size=10))]
    df = spark.createDataFrame([(i, d, [float(np.float32(x)) for x in v]) for i, (d, v) in enumerate(rows)], "tensor long, dtype string, vec array<float>")
    archive = codec.compress(codec.parameters(codec.plan(df, 32))).cache()
    kinds = {r.tensor: r.kind for r in archive.collect()}
    assert kinds == {0: "log", 1: "raw", 2: "log", 3: "raw"}
    assert codec.verify(archive).where("not ok").count() == 0
    back = {r.tensor: np.array(r.vec) for r in codec.decompress(archive).collect()}
    assert np.array_equal(back[1], np.arange(50.0)) and np.abs(back[0] - rows[0][1]).max() < 0.03 and not back[2].any()
    damaged = archive.withColumn("sha256", F.when(F.col("tensor") == 1, "0").otherwise(F.col("sha256")))
    assert [r.tensor for r in codec.verify(damaged).where("not ok").collect()] == [1]


def test_log_codec_rejects_nan(spark):
    df = spark.createDataFrame([(0, "F32", [float("nan")] * 40)], "tensor long, dtype string, vec array<float>")
    with pytest.raises(Exception, match="not finite"):
        codec.compress(codec.parameters(codec.plan(df, 32))).collect()


def test_shards_begin_where_the_limit_would_pass(spark):
    m = spark.createDataFrame([(i, b) for i, b in enumerate([50, 60, 10, 200, 5])], "place long, bytes long")
    got = [r.shard for r in codec.shards(m, 100).orderBy("place").collect()]
    assert got == [1, 2, 2, 3, 4]
    assert {r.file for r in codec.shard_names(codec.shards(m, 10_000)).collect()} == {"model.safetensors"}


def hand_made(path, entries, payload):
    head = json.dumps(entries).encode()
    path.write_bytes(struct.pack("<Q", len(head)) + head + payload)


def test_safetensors_types_and_scalars(spark, tmp_path):
    x = np.array([1.5, -2.25, 0.0, 3.0], np.float32)
    bf = (x.view(np.uint32) >> 16).astype("<u2").tobytes()
    entries = {
        "__metadata__": {"a": "b"}, "b": {"dtype": "BF16", "shape": [2, 2], "data_offsets": [0, 8]}, "i": {"dtype": "I64", "shape": [2], "data_offsets": [8, 24]},
        "s": {"dtype": "F32", "shape": [], "data_offsets": [24, 28]}, "z": {"dtype": "F32", "shape": [0, 3], "data_offsets": [28, 28]},
    }
    hand_made(tmp_path / "m.safetensors", entries, bf + np.array([1, 1 << 40], "<i8").tobytes() + np.float32(7).tobytes())
    found = {r.tensor: r for r in safetensors.inventory(spark, str(tmp_path)).collect()}
    assert {n: (r.dtype, r.numel, r.bytes) for n, r in found.items()} == {"b": ("BF16", 4, 8), "i": ("I64", 2, 16), "s": ("F32", 1, 4), "z": ("F32", 0, 0)}
    values = {(r.tensor, r.flat_offset): r["values"] for r in safetensors.read(spark, str(tmp_path), 3).collect()}
    assert values == {("b", 0): [1.5, -2.25, 0.0], ("b", 3): [3.0], ("i", 0): [1.0, float(1 << 40)], ("s", 0): [7.0]}


def test_safetensors_filter_and_errors(spark, tmp_path):
    safetensors.register(spark)
    rows = spark.createDataFrame([(f"t{i}", [2, 3], [float(i)] * 6) for i in range(8)], "tensor string, shape array<bigint>, values array<double>")
    rows.repartition(3).write.format("safetensors").mode("append").option("path", str(tmp_path / "out")).save()
    got = safetensors.read(spark, str(tmp_path / "out")).where("tensor = 't5'").collect()
    assert [(r.tensor, r["values"]) for r in got] == [("t5", [5.0] * 6)]
    with pytest.raises(Exception, match="no safetensors file"):
        safetensors.resolve(str(tmp_path / "none"))
    (tmp_path / "bad.safetensors").write_bytes(struct.pack("<Q", 0))
    with pytest.raises(ValueError):
        safetensors.header(str(tmp_path / "bad.safetensors"))


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_smallest_codec_equals_a_plain_loop(spark):
    import zlib

    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=40) if i % 3 else np.repeat(rng.normal(size=4), 10).astype(np.float16)).astype(np.float32).tolist(), 0.5, 2.0) for i in range(30)]
    df = spark.createDataFrame(rows, "tensor long, vec array<float>, scale double, zmax double")
    got = {r.tensor: (r.codec, r.bytes) for r in codec.smallest(codec.candidates(df)).collect()}
    for i, vec, scale, zmax in rows:
        x = np.array(vec, np.float32)
        z = np.clip(np.rint((np.sign(x.astype(float)) * np.log1p(np.abs(x.astype(float)) / scale) / zmax + 1) * 127.5), 0, 255).astype(np.uint8)
        forms = {"log": z.tobytes(), "fp16": x.astype("<f2").tobytes(), "planes": bytes(b for p in range(4) for b in x.tobytes()[p::4]), "raw": x.tobytes()}
        sizes = {k: len(zlib.compress(v, 9)) for k, v in forms.items()}
        assert got[i] == min(((k, n) for k, n in sizes.items()), key=lambda t: t[1])
