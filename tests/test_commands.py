"""Each job of the command line on the smallest tables and on a Safetensors file."""

import json
import struct

import numpy as np
import pytest

from weftline import commands


@pytest.mark.parametrize("job", sorted(commands.JOBS))
def test_job(job, spark, data, tmp_path):
    commands.main([job, "--input", f"{data}/embeddings.parquet", "--output", str(tmp_path), "--groups", "4", "--steps", "1", "--least", "0.3", "--preserve", "32"])
    a = commands.options([job, "--input", "x", "--output", "y"])
    names = set(commands.JOBS[job](commands.tensors(spark, f"{data}/embeddings.parquet", 64), a))
    assert {p.name for p in tmp_path.iterdir()} == names
    assert all(spark.read.parquet(str(p)).columns for p in tmp_path.iterdir())


def test_tensors_of_a_file(spark, tmp_path):
    x = np.random.default_rng(1).normal(0, 0.02, 200).astype("<f4")
    entries = {"model.layers.3.w": {"dtype": "F32", "shape": [2, 64], "data_offsets": [0, 512]}, "norm": {"dtype": "F32", "shape": [72], "data_offsets": [512, 800]}}
    head = json.dumps(entries).encode()
    (tmp_path / "m.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + x.tobytes())
    rows = commands.tensors(spark, str(tmp_path), 64).collect()
    assert sorted((r.name, r.label, len(r.vec)) for r in rows) == [("model.layers.3.w", 3, 64)] * 2 + [("norm", -1, 8), ("norm", -1, 64)]
    commands.main(["deviation", "--input", str(tmp_path), "--output", str(tmp_path / "out"), "--format", "json", "--row", "64"])
    assert spark.read.json(str(tmp_path / "out" / "metrics")).count() == 2


def test_lists_of_numbers():
    assert commands.numbers("3, 1,1") == [1.0, 3.0]
    with pytest.raises(ValueError):
        commands.numbers("0,1")
