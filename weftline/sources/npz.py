"""NPZ artefacts as binary columns: ``spark.read.format("binaryFile").load(path)`` gives ``content`` to decode."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def encode(rows: DataFrame) -> DataFrame:
    """Rows (tensor, content) of (tensor, vec, metadata JSON): each an NPZ archive of its values and metadata."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                data = io.BytesIO()
                meta = np.frombuffer(batch.column(2)[i].as_py().encode(), np.uint8)
                np.savez_compressed(data, values=batch.column(1)[i].values.to_numpy(zero_copy_only=False).astype(np.float32), metadata=meta)
                out.append(data.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["tensor", "content"])

    return rows.select("tensor", "vec", "metadata").mapInArrow(run, "tensor long, content binary")


def decode(files: DataFrame, key: str) -> DataFrame:
    """Rows (key, vec, metadata) of (key, content); objects are never unpickled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, metas = [], []
            for content in batch.column(1).to_pylist():
                with np.load(io.BytesIO(content), allow_pickle=False) as archive:
                    values.append(archive["values"].astype(np.float64))
                    metas.append(json.dumps(json.loads(archive["metadata"].tobytes())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float64())), pa.array(metas, pa.string())], [key, "vec", "metadata"])

    return files.select(key, "content").mapInArrow(run, f"{key} {dict(files.dtypes)[key]}, vec array<double>, metadata string")
