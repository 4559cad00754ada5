"""Queries on odd tables, and plans that keep large tables in parts."""

import re

import duckdb
import numpy as np
import pytest
from conftest import rows_of

from weftline import catalog
from weftline.operators import pairs

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def saved(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def expected(name, at, table="embeddings"):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{at}/{table}.parquet/*.parquet'")
    return rows_of(con.execute(SQL[name]).df())


def vector(rng, n=64):
    return [float(np.float32(x)) for x in rng.normal(size=n)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Vectors that are null, short, long or hold nulls, and ids that are null or repeated."""
    rng = np.random.default_rng(8)
    rows = [(i, vector(rng), i % 3) for i in range(40)]
    rows += [(40, None, 0), (41, vector(rng, 20), 1), (42, vector(rng, 70), 2), (7, vector(rng), 0), (7, vector(rng), 1), (None, vector(rng), 1)]
    holes = vector(rng)
    holes[3] = holes[50] = None
    return saved(spark, tmp_path_factory.mktemp("odd"), [*rows, (43, holes, 0)])


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["jn_pair_self_corr", "set_dedup_pairs", "top_pairs_sym"])
def test_pairs_of_odd_vectors(name, spark, odd):
    assert rows_of(QUERIES[name](spark, odd).toPandas()) == expected(name, odd)


def test_traces_lie_across_tokens_and_sums_are_exact(spark):
    """A row for each token, however long the traces; tiles of a few ids and large means lose nothing, and a constant is 0."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(50, 6)) + 1e7, np.full((50, 1), 1000.1)], axis=1)
    acts = spark.createDataFrame([(t, n, float(x[t, n])) for t in range(50) for n in range(7)], "token long, neuron long, value double").repartition(5)
    found = pairs.traces(acts)
    assert found.count() == 50
    sums = {(r.a, r.b): r for r in pairs.pair_sums(found, size=2).collect()}
    assert sorted(sums) == [(a, b) for a in range(7) for b in range(a + 1, 7)]
    assert all(r.rows == 50 and np.isclose(r.xy, x[:, a] @ x[:, b], rtol=1e-12) for (a, b), r in sums.items())
    corr = {(r.a, r.b): r["corr"] for r in pairs.correlations(found).collect()}
    assert all(abs(c - (np.corrcoef(x[:, a], x[:, b])[0, 1] if b < 6 else 0)) < 1e-7 and (b < 6 or c == 0) for (a, b), c in corr.items())


def test_merge_errors_join_no_traces(spark, data):
    """What is joined for a pair of neurons are sums, not two arrays of all tokens."""
    text = plan(QUERIES["agg_merge_error"](spark, data))
    assert not re.search(r"array_sort\(collect_list|collect_list\(struct\(token", text)


def test_pairs_are_made_once(spark, data):
    """Both directions of a pair come from one pass."""
    assert plan(QUERIES["set_dedup_pairs"](spark, data)).count("MapInArrow") == 1
    assert plan(QUERIES["top_pairs_sym"](spark, data)).count("MapInArrow") == 1


def test_sparse_products_of_odd_vectors(spark, odd, tmp_path):
    """Nulls, short, long and repeated vectors count in the product as in a join on the column; only blocks are shuffled."""
    from pyspark.sql import functions as F

    from weftline.operators import corrections

    rng = np.random.default_rng(10)
    entries = [(int(r), int(c), None if r == 5 or c == 9 else float(v)) for r, c, v in zip(rng.integers(0, 30, 200), rng.integers(0, 80, 200), rng.normal(size=200), strict=True)]
    e = spark.createDataFrame([*entries, (None, 3, 1.0), (3, None, 1.0)], "row_id long, col long, residual float")
    x = spark.read.parquet(f"{odd}/embeddings.parquet").select(F.col("vec_id").alias("token"), F.posexplode("embedding").alias("col", "value"))
    found = corrections.sparse_matvec(e, x)
    assert "sum(" not in plan(found)
    want = e.join(x, "col").groupBy("row_id", "token").agg(F.sum(F.col("residual").cast("double") * F.col("value").cast("double")).alias("y"))
    small = lambda df: rows_of(df.select("row_id", "token", (F.round("y", 6) + F.lit(0.0)).alias("y")).toPandas())
    assert small(found) == small(want)
    assert corrections.sparse_matvec(e.limit(0), x).count() == corrections.sparse_matvec(e, x.limit(0)).count() == 0


def test_whole_texts_of_odd_documents(spark, tmp_path):
    """Line breaks of every kind, null texts, ids that are null or repeat, and texts that look like the files' own lines."""
    texts = ["a\nb\r\nc\r\n", "", None, "\n", "\n\n", "3 4\nabcd\n", "7 0\n", "é ß\U0001f600\n", "x" * 5000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, "again\n"), (1, "and\nagain"), (None, "no id"), (None, "\n")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = [(r.doc_id, r.n, r.digest) for r in QUERIES["src_text"](spark, str(tmp_path)).collect()]
    assert sorted(found, key=str) == sorted(con.execute(SQL["src_text"]).fetchall(), key=str)


def test_damaged_files_of_documents():
    import pyarrow as pa

    from weftline.plans import codecs

    made = list(codecs._framed([pa.RecordBatch.from_arrays([pa.array([1, None]), pa.array([b"a\n", b""])], ["doc_id", "text"])]))
    whole = made[0].column(0)[0].as_py() + b"\n"
    read = lambda data: [r for b in codecs._unframed([pa.RecordBatch.from_arrays([pa.array([data])], ["value"])]) for r in b.to_pylist()]
    assert read(whole) == [{"doc_id": 1, "text": b"a\n"}, {"doc_id": None, "text": b""}]
    for data in (whole[:-1], whole[:-3], whole + b"x", whole + b"\n"):
        with pytest.raises(ValueError):
            read(data)
