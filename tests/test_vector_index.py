import random

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from siltstone.operators import knn, vector_index
from siltstone.operators.vector_index import VectorIndex

SCHEMA = "id string, vector array<float>, body string"


def _made(n, width=16, seed=3):
    rnd = random.Random(seed)
    return [(f"r{i:05d}", [rnd.gauss(0, 1) for _ in range(width)], f"b{i}") for i in range(n)]


def _exact(df, queries, k):
    return {(r.query_id, r.id) for r in knn.nearest(df, queries, k, "id", "vector").collect()}


def test_centroids_and_codes():
    x = np.random.default_rng(1).normal(size=(500, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert len(vector_index.centroids(x[:3].repeat(5, 0), 256)) == 3
    model = vector_index.Model(8, 500, 0.0, vector_index.centroids(x, 5), [vector_index.centroids(x[:, :4], 256), vector_index.centroids(x[:, 4:], 256)])
    cell, codes, error = model.encode(x)
    back = np.concatenate([b[codes[:, m]] for m, b in enumerate(model.books)], 1)
    assert np.allclose(((x - back) ** 2).sum(1), error) and error.mean() < 0.2
    tables = model.tables(x[:4])
    assert np.allclose(tables[:, 0, codes[:, 0]] + tables[:, 1, codes[:, 1]], x[:4] @ back.T, atol=1e-5)
    assert (cell == np.argmin(((x[:, None] - model.cells[None]) ** 2).sum(2), 1)).all()


def test_search_reads_codes_first_and_finds_nearly_all(spark, tmp_path):
    data = _made(3000) + [(f"s{i}", [1.0] * 16, "same") for i in range(40)]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    index = VectorIndex(spark, str(tmp_path), "chunks")
    assert index.refresh(df, ("body",)) == {"added": 3040, "removed": 0, "fitted": 1}
    queries = spark.createDataFrame([(i, data[50 * i][1]) for i in range(60)] + [(99, [1.0] * 16)], "query_id int, qvec array<double>")
    found = index.search(queries, 10)
    got = {(r.query_id, r.id) for r in found.collect()}
    want = _exact(df, queries, 10)
    assert len(got & want) >= 0.9 * len(want)
    assert {i for q, i in got if q == 99} == {i for q, i in want if q == 99}  # ties to the smaller id
    one = found.filter("query_id = 0").orderBy("rank").collect()
    assert [r.rank for r in one] == list(range(1, 11)) and one[0].id == "r00000" and abs(one[0]._distance) < 1e-6 and one[0].body == "b0"
    # Codes are at most a tenth of the vectors' bytes, and the scan of codes reads neither vectors nor cells that no query wants.
    model = index.model()
    assert len(model.books) <= 16 * 4 / 10
    codes = vector_index.short_lists(index.rows(model), model, [(0, data[0][1])], 80, 3, "id")
    plan = codes._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell#" in plan and "ReadSchema: struct<id:string,code:binary>" in plan
    assert codes.select("cell").distinct().count() <= 4
    # Everything probed and short-listed is the exact search.
    assert {(r.query_id, r.id) for r in index.search(queries, 10, probes=10**6, short=400).collect()} == want


def test_odd_vectors_and_queries(spark, tmp_path):
    data = _made(50, 4) + [("n1", None, "x"), ("n2", [0.0] * 4, "x"), ("n3", [1.0], "x"), ("n4", [], "x"), (None, [1.0] * 4, "x")]
    df = spark.createDataFrame(data, SCHEMA)
    index = VectorIndex(spark, str(tmp_path), "t")
    index.build(df)
    queries = spark.createDataFrame([(1, data[0][1]), (2, [0.0] * 4), (3, None), (4, [1.0])], "query_id int, qvec array<double>")
    got = index.search(queries, 60, probes=100).collect()
    one = [r for r in got if r.query_id == 1]
    assert len(one) == 54 and [r.id for r in one if r._distance is None] == ["n1", "n2", "n3", "n4"] and all(r._distance is not None for r in one[:50])
    for q in (2, 3):
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)][:5] == ["n1", "n2", "n3", "n4", "r00000"]
    assert index.search(queries.limit(0), 3).count() == 0
    none = VectorIndex(spark, str(tmp_path), "none")
    assert none.refresh(df.limit(0)) == {"added": 0, "removed": 0, "fitted": 0} and none.model() is None
    with pytest.raises(LookupError):
        none.search(queries)


def test_upkeep(spark, tmp_path):
    data = _made(600, 8)
    df = spark.createDataFrame(data, SCHEMA)
    index = VectorIndex(spark, str(tmp_path), "t")
    index.refresh(df.filter("id < 'r00400'"), ("body",))
    before = index.model()
    now = df.filter("id >= 'r00030'").withColumn("body", F.when(F.col("id") == "r00100", "new").otherwise(F.col("body"))).withColumn("vector", F.when(F.col("id") == "r00200", F.array(*[F.lit(float(i)).cast("float") for i in range(8)])).otherwise(F.col("vector")))
    assert index.refresh(now, ("body",)) == {"added": 202, "removed": 32, "fitted": 0}
    held = index.rows(index.model())
    assert rows(held.select("id", "vector", "body"), "id") == rows(now.select("id", "vector", "body"), "id")
    assert index.model().generation == before.generation
    # Cells and codes are those that the stored centroids give.
    again = vector_index.encoded(now, before).select("id", "cell", "code")
    assert rows(held.select("id", "cell", "code"), "id") == rows(again, "id")
    files = sorted((tmp_path / "t_index").rglob("*.parquet"))
    assert index.refresh(now, ("body",)) == {"added": 0, "removed": 0, "fitted": 0} and sorted((tmp_path / "t_index").rglob("*.parquet")) == files
    assert index.refresh(now.limit(0), ("body",))["removed"] == 570 and index.rows(index.model()).count() == 0


def test_drift_and_growth_fit_again(spark, tmp_path):
    flat = [(f"f{i}", [1.0, (i % 7) / 100, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], "x") for i in range(200)]
    index = VectorIndex(spark, str(tmp_path), "t")
    index.refresh(spark.createDataFrame(flat, SCHEMA))
    old = index.model()
    assert old.error < 1e-6
    every = spark.createDataFrame(flat + _made(300, 8), SCHEMA)
    assert index.refresh(every) == {"added": 300, "removed": 0, "fitted": 1}
    assert index.model().generation == old.generation + 1 and index.rows(index.model()).count() == 500
    assert spark.read.schema("id string").parquet(f"{index.path}/rows-{old.generation}").count() == 0


def test_a_fit_that_dies_leaves_the_old_generation(spark, tmp_path, monkeypatch):
    index = VectorIndex(spark, str(tmp_path), "t")
    df = spark.createDataFrame(_made(100, 8), SCHEMA)
    index.refresh(df)
    real = vector_index.T.StructField
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("dies")))
    with pytest.raises(RuntimeError, match="dies"):
        index.build(df)
    monkeypatch.undo()
    assert real is vector_index.T.StructField and index.model().generation == 0 and index.rows(index.model()).count() == 100
    assert index.build(df).generation == 1


def test_the_nearest_of_many_cells_holds_little_at_once():
    import tracemalloc

    draw = np.random.default_rng(5)
    rows, cells = draw.normal(size=(4096, 4)), draw.normal(size=(4096, 4))
    tracemalloc.start()
    found = vector_index._nearest(rows, cells)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    assert all(((rows[i] - cells) ** 2).sum(1).argmin() == found[i] for i in range(0, 4096, 64))
