"""Nearest neighbours by cosine distance: exact, and through an inverted file of centroids.

Rows are scored by matrix products, one Arrow batch against a block of queries at a time; a task keeps k rows of each
query, so what is shuffled grows with tasks and queries, never with their product by rows. Few queries are sent to every
task; more meet the rows in tasks of one shard of rows and one block of queries.

Edge cases: a null vector, one with a null component, of another width than the query's or of length 0 has a null
distance and comes last, as does every row for such a query; ties go to the smaller id; a query finds fewer than k rows
where there are fewer; columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import norm
from ..shipping import ship

#: Components of all queries together up to which they are sent to every task (8 bytes each).
QUERY_VALUES = 1 << 18
#: Rows of a shard and components of a block of queries, beyond that.
SHARD = 65_536
#: Numbers of one matrix product of queries and rows (8 bytes each): what a task holds besides its rows and results.
PRODUCT = 1 << 20
#: How far a matrix product may lie from a sum in order, for unit vectors.
SLACK = 1e-9


def _matrix(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as rows, and which rows have one of this width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    fits = sizes == width
    begin = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    if fits.any() and width:
        out[fits] = flat[begin[fits][:, None] + np.arange(width)[None, :]]
    length = np.sqrt(np.einsum("ij,ij->i", out, out))
    fine = fits & np.isfinite(length) & (length > 0)
    out[fine] /= length[fine, None]
    out[~fine] = 0
    return out, fine


def _rank(distance: float, id_) -> tuple:
    """Sort key: without a distance last, ids from null on."""
    none = distance != distance
    return none, 0.0 if none else distance, id_ is not None, 0 if id_ is None else id_


def _joined(batches: Iterator[pa.RecordBatch], rows: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class Best:
    """The k nearest rows of each query so far, as arrays of distances (nan: none), ids and rows."""

    def __init__(self, queries, k: int) -> None:
        self.k, sizes = k, queries.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        self.n = len(sizes)
        self.groups = []
        for width in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == width)
            unit, fine = _matrix(queries.take(pa.array(at)), width)
            self.groups.append((width, at, unit, fine))
        self.rows: list[pa.Table | None] = [None] * self.n
        self.limit = np.full(self.n, np.inf)

    def add(self, batch: pa.RecordBatch, ids: int, vector: int) -> None:
        if not batch.num_rows:
            return
        names = np.array(batch.column(ids).to_pylist(), object)
        step = max(1, PRODUCT // batch.num_rows)
        for width, all_, units, fits in self.groups:
            rows, good = _matrix(batch.column(vector), width)
            for a in range(0, len(all_), step):
                at, unit, fine = all_[a : a + step], units[a : a + step], fits[a : a + step]
                near = 1 - unit @ rows.T
                near[:, ~good] = np.nan
                near[~fine] = np.nan
                self._put(batch, ids, names, rows, at, unit, near)

    def _put(self, batch: pa.RecordBatch, ids: int, names: np.ndarray, rows: np.ndarray, at: np.ndarray, unit: np.ndarray, near: np.ndarray) -> None:
        """near: the product's distances of these queries (at, unit) and all rows of the batch."""
        for q, i in enumerate(at.tolist()):
            d = near[q]
            # All that may be among the best by the product, then exactly.
            full = self.rows[i] is not None and self.rows[i].num_rows >= self.k
            some = np.flatnonzero(d <= self.limit[i] + SLACK) if full and np.isfinite(self.limit[i]) else np.arange(len(d))
            if len(some) > 4 * self.k and np.isfinite(d[some]).sum() > self.k:
                edge = np.partition(np.where(np.isnan(d[some]), np.inf, d[some]), self.k - 1)[self.k - 1]
                some = some[~(d[some] > edge + SLACK) & ~np.isnan(d[some])]
            if not len(some):
                continue
            exact = np.where(np.isnan(d[some]), np.nan, 1 - (rows[some] * unit[q]).sum(1))
            order = sorted(range(len(some)), key=lambda j: _rank(exact[j], names[some[j]]))[: self.k]
            mine = pa.Table.from_batches([batch.take(pa.array(some[order]))]).append_column("_distance", pa.array(exact[order], pa.float64()))
            if self.rows[i] is not None:
                mine = pa.concat_tables([self.rows[i], mine])
                dist, who = mine["_distance"].to_pylist(), mine.column(ids).to_pylist()
                order = sorted(range(len(dist)), key=lambda j: _rank(dist[j], who[j]))[: self.k]
                mine = mine.take(pa.array(order))
            self.rows[i] = mine
            last = mine["_distance"][-1].as_py()
            self.limit[i] = last if mine.num_rows >= self.k and last == last else np.inf

    def result(self, query_ids, name: str) -> Iterator[pa.RecordBatch]:
        for i, rows in enumerate(self.rows):
            if rows is not None:
                dist = rows["_distance"].to_numpy()
                own = query_ids.take(pa.array(np.full(rows.num_rows, i)))
                cols = [*[c.combine_chunks() for c in rows.columns[:-1]], own, pa.array(dist, pa.float64(), mask=np.isnan(dist))]
                yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], names=[*rows.column_names[:-1], name, "_distance"])


def _ranked(found: DataFrame, k: int, query_id: str, id_: str) -> DataFrame:
    best = W.partitionBy(query_id).orderBy(F.col("_distance").asc_nulls_last(), F.col(id_))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 12, id_: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", query_values: int = QUERY_VALUES, shard: int = SHARD) -> DataFrame:
    """The k rows nearest to each query: the row's columns, query_id, rank, _distance. queries: query_id and qvec."""
    spark = vectors.sparkSession
    ship(spark)
    vectors = vectors.select(*[c for c in vectors.columns if c not in (query_id, "rank", "_distance")])
    asked = queries.select(query_id, F.col("qvec").cast("array<double>").alias("qvec"))
    schema = T.StructType([*vectors.schema.fields, asked.schema[query_id], T.StructField("_distance", T.DoubleType())])
    ids, at = vectors.columns.index(id_), vectors.columns.index(vector)
    size = asked.agg(F.coalesce(F.sum(F.greatest(F.size("qvec"), F.lit(1))), F.lit(0)).alias("n")).first()["n"]
    if size <= query_values:
        table = asked.toArrow().combine_chunks()
        shared = spark.sparkContext.broadcast(table)

        def scan(batches):
            given = shared.value
            best = Best(given["qvec"].combine_chunks(), k)
            for batch in _joined(batches):
                best.add(batch, ids, at)
            yield from best.result(given[query_id].combine_chunks(), query_id)

        return _ranked(vectors.mapInArrow(scan, schema), k, query_id, id_)
    blocks, shards = -(-size // query_values), max(1, -(-vectors.count() // shard))

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        best = Best(right["qvec"].combine_chunks(), k)
        for batch in left.drop_columns(["_s", "_b"]).to_batches(max_chunksize=8192):
            best.add(batch, ids, at)
        out = list(best.result(right[query_id].combine_chunks(), query_id))
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([], schema=to_arrow_schema(schema))

    from pyspark.sql.pandas.types import to_arrow_schema

    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    left = vectors.withColumn("_s", F.pmod(F.xxhash64(id_), F.lit(shards)).cast("int")).withColumn("_b", each(blocks))
    right = asked.withColumn("_b", F.pmod(F.xxhash64(query_id, F.lit(1)), F.lit(blocks)).cast("int")).withColumn("_s", each(shards))
    return _ranked(left.groupBy("_s", "_b").cogroup(right.groupBy("_s", "_b")).applyInArrow(pair, schema), k, query_id, id_)


#: The cell of all other rows: null, zero and odd vectors, and those of another width than most.
REST = -1


def build_ivf(vectors: DataFrame, path: str, cells: int = 32, id_: str = "vec_id", vector: str = "embedding", sample: int = 100_000, seed: int = 7) -> list[list[float]]:
    """Write every row under its cell's folder in `path` and return the centroids, which are fitted on a bounded sample by hash."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    fine = F.coalesce(norm(vector) > 0, F.lit(False)) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    widths = vectors.filter(fine).groupBy(F.size(vector).alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    fine = fine & (F.size(vector) == (widths[0]["w"] if widths else 0))
    unit = vectors.filter(fine).withColumn("_unit", F.expr(f"transform(`{vector}`, x -> double(x))")).withColumn("_v", array_to_vector("_unit"))
    n = unit.count()
    rest = vectors.filter(~fine).withColumn("cell", F.lit(REST))
    if not n:
        rest.write.partitionBy("cell").parquet(path)
        return []
    share = int(min(1.0, sample / n) * (1 << 20))
    model = KMeans(k=min(cells, n), seed=seed, featuresCol="_v", predictionCol="cell", distanceMeasure="cosine", maxIter=5).fit(unit.filter(F.pmod(F.xxhash64(id_), F.lit(1 << 20)) < share))
    # Few files for each cell; a cell with a large share of the rows is split.
    model.transform(unit).drop("_unit", "_v").unionByName(rest).hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
    return [c.tolist() for c in model.clusterCenters()]


#: Cells that are read for a query, as a share of all: what takes at least nine tenths of the true neighbours where vectors
#: hardly cluster. Clustered vectors need far fewer.
PROBES = 0.75


def probe_ivf(indexed: DataFrame, centroids: list[list[float]], queries: DataFrame, k: int = 12, probes: int | None = None, id_: str = "vec_id", vector: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """The nearest rows in the cells nearest to each query. indexed: what build_ivf wrote, read by Spark, so that folders of
    cells that no query asks for are not read. The centroids are bounded by the number of cells."""
    spark = indexed.sparkSession
    ship(spark)
    probes = probes or max(1, int(np.ceil(PROBES * len(centroids))))
    cells = spark.createDataFrame([(i, c) for i, c in enumerate(centroids)], "cell int, center array<double>")
    near = nearest(cells, queries, probes, "cell", "center", query_id).select(query_id, "cell")
    near = near.unionByName(queries.select(query_id, F.lit(REST).alias("cell"))).join(queries.select(query_id, F.col("qvec").cast("array<double>").alias("qvec")), query_id)
    wanted = [r["cell"] for r in near.select("cell").distinct().collect()]
    rows = indexed.filter(F.col("cell").isin(wanted))
    columns = [c for c in rows.columns if c != "cell"]
    schema = T.StructType([*[rows.schema[c] for c in columns], near.schema[query_id], T.StructField("_distance", T.DoubleType())])
    ids, at = columns.index(id_), columns.index(vector)

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        best = Best(right["qvec"].combine_chunks(), k)
        for batch in left.select(columns).to_batches(max_chunksize=8192):
            best.add(batch, ids, at)
        out = list(best.result(right[query_id].combine_chunks(), query_id))
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([], schema=to_arrow_schema(schema))

    from pyspark.sql.pandas.types import to_arrow_schema

    # A cell may hold a large share of the rows: its rows are dealt to shards of bounded size.
    shards = max(1, -(-rows.count() // SHARD))
    left = rows.withColumn("_s", F.pmod(F.xxhash64(id_), F.lit(shards)).cast("int"))
    right = near.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return _ranked(left.groupBy("cell", "_s").cogroup(right.groupBy("cell", "_s")).applyInArrow(pair, schema), k, query_id, id_)
