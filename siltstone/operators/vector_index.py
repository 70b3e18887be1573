"""A vector index: cells of similar vectors, product-quantised codes in them, exact distances at the end.

`fit` takes a bounded sample: coarse cells, and for every few components a codebook of 256 values. Every row is then kept in
the folder of its cell with one code byte per sub-vector. A search reads the codes of the cells nearest to its queries (a
sixteenth of the vectors' bytes, or less), adds up each code's part of the inner product from a table per query, keeps a
short list, and only then reads vectors: those of the short list, for their exact cosine distances.

`VectorIndex.refresh` follows a table. Rows that are new or differ get a cell and a code from the stored centroids, rows that
are gone go, each only in the folders that they touch; a second call finds nothing to do. Cells and codebooks are fitted again
when the mean error of all codes has grown by DRIFT, or the table by GROWTH. A fit writes a new generation, which counts once
its model row is there, so a job that dies leaves the old one in use.

Edge cases: null, zero and odd vectors and those of another width than most are a cell of their own that every search reads;
they have no distance and come last, as does every row for such a query; ties go to the smaller id; an empty table has no
index. Ids are keys: null ids take no part. A hot vector's rows share a cell, which Spark reads in splits like any file.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .knn import PRODUCT, _matrix
from .scratch import drop_scratch, materialize, scratch_path
from .store import located, replace_parts

#: Components of a sub-vector and values of its codebook (a byte holds a code).
SUB, VALUES = 4, 256
#: Rows and components of the sample that cells and codebooks are fitted on, at most.
SAMPLE_ROWS, SAMPLE_VALUES, ROUNDS = 65_536, 1 << 23, 8
#: Cells: the square root of the number of rows, at most.
MOST_CELLS = 4_096
#: The cell of rows without a direction.
REST = -1
#: Share of the cells that are read for a query (what vectors that hardly cluster need), and rows on the short list for
#: each wanted one.
PROBES, SHORT = 0.75, 8
#: Queries whose tables are sent to every task at once (a table has VALUES numbers for each sub-vector).
QUERY_BLOCK = 512
#: Short-listed rows up to which they are broadcast to the scan that fetches them.
BROADCAST_ROWS = 100_000
#: A fit is out of date when the mean error is so many times what it was, or the rows are.
DRIFT, GROWTH = 1.5, 16

MODEL = "generation int, width int, rows long, error double, cells array<array<float>>, books array<array<array<float>>>"


@dataclass
class Model:
    """Cells and codebooks, of a size that MOST_CELLS and the width bound."""

    width: int
    rows: int
    error: float
    cells: np.ndarray
    books: list[np.ndarray]
    generation: int = 0

    def parts(self) -> list[tuple[int, int]]:
        return [(a, min(a + SUB, self.width)) for a in range(0, self.width, SUB)]

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, codes and squared error of each unit vector."""
        cell = _nearest(unit, self.cells)
        codes = np.stack([_nearest(unit[:, a:b], book) for (a, b), book in zip(self.parts(), self.books)], 1).astype(np.uint8)
        error = sum(((unit[:, a:b] - book[codes[:, m]]) ** 2).sum(1) for m, ((a, b), book) in enumerate(zip(self.parts(), self.books)))
        return cell, codes, error

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """Each query's inner product with every value of every codebook: queries x sub-vectors x VALUES."""
        out = np.zeros((len(unit), len(self.books), VALUES), np.float32)
        for m, ((a, b), book) in enumerate(zip(self.parts(), self.books)):
            out[:, m, : len(book)] = unit[:, a:b] @ book.T
        return out


def _nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    size, step = (centers**2).sum(1), max(1, PRODUCT // max(1, len(centers)))
    return np.concatenate([np.zeros(0, np.int64), *(np.argmin(size - 2 * (rows[a : a + step] @ centers.T), 1) for a in range(0, len(rows), step))])


def centroids(rows: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """k means of the rows (fewer where there are fewer different rows)."""
    different = np.unique(rows, axis=0)
    rng = np.random.default_rng(seed)
    centers = different[rng.choice(len(different), min(k, len(different)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        at = _nearest(rows, centers)
        n = np.bincount(at, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, at, rows)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def fit(vectors: DataFrame, id_: str = "id", vector: str = "vector") -> Model | None:
    """Cells and codebooks from a sample by hash of the id; None where no row has a direction."""
    spark = vectors.sparkSession
    ship(spark)
    value = F.col(vector).cast("array<double>")
    fine = F.coalesce((F.size(value) > 0) & ~F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(value, lambda x: x != 0), F.lit(False))
    known = vectors.filter(fine & F.col(id_).isNotNull())
    widths = known.groupBy(F.size(vector).alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    if not widths:
        return None
    width, n = widths[0]["w"], widths[0]["count"]
    share = min(1.0, min(SAMPLE_ROWS, SAMPLE_VALUES // width) / n)
    sample = known.filter((F.size(vector) == width) & (F.pmod(F.xxhash64(id_), F.lit(1 << 30)) < int(share * (1 << 30)))).select(value.alias("v"))
    if sample.limit(1).count() == 0:  # a few rows whose hashes all lie beyond the share
        sample = known.filter(F.size(vector) == width).select(value.alias("v")).limit(SAMPLE_ROWS)
    # Every sub-vector is fitted in a task of its own, and so are the cells (-1); each takes its columns of the sample.
    subs = -(-width // SUB)
    slices = sample.select("v", F.explode(F.sequence(F.lit(-1), F.lit(subs - 1))).alias("sub"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    slices = slices.select("sub", F.when(F.col("sub") < 0, F.col("v")).otherwise(F.slice("v", F.col("sub") * SUB + 1, F.lit(SUB))).alias("v"), length.alias("length"))
    cells = int(min(MOST_CELLS, max(1, round(n**0.5))))

    def learn(table: pa.Table) -> pa.Table:
        sub, lists = table["sub"][0].as_py(), table["v"].combine_chunks()
        rows = lists.flatten().to_numpy().reshape(len(lists), -1) / table["length"].to_numpy()[:, None]
        rows = rows[np.lexsort(rows.T)]  # the order that rows come in must not matter
        # The error is that of every fifth row, which the codebook is not fitted on: what later rows may be held against.
        apart = np.arange(len(rows)) % 5 == 4
        centers = centroids(rows[~apart], cells if sub < 0 else VALUES)
        unseen = rows[apart] if apart.any() else rows
        error = float(((unseen - centers[_nearest(unseen, centers)]) ** 2).sum(1).mean()) if sub >= 0 else 0.0
        return pa.table({"sub": pa.array([sub], pa.int32()), "centers": pa.array([centers.tolist()], pa.list_(pa.list_(pa.float64()))), "error": [error]})

    learned = sorted(slices.groupBy("sub").applyInArrow(learn, "sub int, centers array<array<double>>, error double").collect())  # bounded: see Model
    held = [np.array(r["centers"], np.float32) for r in learned]
    return Model(width, n, sum(r["error"] for r in learned), held[0], held[1:])


def encoded(rows: DataFrame, model: Model, vector: str = "vector") -> DataFrame:
    """rows with cell, code and error."""
    ship(rows.sparkSession)
    at, names = rows.columns.index(vector), rows.columns

    def run(batches):
        for batch in batches:
            unit, fine = _matrix(batch.column(at), model.width)
            cell, codes, error = model.encode(unit)
            code = pa.array([bytes(c) if ok else None for c, ok in zip(codes, fine.tolist())], pa.binary())
            more = [pa.array(np.where(fine, cell, REST), pa.int32()), code, pa.array(error, pa.float32(), mask=~fine)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, "cell", "code", "error"])

    fields = [T.StructField("cell", T.IntegerType()), T.StructField("code", T.BinaryType()), T.StructField("error", T.FloatType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *fields]))


def short_lists(codes: DataFrame, model: Model, queries: list[tuple], keep: int, probes: int, id_: str) -> DataFrame:
    """query (its place in `queries`), cell, id and _far of the rows that look nearest by their codes. queries: (id, vector),
    at most QUERY_BLOCK of them. codes: id, cell, code."""
    spark = codes.sparkSession
    unit, fine = _matrix(pa.array([list(map(float, v)) if v is not None and None not in v else None for _, v in queries], pa.list_(pa.float64())), model.width)
    near = np.argsort(-(unit @ model.cells.T), axis=1, kind="stable")[:, :probes]
    wanted = np.zeros((len(queries), len(model.cells)), bool)
    np.put_along_axis(wanted, near, True, axis=1)
    wanted[~fine] = True  # such a query has no distance to any row
    tables = model.tables(unit)
    cells = [REST, *np.flatnonzero(wanted.any(0)).tolist()]
    kind = codes.schema[id_].dataType

    def run(batches):
        best: list[tuple] = [(np.zeros(0, np.float32), pa.array([], id_type), np.zeros(0, np.int32))] * len(fine)
        for batch in batches:
            ids, cell = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            far = np.full((len(fine), len(ids)), np.inf, np.float32)
            has = np.flatnonzero(cell != REST)
            if len(has):
                code = np.frombuffer(b"".join(batch.column(2).take(pa.array(has)).to_pylist()), np.uint8).reshape(len(has), -1)
                far[:, has] = -sum(tables[:, m, code[:, m]] for m in range(code.shape[1]))
                far[~fine] = np.inf
            take = np.ones_like(far, bool)
            take[:, has] = wanted[:, cell[has]]
            for q in range(len(fine)):
                old, old_ids, old_cells = best[q]
                some = np.flatnonzero(take[q] & (far[q] <= old.max()) if len(old) == keep else take[q])
                if not len(some):
                    continue
                d = np.concatenate([old, far[q, some]])
                who, where = pa.concat_arrays([old_ids, ids.take(pa.array(some))]), np.concatenate([old_cells, cell[some]])
                if len(d) > keep:
                    edge = np.partition(d, keep - 1)[keep - 1]
                    inside, ties = np.flatnonzero(d < edge), np.flatnonzero(d == edge)
                    ties = ties[np.argsort(np.array(who.take(pa.array(ties)).to_pylist(), object), kind="stable")][: keep - len(inside)]
                    kept = np.concatenate([inside, ties])
                    d, who, where = d[kept], who.take(pa.array(kept)), where[kept]
                best[q] = d, who, where
        for q, (d, who, where) in enumerate(best):
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), q), pa.int32()), pa.array(where, pa.int32()), who, pa.array(d, pa.float32())], names=["query", "cell", id_, "_far"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)
    schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField(id_, kind), T.StructField("_far", T.FloatType())])
    found = codes.filter(F.col("cell").isin(cells)).select(id_, "cell", "code").mapInArrow(run, schema)
    order = W.partitionBy("query").orderBy("_far", id_)
    return found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= keep).drop("_n")


class VectorIndex:
    """The index of one table, in a folder of its own beside it."""

    def __init__(self, spark: SparkSession, root: str, name: str, id_: str = "id", vector: str = "vector") -> None:
        self.spark, self.path, self.id, self.vector = spark, f"{located(root)}/{name}_index", id_, vector

    def model(self) -> Model | None:
        """That of the last generation, if there is one."""
        try:
            last = self.spark.read.schema(MODEL).parquet(f"{self.path}/models").orderBy(F.desc("generation")).first()
        except AnalysisException:
            return None
        return last and Model(last["width"], last["rows"], last["error"], np.array(last["cells"], np.float32), [np.array(b, np.float32) for b in last["books"]], last["generation"])

    def rows(self, model: Model) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows-{model.generation}")

    def _marked(self, table: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        rows = table.filter(F.col(self.id).isNotNull()).select(self.id, self.vector, *keep)
        return rows.withColumn("mark", F.xxhash64(F.col(self.vector), *keep))

    def build(self, table: DataFrame, keep: tuple[str, ...] = ()) -> Model | None:
        """Fit, and write every row into a new generation."""
        model, old = fit(table, self.id, self.vector), self.model()
        if model is None:
            return None
        model.generation = old.generation + 1 if old else 0
        # A folder that a stopped job left under this number is overwritten. Large cells are split over tasks.
        encoded(self._marked(table, keep), model, self.vector).hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/rows-{model.generation}")
        row = (model.generation, model.width, model.rows, model.error, model.cells.tolist(), [b.tolist() for b in model.books])
        self.spark.createDataFrame([row], MODEL).coalesce(1).write.mode("append").parquet(f"{self.path}/models")
        if old:
            self.rows(old).limit(0).write.mode("overwrite").parquet(f"{self.path}/rows-{old.generation}")
        return model

    def refresh(self, table: DataFrame, keep: tuple[str, ...] = ()) -> dict[str, int]:
        """Bring the index up to the table: rows added (or changed), rows removed (or changed), and whether it was fitted."""
        model = self.model()
        if model is None:
            built = self.build(table, keep)
            return {"added": self.rows(built).count() if built else 0, "removed": 0, "fitted": int(built is not None)}
        there, marks = self.rows(model), [self.id, "mark"]
        now = self._marked(table, keep)
        held = there.select(*marks)
        fresh = materialize(encoded(now.join(held, marks, "left_anti"), model, self.vector), "index-fresh")
        gone = materialize(there.select(*marks, "cell").join(now.select(*marks), marks, "left_anti"), "index-gone")
        added, removed = fresh.count(), gone.count()
        if removed:
            touched = sorted({r["cell"] for r in gone.select("cell").union(fresh.select("cell")).distinct().collect()})  # at most the cells
            left = there.filter(F.col("cell").isin(touched)).join(gone.select(*marks), marks, "left_anti")
            replace_parts(f"{self.path}/rows-{model.generation}", "cell", touched, left.unionByName(fresh))
        elif added:
            fresh.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows-{model.generation}")
        drop_scratch(fresh, gone)
        fitted = 0
        if added or removed:
            size = self.rows(model).filter(F.col("cell") != REST).agg(F.count("*").alias("n"), F.coalesce(F.avg("error"), F.lit(0.0)).alias("error")).first()
            if size["error"] > DRIFT * model.error + 1e-9 or size["n"] > GROWTH * model.rows:
                fitted = int(self.build(table, keep) is not None)
        return {"added": added, "removed": removed, "fitted": fitted}

    def search(self, queries: DataFrame, k: int = 12, probes: int | None = None, short: int = SHORT, query_id: str = "query_id") -> DataFrame:
        """The rows nearest to each query (query_id, qvec): the row's columns, query_id, rank and _distance."""
        model = self.model()
        if model is None:
            raise LookupError(f"no index in {self.path}")
        ship(self.spark)
        rows = self.rows(model)
        probes = min(len(model.cells), probes or int(np.ceil(PROBES * len(model.cells))))
        asked = materialize(queries.select(query_id, F.col("qvec").cast("array<double>").alias("qvec")), "index-queries")
        names = T.StructType([T.StructField("query", T.IntegerType()), asked.schema[query_id], asked.schema["qvec"]])
        own = [c for c in rows.columns if c not in ("cell", "code", "error", "mark")]
        path = scratch_path(self.spark, "index-listed")
        given = asked.toLocalIterator(prefetchPartitions=True)
        found = False
        while block := list(islice(given, QUERY_BLOCK)):  # one block's tables are held at a time
            one = short_lists(rows, model, [tuple(q) for q in block], k * short, probes, self.id)
            named = self.spark.createDataFrame([(i, *q) for i, q in enumerate(block)], names)
            one.join(F.broadcast(named), "query").drop("query", "_far").write.mode("append").parquet(path)
            found = True
        if not found:
            return rows.select(*own).limit(0).withColumns({query_id: F.lit(None).cast(asked.schema[query_id].dataType), "_distance": F.lit(None).cast("double"), "rank": F.lit(None).cast("int")})
        listed = self.spark.read.parquet(path)
        # Vectors (and what else is kept with them) are read for the short list only, from its cells.
        cells = [r["cell"] for r in listed.select("cell").distinct().collect()]
        few = listed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        near = rows.filter(F.col("cell").isin(cells)).select("cell", *own).join(F.broadcast(listed) if few else listed.hint("merge"), ["cell", self.id])
        near = near.withColumn("_distance", distance(F.col(self.vector).cast("array<double>"), F.col("qvec"))).drop("cell", "qvec")
        best = W.partitionBy(query_id).orderBy(F.col("_distance").asc_nulls_last(), F.col(self.id))
        return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(*own, query_id, "_distance", "rank")


def distance(a, b):
    """Cosine distance; null where either has no direction or the widths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0) & (size < float("inf")), 1 - dot(a, b) / size)
