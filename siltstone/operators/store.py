"""Keyed tables: pure DataFrame operators, and catalog tables whose Parquet folders Spark writes by hash of the key."""

from __future__ import annotations

import hashlib
import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranges import same
from .scratch import drop_scratch, materialize

PARTS = 64
PART = "_part"


def last_by_key(rows: DataFrame, keys: list[str], order: Column | str | None = None) -> DataFrame:
    """One row of each key, null being a key too: the last by `order`, or by its place in the input. Nulls in `order` come first.

    An aggregate that is combined before its shuffle, so that a hot key does not meet in one task.
    """
    rest = [c for c in rows.columns if c not in keys]
    by = F.monotonically_increasing_id() if order is None else F.col(order) if isinstance(order, str) else order
    last = rows.select(*keys, F.struct(by.alias("o"), F.struct(*rest, F.lit(0).alias("_any")).alias("r")).alias("_row"))
    return last.groupBy(*keys).agg(F.max_by("_row.r", F.struct("_row.o")).alias("_row")).select(*[c if c in keys else F.col("_row")[c].alias(c) for c in rows.columns])


def upserted(existing: DataFrame, incoming: DataFrame, keys: list[str], order: Column | str | None = None) -> DataFrame:
    """Rows of `existing` whose whole key is not in `incoming`, and of `incoming` the last row of each key. Null keys match."""
    new = last_by_key(incoming, keys, order)
    return same(existing, incoming.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def deleted(df: DataFrame, predicate: str | None) -> DataFrame:
    """Without the rows for which the predicate is true; an empty one deletes nothing."""
    return df.filter(~F.coalesce(F.expr(predicate), F.lit(False))) if predicate and predicate.strip() else df


def widened(df: DataFrame, schema: T.StructType) -> DataFrame:
    """With the schema's missing columns, null."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns})


def counted(tables: dict[str, DataFrame]) -> DataFrame:
    """name and n, the number of rows, of each table."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def changed_only(files: DataFrame, existing: DataFrame) -> DataFrame:
    """Files whose (relpath, sha256) the table does not hold."""
    return files.join(existing.select("relpath", "sha256").distinct(), ["relpath", "sha256"], "left_anti")


def cache_lookup(pieces: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """pieces (chunk_sha) with the cached vector of the model, null where there is none; of several the last row's."""
    known = last_by_key(cache.filter(F.col("model") == model).select("chunk_sha", "vector"), ["chunk_sha"])
    return pieces.join(known, "chunk_sha", "left")


def cache_misses(pieces: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Each content the model has not embedded yet, once."""
    return pieces.join(cache.filter(F.col("model") == model).select("chunk_sha"), "chunk_sha", "left_anti").dropDuplicates(["chunk_sha"])


class TableBusy(RuntimeError):
    """Another writer changed the parts that this one read."""


def located(root: str) -> str:
    """A folder as Spark takes it: with a scheme, or absolute."""
    return (root if "://" in root or root.startswith("/") else os.path.abspath(root)).rstrip("/")


def replace_parts(path: str, column: str, touched: list[int], rows: DataFrame, check=None) -> None:
    """The rows instead of what the touched folders of `column` (a bounded number) hold. They are written elsewhere first;
    then Spark overwrites the folders that get rows, and those that get none. Doing it again gives the same."""
    done = materialize(rows, "parts")
    if check:
        check()
    # Folders of any size: Spark splits large ones over tasks and files.
    done.hint("rebalance", column).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    left = {r[column] for r in done.select(column).distinct().collect()}
    for part in sorted(set(touched) - left):
        done.drop(column).limit(0).write.mode("overwrite").parquet(f"{path}/{column}={part}")
    drop_scratch(done)


class Table:
    """A table of the session's catalog over a Parquet folder, partitioned by hash of the key.

    Appends only add files; upserts and deletes overwrite the parts that they touch, with Spark's own overwriting of partitions,
    after the new rows were written elsewhere. The catalog holds the description (columns, keys, number of parts). The files
    hold it as well, as metadata of the key columns in every footer, so a session whose catalog does not know the table
    takes it from there; a column added without any row is in an empty file. A folder with other Parquet files is refused.

    No writer leaves a mark behind: what one that was stopped had written is either not visible yet or what the next run
    of the same upsert or delete writes again. A writer that finds the parts it read changed by another gets TableBusy
    instead of losing an update; that is looked at right before the overwrite, so it is a check, not a lock. Spark removes a
    part's old files right before it moves the new ones in; a driver that dies between the two needs that part written again.
    """

    def __init__(self, spark: SparkSession, root: str, name: str) -> None:
        self.spark, self.path = spark, f"{located(root)}/{name}"
        self.name = f"siltstone_{hashlib.md5(self.path.encode()).hexdigest()[:16]}"

    def _files(self) -> T.StructType | None:
        """What the files say: all columns of all footers, the key columns' metadata included."""
        try:
            return self.spark.read.option("mergeSchema", True).parquet(self.path).schema
        except AnalysisException:  # no folder, or no file with a schema in it
            return None

    def _create(self, schema: T.StructType, keys: list[str], parts: int) -> None:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name != PART)
        self.spark.sql(f"CREATE TABLE {self.name} ({columns}, {PART} INT) USING parquet PARTITIONED BY ({PART}) LOCATION '{self.path}' TBLPROPERTIES ('keys' = '{','.join(keys)}', 'parts' = '{parts}')")

    def _known(self) -> bool:
        """In the catalog, or in the files and from now on in the catalog."""
        if self.spark.catalog.tableExists(self.name):
            return True
        found = self._files()
        if found is None:
            return False
        keyed = sorted((f.metadata["key"], f.name, f.metadata["parts"]) for f in found if "key" in f.metadata)
        if not keyed:
            raise ValueError(f"{self.path} holds files of something else")
        self._create(found, [name for _, name, _ in keyed], keyed[0][2])
        return True

    def exists(self) -> bool:
        return self._known()

    def _about(self) -> tuple[T.StructType, list[str], int]:
        """Columns, keys and number of parts."""
        if not self._known():
            raise LookupError(f"no table in {self.path}")
        properties = {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {self.name}").collect()}
        schema = T.StructType([f for f in self.spark.table(self.name).schema if f.name != PART])
        return schema, properties["keys"].split(","), int(properties["parts"])

    def ensure(self, schema: T.StructType, keys: list[str] | None = None, parts: int = PARTS) -> Table:
        """Open, or create empty. keys: what rows are placed by, the first column by default."""
        if not self._known():
            self._create(schema, keys or schema.names[:1], parts)
            self._describe()
        return self

    def _described(self, rows: DataFrame) -> DataFrame:
        """The table's columns, with the description as metadata of the key columns."""
        schema, keys, parts = self._about()
        meta = lambda c: {"metadata": {"key": keys.index(c), "parts": parts}} if c in keys else {}
        rows = widened(rows, schema)
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name, **meta(f.name)) for f in schema], *[c for c in rows.columns if c == PART])

    def _describe(self) -> None:
        """An empty file with the columns, so that the files alone tell them."""
        none = self.spark.createDataFrame([], self._about()[0])
        self._described(none).coalesce(1).write.mode("append").parquet(f"{self.path}/{PART}=0")

    def _read(self, touched: list[int] | None = None) -> DataFrame:
        schema = T.StructType([*self._about()[0].fields, T.StructField(PART, T.IntegerType())])
        rows = self.spark.read.schema(schema).parquet(self.path)
        return rows if touched is None else rows.filter(F.col(PART).isin(touched))

    def read(self) -> DataFrame:
        return self._read().drop(PART)

    def _placed(self, rows: DataFrame) -> DataFrame:
        schema, keys, parts = self._about()
        rows = widened(rows, schema).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        return rows.withColumn(PART, F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))

    def _held(self, touched: list[int]) -> set[str]:
        """Names of the files in the touched parts."""
        marks = tuple(f"/{PART}={p}/" for p in touched)
        return {f for f in self.spark.read.schema(self._read().schema).parquet(self.path).inputFiles() if any(m in f for m in marks)}

    def _replace(self, touched: list[int], rows: DataFrame, before: set[str], empty: bool = True) -> None:
        """empty: touched parts that get no row lose those that they have."""

        def unchanged() -> None:
            if self._held(touched) != before:
                raise TableBusy(self.path)

        replace_parts(self.path, PART, touched if empty else [], self._described(rows), unchanged)

    def add(self, rows: DataFrame) -> Table:
        self._described(self._placed(rows)).write.mode("append").partitionBy(PART).parquet(self.path)
        return self

    def upsert(self, rows: DataFrame, keys: list[str], order: Column | str | None = None) -> Table:
        _, placed_by, parts = self._about()
        new = materialize(self._placed(last_by_key(rows, keys, order)), "incoming")
        # A key that places rows is in one part only.
        touched = sorted(r[PART] for r in new.select(PART).distinct().collect()) if set(placed_by) <= set(keys) else list(range(parts))
        if touched:
            before = self._held(touched)
            self._replace(touched, upserted(self._read(touched), new, keys), before)
        drop_scratch(new)
        return self

    def delete_where(self, predicate: str | None) -> Table:
        if not (predicate and predicate.strip()):
            return self
        touched = sorted(r[PART] for r in self._read().filter(F.expr(predicate)).select(PART).distinct().collect())
        if touched:
            before = self._held(touched)
            self._replace(touched, deleted(self._read(touched), predicate), before)
        return self

    def add_missing_columns(self, schema: T.StructType) -> Table:
        """Only the description changes: files without the columns read as null."""
        have = {n.lower() for n in self._about()[0].names}
        if more := [f for f in schema if f.name.lower() not in have]:
            self.spark.sql(f"ALTER TABLE {self.name} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in more)})")
            self._describe()
        return self

    def counts(self) -> dict[str, int]:
        return {"rows": self.read().count()}

    def vacuum(self) -> Table:
        """As few files for each part as its size asks for."""
        touched = list(range(self._about()[2]))
        before = self._held(touched)
        self._replace(touched, self._read(), before, empty=False)
        return self
