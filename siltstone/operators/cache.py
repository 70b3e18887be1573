"""Content-addressed vectors in a bucketed catalog table.

Buckets are by hash of the content's sha, so a lookup shuffles the asked contents, once each, and never the cache; models are
folders, of which a lookup reads one. A large share of pieces with one content meets the cache as one row, and its vector goes
back to all of them by a join that Spark may split.

Edge cases: null shas have no vector; of several vectors of one content and model any counts (they are of the same text); rows
put again after a failure change nothing that a lookup sees; another session finds the table by its folder, whose name tells
the number of buckets.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import drop_scratch, materialize
from .store import located

BUCKETS = 64


class VectorCache:
    def __init__(self, spark: SparkSession, root: str, name: str = "vec_cache", buckets: int = BUCKETS) -> None:
        self.spark, self.buckets = spark, buckets
        self.path = f"{located(root)}/{name}_by_{buckets}"
        self.name = f"siltstone_{hashlib.md5(self.path.encode()).hexdigest()[:16]}"
        if spark.catalog.tableExists(self.name):
            return
        spark.sql(
            f"CREATE TABLE {self.name} (chunk_sha STRING, vector ARRAY<FLOAT>, model STRING) USING parquet PARTITIONED BY (model) "
            f"CLUSTERED BY (chunk_sha) SORTED BY (chunk_sha) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )
        spark.createDataFrame([], "chunk_sha string, vector array<float>, model string").write.insertInto(self.name)  # makes the folder

    def read(self) -> DataFrame:
        """chunk_sha, vector, model, as all writers left them."""
        self.spark.catalog.recoverPartitions(self.name)
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def known(self, model: str) -> DataFrame:
        return self.read().filter(F.col("model") == model).select("chunk_sha", "vector")

    def misses(self, pieces: DataFrame, model: str) -> DataFrame:
        """Each content (chunk_sha, and what else the pieces have) that the model has not embedded yet, once."""
        return pieces.dropDuplicates(["chunk_sha"]).join(self.known(model).select("chunk_sha").hint("merge"), "chunk_sha", "left_anti")

    def found(self, pieces: DataFrame, model: str) -> DataFrame:
        """chunk_sha and vector of the pieces' different contents that are known."""
        asked = pieces.select("chunk_sha").filter("chunk_sha IS NOT NULL").distinct()
        one = self.known(model).groupBy("chunk_sha").agg(F.any_value("vector").alias("vector"))  # within buckets
        return one.join(asked.hint("merge"), "chunk_sha", "left_semi")

    def lookup(self, pieces: DataFrame, model: str) -> DataFrame:
        """pieces with their vector, null where there is none."""
        return pieces.join(self.found(pieces, model), "chunk_sha", "left")

    def put(self, rows: DataFrame, model: str, replace: bool = False) -> None:
        """rows: chunk_sha and vector. replace: they take the place of the vectors that their contents have."""
        rows = rows.select("chunk_sha", "vector", F.lit(model).alias("model"))
        if replace:
            old = self.known(model).join(rows.select("chunk_sha").hint("merge"), "chunk_sha", "left_anti")
            rows = materialize(rows.unionByName(old.withColumn("model", F.lit(model))), "cache")
        # One file for each bucket and call.
        placed = rows.repartition(self.buckets, "chunk_sha")
        if not replace:
            placed.write.insertInto(self.name)
            return
        held = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            placed.write.insertInto(self.name, overwrite=True)
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", held)
        drop_scratch(rows)
