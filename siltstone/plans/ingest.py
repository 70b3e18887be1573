"""Ingest: tree -> chunks -> vectors -> tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..config import load_config
from ..functions import text, vectors
from ..logs import Counter, line, stage
from ..models.http import ModelError
from ..models.protocol import Embedder, HashEmbedder
from ..operators import definitions, store
from ..operators.cache import VectorCache
from ..operators.scratch import drop_scratch, materialize
from ..operators.vector_index import VectorIndex
from ..shipping import ship
from ..sources.repo import read_repo, stream_repo

#: What the index keeps of a chunk beside its vector.
KEPT = ("relpath", "chunk_idx", "content")
#: Counters log progress after so many items.
EVERY = {"files": 50, "chunks": 200, "embeds": 100, "writes": 500}


def chunk_rows(files: DataFrame, limit: int, least: int) -> DataFrame:
    """Files to chunk rows without vectors: id, symbol, piece hash and the file's own columns."""
    pieces = definitions.chunked(files, "relpath", "lang", "content", limit, least, keep=("path", "realpath", "is_symlink", "lang", "sha256", "mtime"))
    return pieces.withColumns({"lang": text.lang_or_text(F.col("lang")), "mtime": F.coalesce("mtime", F.lit(0.0)), "id": text.chunk_id("relpath", "chunk_idx"), "content_sha": text.content_sha("content")})


def embedded(misses: DataFrame, model: str, make: Callable[[], Embedder], batch: int = 64, window: int = 8) -> DataFrame:
    """(chunk_sha, content) to (chunk_sha, model, vector, error, status); each worker makes one client.

    Up to `batch` texts go to the client at once. If it fails for good on these, each is asked for by itself, `window` at a
    time, and one that fails has its error and status instead of a vector.
    """
    ship(misses.sparkSession)

    def one(client, text):
        try:
            found = client.embed(model, [text])[0]
            return (found, None, None) if found else (None, "no vector", None)
        except ModelError as e:
            return None, str(e), e.status

    def run(batches):
        client = make()
        with ThreadPoolExecutor(window) as pool:
            for b in batches:
                for a in range(0, b.num_rows, batch):
                    part = b.slice(a, batch)
                    texts = part.column(1).to_pylist()
                    try:
                        found = [(v, None, None) if v else (None, "no vector", None) for v in client.embed(model, texts)]
                    except ModelError:
                        found = list(pool.map(lambda t: one(client, t), texts))
                    vs, errors, states = zip(*found)
                    columns = [part.column(0), pa.array([model] * part.num_rows), pa.array(vs, pa.list_(pa.float32())), pa.array(errors, pa.string()), pa.array(states, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["chunk_sha", "model", "vector", "error", "status"])

    return misses.select("chunk_sha", "content").mapInArrow(run, "chunk_sha string, model string, vector array<float>, error string, status int")


def totals(rows: DataFrame) -> DataFrame:
    """What chunk rows (relpath) come to."""
    return rows.agg(F.count_distinct("relpath").alias("files_indexed"), F.count("*").alias("chunks_written"))


def run_ingest(
    spark: SparkSession,
    repo_root: str | None = None,
    db_dir: str | None = None,
    table_name: str | None = None,
    config_path: str | None = None,
    force_reembed: bool = False,
    make_embedder: Callable[[], Embedder] | None = None,
    changed_only: bool = False,
    model: str | None = None,
    batch_size: int = 64,
    create_vec_index: bool = True,
    vacuum_after: bool = False,
    log_progress: bool = True,
) -> dict[str, int | float]:
    """Index a tree. Contents the cache holds are not embedded again, equal contents once; returns the summary.

    Texts that the model server refuses for good are rows of the table `embed_errors` and have a null vector; they are asked
    for again by the next run. The vector index follows the table unless create_vec_index is false.
    """
    cfg, _ = load_config(config_path)
    files = read_repo(spark, repo_root or cfg["repo_root"], cfg["indexing"])
    if changed_only:
        files = store.changed_only(files, store.Table(spark, db_dir or cfg["db_dir"], table_name or cfg["table"]).ensure(schema.CHUNKS).read())
    return ingest_files(files, db_dir, table_name, config_path, force_reembed, make_embedder, model, batch_size, create_vec_index, vacuum_after, log_progress)


def ingest_stream(spark: SparkSession, checkpoint: str, repo_root: str | None = None, db_dir: str | None = None, config_path: str | None = None, settle: float = 1.0, **how) -> StreamingQuery:
    """Ingest what is new or changed in a tree since the checkpoint; a batch that is replayed gives the same tables. how: as
    for ingest_files."""
    cfg, _ = load_config(config_path)
    files = stream_repo(spark, repo_root or cfg["repo_root"], cfg["indexing"], settle)

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            ingest_files(batch, db_dir, config_path=config_path, **how)

    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_files(
    files: DataFrame,
    db_dir: str | None = None,
    table_name: str | None = None,
    config_path: str | None = None,
    force_reembed: bool = False,
    make_embedder: Callable[[], Embedder] | None = None,
    model: str | None = None,
    batch_size: int = 64,
    create_vec_index: bool = True,
    vacuum_after: bool = False,
    log_progress: bool = True,
) -> dict[str, int | float]:
    """run_ingest for the rows of read_repo."""
    began, spark = time.perf_counter(), files.sparkSession
    cfg, _ = load_config(config_path)
    db, name = db_dir or cfg["db_dir"], table_name or cfg["table"]
    dim, model = cfg["embedding"]["dim"], model or cfg["embedding"]["model"]
    make = make_embedder or (lambda: HashEmbedder(dim))
    chunks, cache = store.Table(spark, db, name).ensure(schema.CHUNKS), VectorCache(spark, db)
    counters = {n: Counter(n, every) for n, every in EVERY.items()} if log_progress else {}
    count = lambda name, n: counters[name].update(n) if name in counters else None
    with stage("ingest") if log_progress else nullcontext():
        # Files are read once: what is made of them is written, and they are counted on the way.
        seen = Observation("files")
        rows = chunk_rows(files.observe(seen, F.count("*").alias("n")), cfg["indexing"]["max_chunk_chars"], cfg["indexing"]["min_chunk_chars"])
        rows = materialize(rows, "chunk-rows")
        count("files", seen.get["n"])
        pieces = rows.select(F.col("content_sha").alias("chunk_sha"), "content")
        misses = pieces.dropDuplicates(["chunk_sha"]) if force_reembed else cache.misses(pieces, model)
        # Vectors go to the cache table before anything reads them, so a retried task embeds but nothing embeds twice for good.
        asked = materialize(embedded(misses, model, make, batch_size), "embedded")
        n_new = asked.filter("error IS NULL").count()
        count("embeds", n_new)
        if n_new:
            good = vectors.validated(asked.filter("error IS NULL").drop("error"), "vector", dim)
            cache.put(good.withColumn("vector", F.col("vector").cast("array<float>")), model, replace=force_reembed)
        failed = asked.filter("error IS NOT NULL").select("chunk_sha", "model", "error", "status")
        n_failed = failed.count()
        if n_failed:
            store.Table(spark, db, "embed_errors").ensure(schema.EMBED_ERRORS).upsert(failed, ["chunk_sha", "model"])
        with_vectors = cache.lookup(rows.withColumn("chunk_sha", F.col("content_sha")), model).select(*schema.CHUNKS.names)
        summary = {"files_seen": seen.get["n"], **totals(rows).first().asDict(), "chunks_embedded": n_new}
        summary["cache_hits"] = summary["chunks_written"] - n_new - n_failed
        if n_failed:
            summary["embed_errors"] = n_failed
        count("chunks", summary["chunks_written"])
        if summary["chunks_written"]:
            chunks.upsert(with_vectors, ["id"])
            count("writes", summary["chunks_written"])
        drop_scratch(rows, asked)
        if create_vec_index:
            VectorIndex(spark, db, name).refresh(chunks.read(), KEPT)
        if vacuum_after:
            chunks.vacuum()
    for c in counters.values():
        c.close()
    summary["duration_s"] = round(time.perf_counter() - began, 3)
    line("ingest_summary", **summary)
    return summary
