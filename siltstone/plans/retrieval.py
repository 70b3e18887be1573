"""Retrieval: question -> nearest chunks -> packed context -> answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from ..config import load_config
from ..models.protocol import ChatModel, Embedder, HashEmbedder
from ..operators import knn, pack, store
from ..operators.vector_index import VectorIndex

NO_CONTEXT = "(none)"
SYSTEM = "You are a coding assistant. Use only the context you are given; say so if the answer is not in it."


def query_repo(spark: SparkSession, question: str, db_dir: str | None = None, table_name: str | None = None, config_path: str | None = None, top_k: int | None = None, embedder: Embedder | None = None, use_index: bool = True) -> DataFrame:
    """The chunks nearest to a question, nearest first: id, relpath, chunk_idx, content, _distance.

    use_index: search the table's vector index, which an ingest keeps up (if there is one, by default), instead of all vectors.
    """
    cfg, _ = load_config(config_path)
    embedder = embedder or HashEmbedder(cfg["embedding"]["dim"])
    vector = embedder.embed(cfg["embedding"]["model"], [question])[0]
    db, name, k = db_dir or cfg["db_dir"], table_name or cfg["table"], top_k or cfg["retrieval"]["top_k"]
    asked = spark.createDataFrame([(0, vector)], "query_id int, qvec array<double>")
    index = VectorIndex(spark, db, name)
    if use_index and index.model():
        best = index.search(asked, k).filter("vector IS NOT NULL")
    else:
        best = knn.nearest(store.Table(spark, db, name).read().filter("vector IS NOT NULL"), asked, k, "id", "vector")
    return best.select(*schema.HITS.names).orderBy(F.col("_distance").asc_nulls_last(), "id")


def _ranked(hits: DataFrame) -> DataFrame:
    # At most top_k rows: their order needs one small window.
    return hits.withColumn("_g", F.lit(0)).withColumn("_rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("_distance").asc_nulls_last(), "id")))


def packed_context(hits: DataFrame, budget: int) -> str:
    kept = pack.joined_within(_ranked(hits), ["_g"], "_rank", "content", budget)
    row = pack.context_text(kept, ["_g"], "_rank", "content").first()
    return row["context"] if row else ""


def snippet_context(hits: DataFrame, budget: int) -> str:
    pieces = _ranked(hits).withColumn("_piece", pack.snippet(F.col("relpath"), F.col("chunk_idx"), F.col("content")))
    row = pack.context_text(pack.snippets_within(pieces, ["_g"], "_rank", "_piece", budget), ["_g"], "_rank", "_piece").first()
    return row["context"] if row else ""


def chat_with_context(question: str, hits: DataFrame, chat: ChatModel, config_path: str | None = None, chat_model: str | None = None) -> str:
    cfg, _ = load_config(config_path)
    context = packed_context(hits, int(cfg["retrieval"]["max_context_chars"]))
    messages = [{"role": "system", "content": SYSTEM}, {"role": "user", "content": f"Context:\n{context}\n\nQuestion: {question}"}]
    return chat.chat(chat_model or cfg["ollama"]["chat_model"], messages)
