"""SQL names: after register(spark), queries can use chunk_text(...) as a lateral table function and decode_first(...)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.chunk_size import split_by_size
from ..operators.definitions import chunk_text, extract_defs
from ..shipping import ship
from .decode import decode_bytes


class ChunkText:
    """chunk_text(lang, content, limit, least)"""

    def eval(self, lang: str, content: str, limit: int, least: int):
        for i, (symbol, piece) in enumerate(chunk_text(lang, content or "", limit, least)):
            yield i, symbol or "", piece


class ExtractDefs:
    """extract_defs(lang, content)"""

    def eval(self, lang: str, content: str):
        for i, (symbol, code) in enumerate(extract_defs(lang or "", content or "")):
            yield i, symbol, code


class SplitBySize:
    """split_by_size(content, limit)"""

    def eval(self, content: str, limit: int):
        yield from enumerate(split_by_size(content or "", limit))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.udtf.register("chunk_text", F.udtf(ChunkText, returnType="chunk_idx int, symbol string, content string"))
    spark.udtf.register("extract_defs", F.udtf(ExtractDefs, returnType="def_idx int, symbol string, code string"))
    spark.udtf.register("split_by_size", F.udtf(SplitBySize, returnType="chunk_idx int, content string"))
    spark.udf.register("decode_first", F.pandas_udf(lambda batch: batch.map(decode_bytes), "string"))
