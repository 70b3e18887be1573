"""Schemas of the persistent and transient tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _B, _L, _I, _D, _TS = T.StringType(), T.BooleanType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampType()
VECTOR = T.ArrayType(T.FloatType(), False)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, k not in ("id",)) for k, v in fields.items()])


FILES = _struct(path=_S, relpath=_S, realpath=_S, is_symlink=_B, size_bytes=_L, mtime=_D, sha256=_S, content_sha=_S, lang=_S, content=_S)
CHUNKS = _struct(id=_S, path=_S, realpath=_S, is_symlink=_B, relpath=_S, lang=_S, symbol=_S, chunk_idx=_I, content=_S, sha256=_S, content_sha=_S, mtime=_D, vector=VECTOR)
VEC_CACHE = _struct(chunk_sha=_S, model=_S, vector=VECTOR)
EMBED_ERRORS = _struct(chunk_sha=_S, model=_S, error=_S, status=_I)
TURNS = _struct(conv_id=_L, turn=_L, role=_S, text=_S, ts=_TS, summary=_S, embedding=VECTOR)
HITS = _struct(id=_S, relpath=_S, chunk_idx=_I, content=_S, _distance=_D)

#: Other names under which file columns are known.
FILE_ALIASES = {"rel_path": "relpath", "real_path": "realpath", "language": "lang", "text": "content"}


def with_times(df: DataFrame, seconds: str = "mtime", out: str = "modified") -> DataFrame:
    """Epoch seconds as a timestamp."""
    return df.withColumn(out, F.timestamp_seconds(seconds))


def with_file_aliases(files: DataFrame) -> DataFrame:
    return files.withColumns({alias: F.col(name) for alias, name in FILE_ALIASES.items()})
