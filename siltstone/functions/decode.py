"""Bytes to text by the first encoding that fits."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

ENCODINGS = ("utf-8", "utf-8-sig", "cp932", "shift_jis", "cp1252", "latin-1")


def decode_bytes(data: bytes | None, encodings: Sequence[str] = ENCODINGS, errors: str = "strict") -> str | None:
    """Text with line ends as \\n; None if nothing fits. A byte order mark that utf-8 accepts stays in the text."""
    if data is None:
        return None
    for encoding in encodings:
        try:
            text = data.decode(encoding, errors)
        except (UnicodeDecodeError, LookupError):
            continue
        return text.replace("\r\n", "\n").replace("\r", "\n")
    return None


def decoded(content: Column | str, encodings: Sequence[str] = ENCODINGS) -> Column:
    """UTF-8 stays in the JVM; only other bytes go through an Arrow batch."""
    encodings = tuple(encodings)
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def other(batch: pd.Series) -> pd.Series:
        return batch.map(lambda b: decode_bytes(b, encodings))

    c = F.col(content) if isinstance(content, str) else content
    if encodings and encodings[0] == "utf-8":
        plain = F.regexp_replace(F.decode(F.when(F.is_valid_utf8(c.cast("string")), c), "UTF-8"), "\r\n?", "\n")
        return F.when(F.is_valid_utf8(c.cast("string")), plain).otherwise(other(F.when(~F.is_valid_utf8(c.cast("string")), c)))
    return other(c)
