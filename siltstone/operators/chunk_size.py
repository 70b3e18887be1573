"""Size-bounded splitting: fill pieces up to a limit at white space, cut longer words hard.

White space is kept, so the pieces joined are the text. A text that fits is one piece. When the first word alone is
longer than the limit, the piece before it is empty (callers that want none filter it).
"""

from __future__ import annotations

import re
from itertools import pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import WS

_TOKEN = re.compile(r"\s|\S+")


def size_cuts(lengths: list[int], limit: int) -> list[int]:
    """End offsets of the pieces, from the lengths of white-space characters and words in turn."""
    cuts, start, at = [], 0, 0
    for n in lengths:
        if at + n - start > limit:
            cuts.append(at)
            hard = (n - 1) // limit if limit > 0 else 0
            cuts.extend(at + limit * k for k in range(1, hard + 1))
            start = at + limit * hard
        at += n
    return [*cuts, at] if at > start else cuts


def split_by_size(text: str, limit: int) -> list[str]:
    if len(text) <= limit:
        return [text]
    cuts = size_cuts([len(t) for t in _TOKEN.findall(text)], limit)
    return [text[a:b] for a, b in pairwise([0, *cuts])]


def size_pieces(text: Column | str, limit: int) -> Column:
    """The same as a column, for limits from 1, in time linear in the text: one pattern takes as many characters as end at
    the edge of a word or of a white-space character, or, inside a longer word, just as many as the limit."""
    text = F.col(text) if isinstance(text, str) else text
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{limit}}}(?:(?<=[{WS}])|(?=[{WS}])|\z)|.{{{limit}}}"), F.lit(0))
    # The loop starts a piece before a first word that does not fit.
    first = F.when(text.rlike(rf"\A[^{WS}]{{{limit + 1}}}"), F.concat(F.array(F.lit("")), pieces)).otherwise(pieces)
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(first)
