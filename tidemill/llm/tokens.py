"""Tokens: maximal runs of letters, digits and underscores, or of other characters that aren't white space."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE, WORD, OTHER = 0, 1, 2
#: Characters looked at together; a longer text is looked at alone.
CHUNK_CHARS = 4_000_000


@cache
def classes() -> np.ndarray:
    """The class of every code point, as the pattern ``\\w+|[^\\w\\s]+`` has them."""
    points = "".join(map(chr, range(0x110000)))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s+"), (WORD, r"\w+")):
        for m in re.finditer(pattern, points):
            table[m.start() : m.end()] = kind
    return table


def chunks(texts: pa.Array, chars: int = CHUNK_CHARS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, code points, ends): runs of whole texts, as code points, with the end of each text. Null is empty."""
    texts = pc.fill_null(texts, "")
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    first, n = 0, len(texts)
    while first < n:
        upto = first + max(1, int(np.searchsorted(np.cumsum(lengths[first:]), chars, side="right")))
        text = "".join(texts.slice(first, upto - first).to_pylist())
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        yield first, points, np.cumsum(lengths[first:upto])
        first = upto


def starts(points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each code point, and where tokens start; no token runs over a text's end."""
    kinds = classes()[points]
    begun = np.empty(kinds.size, bool)
    if kinds.size:
        begun[0] = True
        np.not_equal(kinds[1:], kinds[:-1], out=begun[1:])
        inner = ends[:-1]
        begun[inner[inner < kinds.size]] = True
        begun &= kinds != SPACE
    return kinds, begun


def upto(values: np.ndarray) -> np.ndarray:
    """Running sums with a leading 0, so that the sum over [a, b) is upto[b] - upto[a]."""
    out = np.zeros(values.size + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out


def count_tokens(texts: pa.Array) -> np.ndarray:
    """The number of tokens of each text; 0 for null."""
    out = np.zeros(len(texts), np.int64)
    for first, points, ends in chunks(texts):
        _, begun = starts(points, ends)
        out[first : first + ends.size] = np.diff(upto(begun)[np.concatenate([[0], ends])])
    return out


def token_count(text: str) -> Column:
    """Column of the number of tokens of whole texts, counted in Arrow batches; 0 for null."""

    def counted(texts: pa.Array) -> pa.Array:
        return pa.array(count_tokens(texts), pa.int64())

    return F.arrow_udf(counted, "bigint")(F.col(text))


def sized(documents: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, tokens) of documents, without the text."""
    return documents.select(*keep, token_count("text").alias("tokens"))
