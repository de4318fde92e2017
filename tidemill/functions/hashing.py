"""Digests of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def integrity_hash(parts: list[Column], rounds: int = 100) -> Column:
    """SHA-256 of the parts joined by ``|`` (nulls skipped), hashed again for ``rounds`` rounds in all.

    The casts are explicit: left to the analyser they are found one a pass, and a hundred exceed its limit.
    """
    out = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"), 256)
    for _ in range(rounds - 1):
        out = F.sha2(out.cast("binary"), 256)
    return out
