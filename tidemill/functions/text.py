"""Normalising of keys and clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is cut from both ends of a key.
BLANKS = " \t\n\r\x0b\x0c "
ISO_TIME = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?[Zz]?$"


def tidy(c: Column | str) -> Column:
    """Trimmed, lower case, blank = null: how keys are compared everywhere."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.btrim(c, F.lit(BLANKS))), F.lit(""))


def tidy_upper(c: Column | str) -> Column:
    """Trimmed, upper case, blank = null: how code-like identifiers are shown."""
    return F.upper(tidy(c))


def clock_micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a text clock reading, or null if it isn't a time.

    Digits only are epoch milliseconds; ISO text may have T or a space, a fraction and a trailing Z, which
    changes nothing. The result does not depend on the session's time zone.
    """
    c = F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))
    bare = F.regexp_replace(c, "[Zz]$", "")
    return F.when(c.rlike(r"^\d{1,15}$"), F.expr("1000L") * c.try_cast("bigint")).when(
        c.rlike(ISO_TIME), F.unix_micros(F.concat(bare, F.lit("Z")).try_cast("timestamp"))
    )


def micros_to_ntz(micros: Column) -> Column:
    """A zone-free timestamp of microseconds since 1970, whatever the session's time zone."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (micros.cast("decimal(20,0)") / F.lit(1000000).cast("decimal(7,0)")).cast("decimal(18,6)")
    )


def second_text(ntz: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of a zone-free timestamp, fractions cut off."""
    return F.substring(ntz.cast("string"), 1, 19)
