"""File names and points in time as the logs write them, brought to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What surrounds a name and is trimmed: Unicode's white space.
WHITE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: Integers above this are milliseconds, not seconds.
MILLISECONDS_ABOVE = 10**11


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(WHITE_SPACE))


def common_file_name(c: Column | str) -> Column:
    """Trimmed, only what follows the last ``/`` or ``\\``, lower-cased; null if nothing remains."""
    base = F.substring_index(F.translate(trimmed(c), "\\", "/"), "/", -1)
    return F.nullif(F.lower(base), F.lit(""))


def epoch_second(c: Column | str) -> Column:
    """Seconds of an integer that may hold milliseconds; null unless positive."""
    c = _col(c)
    whole = F.call_function("div", c, F.lit(1000))
    return F.when(c > MILLISECONDS_ABOVE, whole).when(c > 0, c).cast("long")


def epoch_day(second: Column | str) -> Column:
    """Days since 1970-01-01 (UTC) of a positive epoch second."""
    return F.call_function("div", _col(second), F.lit(86400)).cast("int")


def micros_of_seconds(c: Column | str) -> Column:
    """Whole microseconds of an epoch second; null for null, NaN and infinite values."""
    c = _col(c).cast("double")
    return F.when(F.abs(c) < F.lit(9.0e12), F.round(c * F.lit(1e6)).cast("long"))
