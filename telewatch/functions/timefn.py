"""Time helpers that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_micros(col: Column | str) -> Column:
    """Microseconds since 1970-01-01 00:00 of a wall-clock timestamp.

    ``timestamp_ntz`` values are read as wall-clock times; zoned timestamps
    are first expressed in the session zone.  Unlike ``unix_micros(cast(ts
    as timestamp))`` this does not jump across daylight-saving changes of the
    session zone, and equals DuckDB's ``epoch_us`` on naive timestamps.
    """
    c = F.col(col) if isinstance(col, str) else col
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, c.cast("timestamp_ntz"))
