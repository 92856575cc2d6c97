"""Time expressions. Telemetry time is epoch milliseconds in a LongType column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
DAY_MS = 86_400_000


def idiv(c: Column, n) -> Column:
    """SQL ``c div n``: truncating integer division (SQLite ``/`` on integers, DuckDB ``//``)."""
    n = n if isinstance(n, Column) else F.lit(int(n))
    return F.call_function("div", c, n)


def epoch_ms(ts: Column) -> Column:
    """Epoch milliseconds of a TIMESTAMP_NTZ, independent of the session zone.

    Integer arithmetic on the wall-clock fields (no string round trip, no zone
    lookup); sub-millisecond digits are truncated.
    """
    return (
        F.unix_date(F.to_date(ts)).cast("bigint") * F.lit(DAY_MS)
        + F.hour(ts).cast("bigint") * F.lit(HOUR_MS)
        + F.minute(ts).cast("bigint") * F.lit(60_000)
        + F.floor(F.date_part(F.lit("SECOND"), ts) * F.lit(1000)).cast("bigint")
    )


def bucket(ts_ms: Column, width_ms) -> Column:
    """Start of the epoch-aligned bucket of ``width_ms`` containing ``ts_ms``."""
    w = width_ms if isinstance(width_ms, Column) else F.lit(int(width_ms))
    return idiv(ts_ms, w) * w
