"""Column expressions over timestamps."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operators never read the clock: the moment they judge from is a parameter.
AsOf = datetime | str | Column


def moment(as_of: AsOf) -> Column:
    """The as-of parameter as a timestamp without a time zone."""
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    return F.lit(str(as_of)).cast("timestamp_ntz")


def days_before(as_of: AsOf, days: int) -> Column:
    return moment(as_of) - F.expr(f"INTERVAL '{int(days)}' DAY")


def hours_before(as_of: AsOf, hours: int) -> Column:
    return moment(as_of) - F.expr(f"INTERVAL '{int(hours)}' HOUR")


def seconds_between(earlier: Column, later: Column) -> Column:
    """Elapsed seconds, with fractions, as a double.

    The times carry no zone, so their difference is that of the clock readings, whatever
    the zone of the session and its clock changes are.
    """
    return F.timestamp_diff("MICROSECOND", earlier.cast("timestamp_ntz"), later.cast("timestamp_ntz")) / F.lit(1000000.0)
