"""Points in time as they are shown and as they name files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shown_date(epoch: Column) -> Column:
    """Seconds since 1970 as month/day/year in the session's time zone; ``?`` for null, zero and what isn't a number."""
    known = F.coalesce((epoch != 0) & ~F.isnan(epoch.cast("double")), F.lit(False))
    return F.when(known, F.date_format(F.timestamp_seconds(epoch), "M/d/yyyy")).otherwise("?")


def stamp(at: Column) -> Column:
    """A timestamp as it stands in the names of backups and journals: 20260131-235959."""
    return F.date_format(at, "yyyyMMdd-HHmmss")
