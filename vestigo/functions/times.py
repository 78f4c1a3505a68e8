"""Times within a video."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def minute_index(seconds: Column) -> Column:
    return F.greatest(F.lit(0), F.floor(F.coalesce(seconds, F.lit(0.0)) / 60)).cast("bigint")


def timecode(seconds: Column) -> Column:
    """mm:ss of a number of seconds rounded half-even, never negative."""
    total = F.greatest(F.lit(0), F.bround(F.coalesce(seconds, F.lit(0.0)), 0)).cast("bigint")
    return F.format_string("%02d:%02d", F.floor(total / 60), total % 60)


def minute_range(minute: Column) -> Column:
    """Label of a minute; its end at 59.999 s rounds up, so minute 0 reads 00:00-01:00."""
    start = minute * 60
    return F.concat(timecode(start.cast("double")), F.lit("-"), timecode(start + 59.999))
