"""Column expressions that the stages share."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# How source systems spell two of the statuses.
STATUS_ALIASES = {"cancelled": "canceled", "shipment_pending": "processing"}
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def plain(text: Column) -> Column:
    """Lower case without blanks around it; an empty string stays one."""
    return F.lower(F.trim(text))


def order_status(text: Column) -> Column:
    status = plain(text)
    out = F.when(F.lit(False), status)
    for alias, name in STATUS_ALIASES.items():
        out = out.when(status == alias, name)
    return out.otherwise(status)


def timestamp_or_null(text: Column) -> Column:
    """Null for what doesn't follow the format: such rows are quarantined, not failed."""
    return F.try_to_timestamp(F.trim(text), F.lit(TIMESTAMP_FORMAT))


def day(value: date | str) -> Column:
    return F.to_date(F.lit(str(value)))


def in_trailing_days(order_day: Column, as_of: Column, days: int) -> Column:
    """In the so many days that end with as_of, both ends included."""
    return (order_day >= F.date_sub(as_of, days - 1)) & (order_day <= as_of)


def in_days_after(order_day: Column, as_of: Column, days: int) -> Column:
    """After as_of, up to so many days after, that day included."""
    return (order_day > as_of) & (order_day <= F.date_add(as_of, days))


def identifier_hash(text: Column) -> Column:
    """What logs show of an identifier."""
    return F.substring(F.sha2(text, 256), 1, 12)


def label_at(probability: Column, threshold: float = 0.5) -> Column:
    return F.when(probability >= threshold, 1).otherwise(0)
