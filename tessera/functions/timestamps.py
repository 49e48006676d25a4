"""Timestamps of the session formats, as column expressions; texts that do not parse stay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_seconds(text: Column) -> Column:
    """ISO text with an offset as UTC, whole seconds; anything else unchanged."""
    at = F.try_to_timestamp(F.regexp_replace(text, r"(\.\d{1,6})\d*", "$1"))
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), text)


def mongo_time(value: Column) -> Column:
    """From JSON text: a string as it is, or {"$date": string}, or {"$date": {"$numberLong": ms}}."""
    plain = F.when(value.startswith("{"), None).otherwise(F.regexp_replace(value, r'^"|"$', ""))
    date = F.get_json_object(value, "$['$date']")
    millis = F.get_json_object(value, "$['$date']['$numberLong']").try_cast("long") if hasattr(value, "try_cast") else F.get_json_object(value, "$['$date']['$numberLong']").cast("long")
    from_millis = F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.coalesce(plain, from_millis, F.when(~date.startswith("{"), date))
