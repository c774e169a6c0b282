"""SMART report text -> typed drive-health fields.

Each field is one ``regexp_extract`` over the whole report text; no match
gives an empty string, turned into null.  Numbers may carry thousands
separators.  All of it is JVM-side expression code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The report patterns (Java regex syntax), one per field.
PAT_MODEL = r"Model Number:\s+(.+)"
PAT_HEALTH = r"SMART overall-health self-assessment test result:\s+(\w+)"
PAT_USED = r"Percentage Used:\s+(\d+)%"
PAT_SPARE = r"Available Spare:\s+(\d+)%"
PAT_TEMP = r"Temperature:\s+(\d+) Celsius"
PAT_WRITTEN = r"Data Units Written:\s+[\[\(]?[\d,]+\s*[\]\)]?\s+\[([\d.]+)\s+(\w+)\]"
PAT_HOURS = r"Power On Hours:\s+([\d,]+)"
PAT_MEDIA = r"Media and Data Integrity Errors:\s+([\d,]+)"

# Written-volume unit -> factor to TB (others give null).
UNIT_TO_TB = {"TB": 1.0, "GB": 1.0 / 1024.0, "PB": 1024.0}


def _extract(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _int(text: Column, pattern: str) -> Column:
    return F.regexp_replace(_extract(text, pattern), ",", "").try_cast("int")


def written_tb(value: Column, unit: Column) -> Column:
    """Normalise a written volume to TB."""
    expr = None
    for u, factor in UNIT_TO_TB.items():
        term = value * F.lit(factor) if factor != 1.0 else value
        expr = F.when(unit == u, term) if expr is None else expr.when(unit == u, term)
    return expr


def smart_fields(report: Column) -> list[Column]:
    """C11: the eight drive-health columns from one report text column."""
    value = _extract(report, PAT_WRITTEN, 1).try_cast("double")
    unit = _extract(report, PAT_WRITTEN, 2)
    return [
        F.trim(_extract(report, PAT_MODEL)).alias("ssd_model"),
        _extract(report, PAT_HEALTH).alias("ssd_health_status"),
        _int(report, PAT_USED).alias("ssd_percentage_used"),
        _int(report, PAT_SPARE).alias("ssd_available_spare"),
        _int(report, PAT_TEMP).alias("ssd_temperature"),
        written_tb(value, unit).alias("ssd_data_written_tb"),
        _int(report, PAT_HOURS).alias("ssd_power_on_hours"),
        _int(report, PAT_MEDIA).alias("ssd_media_errors"),
    ]
