"""Run identifiers, times and elapsed text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The numeric part of a job id and the two layouts of it.
ID_PATTERN = r"\d+(-)*\d+"
SCHEDULED = r"^\d{17}"
SUBMITTED = r"^\d{8}-\d{6}"
REPORT_ZONE = "America/Santiago"
TIME_FORMAT = "dd-MM-yyyy HH:mm:ss"


def job_id(resource: Column) -> Column:
    """Last part of a resource path."""
    return F.element_at(F.split(resource, "/"), -1)


def project_number(resource: Column) -> Column:
    """Second part of a resource path."""
    return F.try_element_at(F.split(resource, "/"), F.lit(2))


def start_time(job: Column) -> Column:
    """Start of a run from its id, as UTC wall time; null when the id holds none.

    17 digits are a time with milliseconds, which are cut; `8-6` digits are a time.
    """
    number = F.regexp_extract(job, ID_PATTERN, 0)
    seconds = F.substring(number, F.lit(1), F.length(number) - 3)
    return F.when(number.rlike(SCHEDULED), F.try_to_timestamp(seconds, F.lit("yyyyMMddHHmmss"))).when(
        number.rlike(SUBMITTED), F.try_to_timestamp(number, F.lit("yyyyMMdd-HHmmss"))
    )


def local_time(ts: Column, zone: str = REPORT_ZONE) -> Column:
    return F.from_utc_timestamp(ts, zone)


def elapsed_text(end: Column, start: Column) -> Column:
    """Whole hours (days included) and minutes between two times; null without both."""
    seconds = F.unix_timestamp(end) - F.unix_timestamp(start)
    hours, minutes = F.floor(seconds / 3600), F.pmod(F.floor(seconds / 60), F.lit(60))
    return F.when(seconds.isNotNull(), F.format_string("%dHrs %dMin", hours, minutes))


def parse_metrics(text: Column) -> Column:
    """Metric name -> number from JSON text that may use single quotes; null if broken."""
    return F.from_json(F.replace(text, F.lit("'"), F.lit('"')), "map<string,double>")
