"""Date detection, parsing and date features."""

from __future__ import annotations

from pyspark.sql import functions as F

# What a date text looks like, searched anywhere in the value.
DATE_PATTERN = r"\d{4}[-/]\d{2}[-/]\d{2}|\d{2}[-/]\d{2}[-/]\d{4}"
# The layouts a detected date may have.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy")
# What may follow a date of ten characters: a time of day, seconds and their parts if any.
TIME_PATTERN = r"^[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?$"

# Feature suffix -> expression over a date column. ISO weekday: Monday is 1.
DATE_FEATURES = {
    "weekday": lambda c: F.weekday(c) + 1,
    "day_of_month": F.dayofmonth,
    "day_of_year": F.dayofyear,
    "unix": F.unix_date,
}


def format_test(c: str, form: str) -> str:
    """SQL: whether the value is laid out as `form`, told by its length and first separator.

    No two of the formats share a layout, and a test costs no exception as a failed
    parse does.
    """
    at = next(i for i, ch in enumerate(form) if ch in "-/")
    return f"length({c}) = {len(form)} and substring({c}, {at + 1}, 1) = '{form[at]}'"


def format_start(c: str, form: str) -> str:
    """SQL: whether the value begins as `form`, with or without a time of day behind it."""
    at = next(i for i, ch in enumerate(form) if ch in "-/")
    return f"length({c}) >= {len(form)} and substring({c}, {at + 1}, 1) = '{form[at]}'"


def has_time(c: str) -> str:
    """SQL: whether a time of day stands behind a date of ten characters."""
    return f"length({c}) > 10 and substring({c}, 11) rlike r'{TIME_PATTERN}'"


def parse_moment(c: str, formats: tuple[str, ...] = DATE_FORMATS) -> str:
    """SQL: the timestamp without zone of a date with or without a time of day; null when none fits."""
    day = f"cast({parse_date(f'left({c}, 10)', formats)} as string)"
    time = f"case when length({c}) = 10 then ' 00:00:00' when {has_time(c)} then concat(' ', substring({c}, 12)) end"
    return f"try_cast(concat({day}, {time}) as timestamp_ntz)"


def parse_date(c: str, formats: tuple[str, ...] = DATE_FORMATS) -> str:
    """SQL: the date in whichever format the value is laid out; null when none fits."""
    out = []
    for f in formats:
        parts = [f"substring({c}, {f.index(p) + 1}, {len(p)})" for p in ("yyyy", "MM", "dd")]
        whole = f"concat_ws('-', {', '.join(parts)})"
        # With both separators in place the value is already what its parts are joined to.
        text = f"if(substring({c}, 8, 1) = '-', {c}, {whole})" if f == "yyyy-MM-dd" else whole
        out.append(f"when {format_test(c, f)} then try_cast({text} as date)")
    return f"case {' '.join(out)} end"
