"""Date coercion and calendar parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date part of ISO or US text, with or without a time behind it (also what a
# DATE or TIMESTAMP column looks like as text).
_DATE_TEXT = (r"^(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{4})"
              r"([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$")
DEFAULT_DATE_FORMATS = ["yyyy-M-d", "M/d/yyyy"]
# Same formats in strptime spelling for the oracle.
DEFAULT_DATE_FORMATS_SQL = ["%Y-%m-%d", "%m/%d/%Y"]


def parse_date(c: Column, formats: list[str] | None = None) -> Column:
    """First format that parses; unparsable text stays null (never 1970-01-01).

    By default ISO and month-first dates are read, one or two digits a part, a
    time of day after them is dropped; DATE and TIMESTAMP columns pass through.
    Own ``formats`` are tried, in order, on the whole text before those."""
    s = F.trim(c.cast("string"))
    own = [F.try_to_timestamp(s, F.lit(f)).cast("date") for f in formats or []]
    day = F.regexp_extract(s, _DATE_TEXT, 1)
    return F.coalesce(*own, *[F.try_to_timestamp(day, F.lit(f)).cast("date") for f in DEFAULT_DATE_FORMATS])


def parse_date_sql(e: str) -> str:
    day = f"regexp_extract(trim(CAST({e} AS VARCHAR)), '{_DATE_TEXT}', 1)"
    parts = ", ".join(f"CAST(try_strptime({day}, '{f}') AS DATE)" for f in DEFAULT_DATE_FORMATS_SQL)
    return f"coalesce({parts})"


def date_parts(d: Column) -> list[Column]:
    """Monday=0 weekday, month, quarter, weekend flag."""
    wd = F.weekday(d)
    return [wd.alias("day_of_week"), F.month(d).alias("month"), F.quarter(d).alias("quarter"),
            (wd >= 5).cast("int").alias("is_weekend")]


def date_parts_sql(d: str) -> str:
    return (f"CAST(isodow({d}) - 1 AS INTEGER) AS day_of_week, CAST(month({d}) AS INTEGER) AS month, "
            f"CAST(quarter({d}) AS INTEGER) AS quarter, CAST(isodow({d}) - 1 >= 5 AS INTEGER) AS is_weekend")
