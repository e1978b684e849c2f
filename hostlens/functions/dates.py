"""Date rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hostlens import fixed_values as V
from hostlens.functions.text import clean_text, col

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?\z"


def date_from_file_name(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, V.DATE_IN_FILE_NAME, 1), F.lit(""))


def flexible_timestamp(value: Column | str) -> Column:
    """Full ISO text (offset allowed), else its first 19, else its first 10 characters."""
    text = clean_text(value)

    def attempt(t: Column) -> Column:
        return F.when(t.rlike(_ISO), F.try_to_timestamp(t))

    return F.coalesce(attempt(text), attempt(F.substr(text, F.lit(1), F.lit(19))), attempt(F.substr(text, F.lit(1), F.lit(10))))


def first_date(*values: Column | str) -> Column:
    """ISO date text of the first value that can be read."""
    return F.date_format(F.coalesce(*[flexible_timestamp(v) for v in values]), "yyyy-MM-dd")


def looks_recent(*values: Column | str, today: Column | str, lookback_days: int) -> Column:
    """True when any readable date lies at or after `today` minus the look-back."""
    floor = F.date_sub(col(today).cast("date") if not isinstance(today, str) else F.lit(today).cast("date"), lookback_days)
    hit = F.lit(False)
    for v in values:
        hit = hit | F.coalesce(flexible_timestamp(v).cast("date") >= floor, F.lit(False))
    return hit
