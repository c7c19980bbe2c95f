"""Column expressions over due dates and calendar steps. The clock is always an argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import extract

_ISO = r"^(\d{4})-(\d{2})-(\d{2})"
_DAY_FIRST = r"^(\d{1,2})[-](\d{1,2})[-](\d{4})$|^(\d{1,2})[.](\d{1,2})[.](\d{4})$"


def _day_first(c: Column, pattern: str) -> Column:
    day, month, year = (F.regexp_extract(c, pattern, i) for i in (1, 2, 3))
    return F.when(c.rlike(pattern), F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))


def due_text(c: Column) -> Column:
    """Any of the three date shapes as YYYY-MM-DD text, else NULL."""
    return F.coalesce(
        F.when(c.rlike(_ISO), F.substring(c, 1, 10)),
        _day_first(c, r"^(\d{1,2})-(\d{1,2})-(\d{4})$"),
        _day_first(c, r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$"),
    )


def normalize_due_date(c: Column) -> Column:
    """The due date; free text and impossible days are unknown."""
    return F.try_to_date(due_text(c), "yyyy-MM-dd")


def format_due(c: Column) -> Column:
    """dd.mm.yyyy for a date, the text itself otherwise, NULL for nothing."""
    iso = due_text(c)
    shown = F.concat_ws(".", F.substring(iso, 9, 2), F.substring(iso, 6, 2), F.substring(iso, 1, 4))
    return F.when(c != "", F.when(iso.isNotNull(), shown).otherwise(c))


def iso_or_text(c: Column) -> Column:
    """dd.mm.yyyy re-ordered to ISO; any other text passes."""
    p = r"^(\d{2})\.(\d{2})\.(\d{4})$"
    return F.when(c != "", F.coalesce(_day_first(c, p), c))


def iso_or_null(c: Column) -> Column:
    """dd.mm.yyyy re-ordered to ISO; any other text is dropped."""
    return F.date_format(F.try_to_date(_day_first(F.trim(c), r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$"), "yyyy-MM-dd"), "yyyy-MM-dd")


def days_until(c: Column, as_of: Column | dt.date) -> Column:
    """Days to an ISO due date, negative when past; NULL for anything else."""
    ref = as_of if isinstance(as_of, Column) else F.lit(as_of)
    day = F.try_to_date(extract(c, r"^(\d{4}-\d{2}-\d{2})"), "yyyy-MM-dd")
    return F.datediff(day, ref.cast("date"))


def plus_months(d: Column, months: int) -> Column:
    """Calendar months later, a missing day rolling over into the following month."""
    m = F.month(d) - 1 + months
    first = F.make_date(F.year(d) + F.floor(m / 12).cast("int"), (m % 12 + 1).cast("int"), F.lit(1))
    return F.date_add(first, F.day(d) - 1)


def next_weekday(d: Column) -> Column:
    """The first Monday-to-Friday day after `d`."""
    dow = F.dayofweek(d)  # 1 = Sunday ... 7 = Saturday
    return F.date_add(d, F.when(dow == 6, 3).when(dow == 7, 2).otherwise(1))


def age_days(later: Column, earlier: Column) -> Column:
    """Fractional days between two UTC timestamps."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / F.lit(86_400_000_000.0)
