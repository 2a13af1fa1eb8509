"""Syslog-style stamp (``Mon d HH:MM:SS``, no year) → record date fields.

The stamp is read the way ``datetime.strptime('%Y %b %d %H:%M:%S')`` reads
``'<year>  <stamp>'``: English three-letter month in any case, day 1-31 with
an optional leading zero, hour 00-23, minute and second 00-59, and the date
must exist in the given year.  The work is pure string and integer
arithmetic (no timestamp parsing), so it stays in generated code.
"""

from __future__ import annotations

import calendar

from pyspark.sql import Column
from pyspark.sql import functions as F

from logtab.functions.text import DIGIT, FLAGS, ascii_digits

# English month abbreviations, in calendar order.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# Accepted spellings of day and time fields (the strptime directive ranges).
DAY_TIME_FORM = (
    rf"{FLAGS}^(?:3[01]|[12]{DIGIT}|0[1-9]|[1-9]) "
    rf"(?:2[0-3]|[01]{DIGIT}):[0-5]{DIGIT}:[0-5]{DIGIT}$"
)

BAD_DATE_MODES = ("fail", "reject", "null")


def _month_number(mon: Column) -> Column:
    # U+017F LATIN SMALL LETTER LONG S folds to 's' under case-insensitive matching.
    lookup = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, start=1) for x in (m, i)])
    return lookup[F.lower(F.translate(mon, "ſ", "s"))]


def stamp_fields(mon: Column, day: Column, hh: Column, mi: Column, ss: Column, year: int):
    """Return ``(ok, compact, iso)``.

    ``ok`` is true when the stamp names a real instant in ``year``;
    ``compact`` is ``yyyyMMddHHmmss`` and ``iso`` is ``yyyy-MM-dd HH:mm:ss``
    (both strings, meaningful only where ``ok``).
    """
    if not 1000 <= year <= 9999:
        raise ValueError("year must have four digits")
    month = _month_number(mon)
    d = ascii_digits(day).try_cast("int")
    feb = 29 if calendar.isleap(year) else 28
    last_day = (F.when(month == 2, feb)
                .when(month.isin(4, 6, 9, 11), 30)
                .otherwise(31))
    form_ok = F.concat_ws(" ", day, F.concat_ws(":", hh, mi, ss)).rlike(DAY_TIME_FORM)
    ok = F.coalesce(month.isNotNull() & form_ok & (d <= last_day), F.lit(False))
    y = F.lit(str(year))
    mm = F.lpad(month.cast("string"), 2, "0")
    dd = F.lpad(d.cast("string"), 2, "0")
    h, m, s = ascii_digits(hh), ascii_digits(mi), ascii_digits(ss)
    compact = F.concat(y, mm, dd, h, m, s)
    iso = F.concat(y, F.lit("-"), mm, F.lit("-"), dd, F.lit(" "), h, F.lit(":"), m, F.lit(":"), s)
    return ok, compact, iso
