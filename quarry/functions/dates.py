"""Date helpers (FIL-4/5, FN-2..5).

``as_of`` is always a parameter, never the clock, so results are reproducible.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PERIOD = re.compile(r"^(\d+)d$")


def parse_period(period: str) -> int:
    """FN-3: ``"30d"`` -> 30.  Anything else (``30``, ``d``, ``1w``, ``-5d``) raises."""
    m = _PERIOD.match(period or "")
    if not m:
        raise ValueError(f"a period is a number of days such as 30d, not {period!r}")
    return int(m.group(1))


def _as_date(v) -> dt.date:
    if isinstance(v, dt.datetime):
        return v.date()
    if isinstance(v, dt.date):
        return v
    if isinstance(v, (tuple, list)):
        return dt.date(*v)
    return dt.date.fromisoformat(str(v)[:10])


def date_window(col, start=None, end=None) -> Column:
    """FIL-5: inclusive date-grain window; ``None`` bounds are open.  Bounds may be
    ISO strings, dates or ``(y, m, d)`` tuples."""
    d = F.to_date(F.col(col) if isinstance(col, str) else col)
    cond = F.lit(True)
    if start is not None:
        cond = cond & (d >= F.lit(_as_date(start)))
    if end is not None:
        cond = cond & (d <= F.lit(_as_date(end)))
    return cond


def period_window(col, period: str | None, as_of, start=None, end=None) -> Column:
    """FIL-4: a valid period overrides ``start``/``end`` with ``[as_of - n days, as_of]``."""
    if period is not None:
        n = parse_period(period)
        a = _as_date(as_of)
        return date_window(col, a - dt.timedelta(days=n), a)
    return date_window(col, start, end)


def file_safe_timestamp(ts) -> Column:
    """FN-2: ``YYYY-mm-dd_HH-MM-SS`` (fraction dropped)."""
    return F.date_format(F.col(ts) if isinstance(ts, str) else ts, "yyyy-MM-dd_HH-mm-ss")


def parse_timestamp(col) -> Column:
    """FN-5: ``'2023-11-01 00:00:00+00:00'``-style strings -> TIMESTAMP (NULL if malformed)."""
    return F.try_to_timestamp(F.col(col) if isinstance(col, str) else col)


def timestamp_string(col) -> Column:
    """FN-5: TIMESTAMP -> ``yyyy-MM-dd HH:mm:ss`` string."""
    return F.date_format(F.col(col) if isinstance(col, str) else col, "yyyy-MM-dd HH:mm:ss")
