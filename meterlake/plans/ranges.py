"""One resolver for every date range. All ranges are relative to an explicit business day."""

from __future__ import annotations

import re
from datetime import date, timedelta

_DAY = re.compile(r"^\d{4}-\d{2}-\d{2}$")


def is_day(text: str) -> bool:
    return bool(_DAY.match(text or ""))


def week_start(day: date) -> date:
    """Monday of the day's week."""
    return day - timedelta(days=day.weekday())


def month_start(day: date, back: int = 0) -> date:
    months = day.year * 12 + day.month - 1 - back
    return date(months // 12, months % 12 + 1, 1)


def trailing(day: date, n: int) -> tuple[date, date]:
    return day - timedelta(days=n - 1), day


def resolve_range(name: str, business_day: date, start: str | None = None, end: str | None = None, default: str = "today") -> tuple[date, date] | None:
    """First and last day of a named range; None stands for all days.

    A custom pair of days wins over the name; a reversed pair gives an empty range (first after
    last). Unknown names resolve as ``default``. ``a..b``, ``a..`` and ``..b`` are open ranges.
    """
    if start and end and is_day(start) and is_day(end):
        return date.fromisoformat(start), date.fromisoformat(end)
    if ".." in (name or ""):
        a, b = name.split("..", 1)
        return (date.fromisoformat(a) if is_day(a) else date.min), (date.fromisoformat(b) if is_day(b) else date.max)
    monday, first = week_start(business_day), month_start(business_day)
    named = {
        "today": (business_day, business_day),
        "yesterday": (business_day - timedelta(days=1),) * 2,
        "this_week": (monday, business_day),
        "last_week": (monday - timedelta(days=7), monday - timedelta(days=1)),
        "this_month": (first, business_day),
        "month": (first, business_day),
        "last_month": (month_start(business_day, 1), first - timedelta(days=1)),
        "last7": trailing(business_day, 7),
        "7d": trailing(business_day, 7),
        "last30": trailing(business_day, 30),
        "30d": trailing(business_day, 30),
        "last12_weeks": (monday - timedelta(days=77), business_day),
        "last12_months": (month_start(business_day, 11), business_day),
    }
    if name in ("all", "", None):
        return None
    return named.get(name) or named.get(default) or named["today"]


def trend_grain(name: str) -> str:
    """Grain of an overview's trend for a range."""
    return {"today": "hour", "7d": "day", "last7": "day", "30d": "week", "last30": "week"}.get(name, "month")


def share_bounds(period: str, business_day: date) -> tuple[date, date]:
    """First and last day of a share card's period; an unknown one is the day itself."""
    named = ("today", "this_week", "last_week", "this_month", "last_month", "7d", "30d")
    return resolve_range(period if period in named else "today", business_day) or (business_day, business_day)


def share_grain(period: str) -> str:
    """Grain of a share card's trend."""
    return {"today": "hour", "30d": "week", "this_month": "week", "last_month": "week", "all": "month"}.get(period, "day")


def board_range(text: str) -> dict[str, str]:
    """What a board is asked for by a range given as text: a named range, or a pair of days of which one may be left out."""
    if text in ("today", "yesterday", "7d", "last7", "30d", "last30", "all"):
        return {"range": text}
    first, dots, last = text.partition("..")
    if dots and all(not x or _possible(x) for x in (first, last)):
        return {"range": "custom", **{k: v for k, v in (("start", first), ("end", last)) if v}}
    raise ValueError(f"not a range: {text!r}; use today, yesterday, 7d, 30d, all or YYYY-MM-DD..YYYY-MM-DD")


def _possible(text: str) -> bool:
    return is_day(text) and text.isascii() and 1 <= int(text[5:7]) <= 12 and 1 <= int(text[8:]) <= 31
