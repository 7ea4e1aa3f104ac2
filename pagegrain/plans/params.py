"""Placeholders in filter values."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass, field, replace
from datetime import date, timedelta

from ..errors import StructureError
from .names import Names
from .spec import Filter, PageValue, SearchSpec, as_filter


@dataclass(frozen=True)
class Params:
    """The reader's situation: current page, user and day."""

    page: str = ""
    user: str = ""
    today: date = field(default_factory=date.today)
    is_start: bool = False
    user_info: dict | None = None

    @property
    def namespace(self) -> str:
        return self.page.rpartition(":")[0]


def _shift(day: date, amount: int, unit: str) -> date:
    if unit == "day":
        return day + timedelta(days=amount)
    if unit == "week":
        return day + timedelta(weeks=amount)
    months = day.year * 12 + day.month - 1 + amount * (12 if unit == "year" else 1)
    year, month = divmod(months, 12)
    # a day the month does not have runs over into the next one
    overrun = max(0, day.day - calendar.monthrange(year, month + 1)[1])
    last = date(year, month + 1, day.day - overrun)
    return last + timedelta(days=overrun)


def relative_date(text: str, today: date) -> date:
    """``now``, ``today``, ``tomorrow``, ``yesterday``, an ISO date and ``±N day|week|month|year``."""
    rest = text.strip().lower() or "now"
    words = {"now": 0, "today": 0, "tomorrow": 1, "yesterday": -1}
    day = today
    start = re.match(r"(now|today|tomorrow|yesterday|\d{4}-\d{2}-\d{2})\b", rest)
    if start:
        word = start.group(1)
        day = today + timedelta(days=words[word]) if word in words else date.fromisoformat(word)
        rest = rest[start.end() :]
    step = re.compile(r"\s*([+-]?)\s*(\d+)\s*(day|week|month|year)s?(\s+ago)?")
    while rest.strip():
        found = step.match(rest)
        if not found:
            raise StructureError(f"not a date: {text}")
        amount = int(found.group(2))
        if (found.group(1) == "-") != bool(found.group(4)):
            amount = -amount
        day = _shift(day, amount, found.group(3))
        rest = rest[found.end() :]
    return day


def bound_value(text: str, params: Params, names: Names) -> str | list[str] | PageValue:
    """Replace the placeholders of one filter value."""
    simple = {
        "$ID$": params.page,
        "$NS$": params.namespace,
        "$PAGE$": params.page.rpartition(":")[2],
        "$USER$": params.user,
        "$TODAY$": params.today.isoformat(),
        "$NSORID$": params.namespace if params.is_start else params.page,
    }
    for placeholder, replacement in simple.items():
        text = text.replace(placeholder, replacement)

    found = re.fullmatch(r"(.*?)\$STRUCT\.(.*?)\$(.*)", text, re.S)
    if found:
        before, name, after = found.groups()
        column = names.find(name, strict=True)
        if column is not None:
            return PageValue(column.table, column.label, params.page, before, after)
        table, _, label = name.partition(".")
        if table and label:
            return PageValue(table, label, params.page, before, after)
        return before + after
    found = re.fullmatch(r"(.*?)\$USER\.(.*?)\$(.*)", text, re.S)
    if found:
        key = found.group(2).lower()
        if key not in ("name", "mail", "grps"):
            raise StructureError(f"{key!r} is not a user property")
        return "" if not params.user_info else params.user_info[key]
    found = re.fullmatch(r"(.*?)\$DATE\((.*?)\)\$?(.*)", text, re.S)
    if found:
        return relative_date(found.group(2), params.today).isoformat()
    return text


def bind(spec: SearchSpec, params: Params, store) -> SearchSpec:
    """The search with all placeholders replaced."""
    names = Names(store, spec)
    bound = []
    for item in map(as_filter, spec.filters):
        if isinstance(item.value, str):
            value = bound_value(item.value, params, names)
            item = Filter(item.column, item.comparator, value, item.op)
        bound.append(item)
    return replace(spec, filters=tuple(bound), page=spec.page or params.page)
