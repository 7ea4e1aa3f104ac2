"""What to search for."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from ..errors import StructureError

COMPARATORS = ("<=", ">=", "=*", "=", "<", ">", "!=", "!~", "~", "IN")


@dataclass(frozen=True)
class PageValue:
    """Operand: the value(s) another column has on one page, each between two texts."""

    schema: str
    label: str
    page: str
    before: str = ""
    after: str = ""


@dataclass(frozen=True)
class Filter:
    """``op`` links the filter to the one before it; the chain has the precedence of SQL."""

    column: str
    comparator: str
    value: str | list[str] | PageValue
    op: str = "AND"


def as_filter(item: Filter | tuple) -> Filter:
    return item if isinstance(item, Filter) else Filter(*item)


def normalised(item: Filter, default_comparator: str) -> Filter:
    """Reduce the comparators to the basic ones."""
    comparator, value = item.comparator.strip() or default_comparator, item.value
    if comparator == "*~":
        comparator = "~"
        if isinstance(value, PageValue):
            value = replace(value, before="*" + value.before, after=value.after + "*")
        elif isinstance(value, (list, tuple)):
            value = [f"*{part}*" for part in value]
        else:
            value = f"*{value}*"
    elif comparator == "<>":
        comparator = "!="
    if comparator not in COMPARATORS:
        raise StructureError(f"bad comparator {comparator!r}, use one of {', '.join(COMPARATORS)}")
    if item.op not in ("AND", "OR"):
        raise StructureError("filters are linked by AND or OR only")
    if comparator == "IN":
        comparator = "="
    return Filter(item.column, comparator, value, item.op)


@dataclass(frozen=True)
class SearchSpec:
    """A search.

    ``schemas``   names or ``(name, alias)`` pairs, joined on the page
    ``columns``   labels, ``alias.label``, ``*``, ``alias.*``, ``-label`` or ``%pseudo%``
    ``filters``   :class:`Filter` or tuples ``(column, comparator, value[, op])``
    ``sorts``     labels, ``^label`` for descending
    ``latest``    False reads all revisions
    ``publisher`` True sees latest rows, False only published ones, a text names a column of the
                  ``pages`` table that decides per page
    ``kind``      None, ``"global"`` or ``"serial"`` (rows of ``page``)
    """

    schemas: tuple
    columns: tuple
    filters: tuple = ()
    sorts: tuple = ()
    limit: int = 0
    offset: int = 0
    latest: bool = True
    publisher: bool | str = True
    kind: str | None = None
    page: str = ""
    dynamic_filters: tuple = ()

    def with_dynamic(
        self,
        filters: Iterable[tuple[str, str, str]] = (),
        sort: str | None = None,
        offset: int | None = None,
    ) -> SearchSpec:
        """Add a reader's own filters, sorting and paging.

        The filters form their own bracket after the fixed ones, with one filter per column: a later
        one replaces an earlier one and a blank value removes it. A sort replaces all fixed sorts.
        """
        spec = replace(self, dynamic_filters=tuple(filters))
        if sort:
            spec = replace(spec, sorts=(sort,))
        if offset:
            spec = replace(spec, offset=offset)
        return spec
