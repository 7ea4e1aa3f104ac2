"""New versions of a schema."""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..columns import type_named
from ..schema import Schema, SchemaColumn


@dataclass(frozen=True)
class Evolution:
    """A new version and what it asks of the data: columns to add, columns to turn into lists."""

    schema: Schema
    added: list[int]
    to_lists: list[int]


def _unique(label: str, taken: set[str]) -> str:
    label = label.strip()
    free, n = label, 0
    while free.lower() in taken:
        n += 1
        free = f"{label}{n}"
    taken.add(free.lower())
    return free


def _defined(colref: int, label: str, item: dict, enabled: bool) -> SchemaColumn:
    return SchemaColumn(
        colref,
        label,
        type_named(item["class"], item.get("config") or {}),
        bool(item.get("ismulti", False)),
        enabled,
        int(item.get("sort", 0)),
    )


def evolve(
    old: Schema | None,
    name: str,
    updates: dict[int, dict],
    new: list[dict],
    ts: int,
    user: str = "",
    config: dict | None = None,
) -> Evolution:
    """Build the next version.

    ``updates`` redefines columns by ``colref``; columns it does not name are kept but disabled. ``new``
    columns get the following colrefs, unless they are disabled or have no label. Labels that repeat
    get a number.
    """
    taken: set[str] = set()
    labels = {ref: _unique(item["label"], taken) for ref, item in updates.items()}
    fresh = [(item, _unique(item.get("label", ""), taken)) for item in new]
    existing = list(old.columns) if old else []
    columns, to_lists = [], []
    for column in existing:
        item = updates.get(column.colref)
        if item is None:
            columns.append(replace(column, enabled=False))
            continue
        enabled = bool(item.get("isenabled", False))
        changed = _defined(column.colref, labels[column.colref], item, enabled)
        columns.append(changed)
        if changed.multi and not column.multi:
            to_lists.append(column.colref)
    added, colref = [], len(existing) + 1
    for item, label in fresh:
        if not item.get("isenabled", False) or not item.get("label", "").strip():
            continue
        columns.append(_defined(colref, label, item, True))
        added.append(colref)
        colref += 1
    schema = Schema(name, tuple(columns), ts, user=user, config=config or {})
    return Evolution(schema, added, to_lists)
