"""Schemas: named, versioned lists of typed columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from .columns import (
    AutoSummary,
    ColumnType,
    Decimal,
    LastEditor,
    LastUpdate,
    Page,
    type_named,
)


def clean_table_name(name: str) -> str:
    """Lower case, only ``[a-z0-9_]``, no leading digits or underscores."""
    return re.sub(r"^[0-9_]+", "", re.sub(r"[^a-z0-9_]+", "", name.lower()))


@dataclass(frozen=True)
class SchemaColumn:
    """A column of a schema; ``source`` is its physical name in the data table."""

    colref: int
    label: str
    type: ColumnType
    multi: bool = False
    enabled: bool = True
    sort: int = 0
    table: str = ""
    source: str = ""
    pseudo: bool = False

    @property
    def physical(self) -> str:
        return self.source or f"col{self.colref}"

    @property
    def qualified(self) -> str:
        return self.label if self.pseudo else f"{self.table}.{self.label}"


def column(colref: int, label: str, class_name: str = "Text", multi: bool = False, **extra) -> SchemaColumn:
    config = extra.pop("config", None)
    return SchemaColumn(colref, label, type_named(class_name, config), multi, **extra)


def pseudo_column(label: str, table: str) -> SchemaColumn | None:
    """Columns every schema has: page id, page metadata, row id, published state."""
    known = {
        "%pageid%": ("pid", Page()),
        "%title%": ("pid", Page({"usetitles": True})),
        "%lastupdate%": ("pid", LastUpdate()),
        "%lasteditor%": ("pid", LastEditor()),
        "%lastsummary%": ("pid", AutoSummary()),
        "%rowid%": ("rid", Decimal()),
        "%published%": ("published", Decimal()),
    }
    if label not in known:
        return None
    source, kind = known[label]
    return SchemaColumn(0, label, kind, table=table, source=source, pseudo=True)


@dataclass(frozen=True)
class Schema:
    """One version of a schema."""

    name: str
    columns: tuple[SchemaColumn, ...]
    ts: int = 0
    id: int = 1
    user: str = ""
    config: dict = field(default_factory=dict)

    def __post_init__(self):
        object.__setattr__(self, "name", clean_table_name(self.name))
        owned = sorted((replace(c, table=self.name) for c in self.columns), key=lambda c: c.sort)
        object.__setattr__(self, "columns", tuple(owned))

    @property
    def enabled(self) -> list[SchemaColumn]:
        return [c for c in self.columns if c.enabled]

    def find(self, label: str) -> SchemaColumn | None:
        """Enabled column by label, ignoring case."""
        wanted = label.lower()
        return next((c for c in self.enabled if c.label.lower() == wanted), None)
