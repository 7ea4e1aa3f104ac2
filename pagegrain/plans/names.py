"""Turns the names in a search into schema columns."""

from __future__ import annotations

from ..errors import StructureError
from ..schema import Schema, SchemaColumn, clean_table_name, pseudo_column
from ..store import Store
from .spec import Filter, SearchSpec, as_filter, normalised


class Names:
    def __init__(self, store: Store, spec: SearchSpec):
        self.schemas: list[Schema] = []
        self.aliases: dict[str, str] = {}
        for item in spec.schemas:
            name, alias = (item, "") if isinstance(item, str) else item
            schema = store.schema(name)
            if schema not in self.schemas:
                self.schemas.append(schema)
            if alias:
                self.aliases[alias] = schema.name
        if not self.schemas:
            raise StructureError("no schemas given")
        self._by_name = {schema.name: schema for schema in self.schemas}

    def _split(self, name: str) -> tuple[str, str | None]:
        table, _, label = name.partition(".")
        if not label:
            table, label = None, table
        if table:
            table = self.aliases.get(table, table)
            if table not in self._by_name and clean_table_name(table) in self._by_name:
                table = clean_table_name(table)
        if not label:
            raise StructureError("no column name given")
        return label, table

    def find(self, name: str, strict: bool = False) -> SchemaColumn | None:
        """Pseudo columns belong to the first schema; an unqualified label to the first schema that
        has it; with an unknown qualifier all schemas are tried unless ``strict``."""
        found = pseudo_column(name, self.schemas[0].name)
        if found is not None:
            return found
        label, table = self._split(name)
        if table in self._by_name:
            candidates = [self._by_name[table]]
        elif table is None or not strict:
            candidates = self.schemas
        else:
            return None
        return next((c for c in (schema.find(label) for schema in candidates) if c), None)

    def selected(self, names) -> list[SchemaColumn]:
        """Columns of a select list; unknown names are left out."""
        chosen: list[SchemaColumn] = []
        for name in names:
            if name.startswith("-"):
                chosen = [c for c in chosen if c.label != name[1:]]
                continue
            label, table = self._split(name)
            if label == "*":
                table = table or self.schemas[0].name
                if table in self._by_name:
                    chosen.extend(self._by_name[table].enabled)
                    continue
            found = self.find(name)
            if found is not None:
                chosen.append(found)
        if not chosen:
            raise StructureError("no columns given")
        return chosen

    def filters(self, items) -> list[tuple[SchemaColumn, Filter]]:
        """Filters with their columns; filters on unknown columns are left out."""
        out = []
        for item in map(as_filter, items):
            found = self.find(item.column)
            default = found.type.default_comparator if found else "="
            item = normalised(item, default)
            if found is not None:
                out.append((found, item))
        return out

    def dynamic_filters(self, items) -> list[tuple[SchemaColumn, Filter]]:
        by_column: dict[str, tuple] = {}
        for name, comparator, value in items:
            found = self.find(name)
            if found is None:
                continue
            if isinstance(value, str) and not value.strip():
                by_column.pop(found.qualified, None)
            else:
                by_column[found.qualified] = (name, comparator, value, "AND")
        return self.filters(by_column.values())

    def sorts(self, items) -> list[tuple[SchemaColumn, bool]]:
        """Sort columns and ascending flags; naming a column again changes its direction only."""
        by_column: dict[str, tuple[SchemaColumn, bool]] = {}
        for name in items:
            found = self.find(name.lstrip("^"))
            if found is not None:
                by_column[found.qualified] = (found, not name.startswith("^"))
        return list(by_column.values())
