"""A DataFrame under construction that remembers which tables are already joined to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import Cell
from ..functions.refs import referenced_page, referenced_row
from ..schema import SchemaColumn
from ..store import DATA_META, Store

TITLE_FIELDS = ["pid", "title", "lasteditor", "lastrev", "lastsummary"]


def prefixed(df: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    return df.select(*columns).toDF(*[prefix + name for name in columns])


class Relation:
    """Adds each left join once per value and hands out columns of the joined side.

    The joins are plain equi-joins without hints: Catalyst drops unused columns, and AQE chooses
    broadcast, hash or sort-merge from measured sizes and splits skewed keys.
    """

    def __init__(self, store: Store, df: DataFrame):
        self.store = store
        self.df = df
        self._joined: dict[str, str] = {}

    def copy(self) -> Relation:
        other = Relation(self.store, self.df)
        other._joined = dict(self._joined)
        return other

    @property
    def joins(self) -> int:
        return len(self._joined)

    def _once(self, name: str, attach) -> str:
        if name not in self._joined:
            prefix = f"j{len(self._joined)}__"
            self._joined[name] = prefix
            self.df = attach(prefix)
        return self._joined[name]

    def title(self, cell: Cell, field: str) -> Column:
        """Page metadata of the page named by the cell."""
        if self.store.titles is None:
            return F.lit(None).cast("bigint" if field == "lastrev" else "string")

        def attach(prefix: str) -> DataFrame:
            titles = prefixed(self.store.titles, prefix, TITLE_FIELDS)
            return self.df.join(titles, cell.value == F.col(prefix + "pid"), "left")

        return F.col(self._once(f"titles of {cell.key}", attach) + field)

    def referenced(self, cell: Cell, target: SchemaColumn) -> Cell:
        """Cell of the row a reference points to (its latest state)."""

        def attach(prefix: str) -> DataFrame:
            schema = self.store.schema(target.table)
            names = DATA_META + [c.physical for c in schema.columns]
            rows = self.store.data(target.table).filter(F.col("latest") == 1)
            rows = prefixed(rows, prefix, names)
            same_page = referenced_page(cell.value) == F.col(prefix + "pid")
            same_row = referenced_row(cell.value) == F.col(prefix + "rid")
            return self.df.join(rows, same_page & same_row, "left")

        prefix = self._once(f"{target.table} row of {cell.key}", attach)
        name = prefix + target.physical
        return Cell(F.col(name), name, prefix, cell.visited | {(target.table, target.label)})
