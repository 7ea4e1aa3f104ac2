"""The tables a query reads: one data and one multi-value table per schema, plus page tables.

``data_<schema>``  pid, rid, rev, latest, published, col1..colN
``multi_<schema>`` colref, pid, rid, rev, latest, published, row, value
``titles``         pid, title, lasteditor, lastrev, lastsummary
``pages``          pid, exists, access_level[, publisher]
``assignments``    pid, tbl, assigned
``users``          login, name

Tables that are not given switch off the check that needs them. A data or value table may be given as
a function that opens it; it is called when a query first needs the table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .errors import StructureError
from .schema import Schema, SchemaColumn, clean_table_name, pseudo_column

Table = DataFrame | Callable[[], DataFrame]

DATA_KEYS = ["pid", "rid", "rev"]
DATA_META = ["pid", "rid", "rev", "latest", "published"]
MULTI_COLUMNS = ["colref", "pid", "rid", "rev", "latest", "published", "row", "value"]


@dataclass
class Store:
    spark: SparkSession
    schemas: dict[str, Schema] = field(default_factory=dict)
    data_tables: dict[str, Table] = field(default_factory=dict)
    multi_tables: dict[str, Table] = field(default_factory=dict)
    titles: DataFrame | None = None
    pages: DataFrame | None = None
    assignments: DataFrame | None = None
    users: DataFrame | None = None
    language: str = "en"

    def add(self, schema: Schema, data: Table, multi: Table | None = None) -> Store:
        self.schemas[schema.name] = schema
        self.data_tables[schema.name] = data
        if multi is not None:
            self.multi_tables[schema.name] = multi
        return self

    def schema(self, name: str) -> Schema:
        key = clean_table_name(name)
        if key not in self.schemas:
            raise StructureError(f"schema missing: {name}")
        return self.schemas[key]

    @staticmethod
    def _opened(tables: dict[str, Table], key: str) -> DataFrame:
        if not isinstance(tables[key], DataFrame):
            tables[key] = tables[key]()
        return tables[key]

    def data(self, name: str) -> DataFrame:
        return self._opened(self.data_tables, self.schema(name).name)

    def multi(self, name: str) -> DataFrame:
        key = self.schema(name).name
        if key not in self.multi_tables:
            empty = (
                "colref int, pid string, rid bigint, rev bigint, "
                "latest int, published int, row bigint, value string"
            )
            self.multi_tables[key] = self.spark.createDataFrame([], empty)
        return self._opened(self.multi_tables, key)

    def reference_target(self, schema_name: str, label: str) -> SchemaColumn | None:
        """Column behind a reference; ``$LANG`` in the label picks a language column."""
        key = clean_table_name(schema_name)
        if key not in self.schemas:
            return None
        schema = self.schemas[key]
        found = schema.find(label.replace("$LANG", self.language))
        found = found or schema.find(label.replace("$LANG", "en"))
        found = found or pseudo_column(label, schema.name)
        if found is not None and (found.multi or label == "%published%"):
            return None
        return found
