"""Schema definitions as tables.

``schemas``     id, tbl, ts, user, comment, config
``types``       id, class, ismulti, label, config
``schema_cols`` sid, colref, enabled, tid, sort
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import type_named
from ..errors import StructureError
from ..schema import Schema, SchemaColumn, clean_table_name

SCHEMAS = "id bigint, tbl string, ts bigint, user string, comment string, config string"
TYPES = "id bigint, class string, ismulti int, label string, config string"
SCHEMA_COLS = "sid bigint, colref int, enabled int, tid bigint, sort int"


@dataclass
class Registry:
    schemas: DataFrame
    types: DataFrame
    schema_cols: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Registry:
        make = spark.createDataFrame
        return cls(make([], SCHEMAS), make([], TYPES), make([], SCHEMA_COLS))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Registry:
        return cls(*[spark.read.parquet(f"{path}/{n}") for n in ("schemas", "types", "schema_cols")])

    def write(self, path: str) -> None:
        for name in ("schemas", "types", "schema_cols"):
            getattr(self, name).coalesce(1).write.parquet(f"{path}/{name}")

    def versions_at(self, ts: int = 0) -> DataFrame:
        """The version of every schema at a time: the newest until then, else the newest of all."""
        in_time = F.lit(True) if not ts else F.col("ts") <= ts
        rank = F.struct(in_time.cast("int").alias("in_time"), "ts", "id")
        best = self.schemas.groupBy("tbl").agg(F.max_by(F.struct("id", "ts", "user", "config"), rank).alias("v"))
        return best.select("tbl", "v.*")

    def definition(self, ts: int = 0) -> DataFrame:
        """Column definitions of :meth:`versions_at`, one row per column."""
        cols = self.schema_cols.join(
            self.types.withColumnsRenamed({"id": "tid", "config": "col_config"}), "tid"
        )
        return self.versions_at(ts).withColumnRenamed("id", "sid").join(cols, "sid", "left")

    def load(self, name: str, ts: int = 0) -> Schema:
        """Read one schema; definitions are small and live on the driver from here on."""
        key = clean_table_name(name)
        rows = self.definition(ts).filter(F.col("tbl") == key).collect()
        if not rows:
            raise StructureError(f"schema missing: {name}")
        columns = [
            SchemaColumn(
                row["colref"],
                row["label"],
                type_named(row["class"], json.loads(row["col_config"] or "{}")),
                bool(row["ismulti"]),
                bool(row["enabled"]),
                row["sort"],
            )
            for row in rows
            if row["colref"] is not None
        ]
        head = rows[0]
        config = json.loads(head["config"] or "{}")
        return Schema(key, tuple(columns), head["ts"], head["sid"], head["user"] or "", config)

    def with_version(self, schema: Schema, comment: str = "") -> tuple[Registry, Schema]:
        """The registry with one more version of a schema, and that version with its new id."""
        spark = self.schemas.sparkSession
        next_id = self.schemas.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]
        next_type = self.types.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]
        saved = replace(schema, id=next_id)
        head = [(next_id, schema.name, schema.ts, schema.user, comment, json.dumps(schema.config))]
        types, cols = [], []
        for n, c in enumerate(saved.columns):
            tid = next_type + n
            types.append((tid, c.type.name, int(c.multi), c.label, json.dumps(c.type.config)))
            cols.append((next_id, c.colref, int(c.enabled), tid, c.sort))
        grown = Registry(
            self.schemas.unionByName(spark.createDataFrame(head, SCHEMAS)),
            self.types.unionByName(spark.createDataFrame(types, TYPES)),
            self.schema_cols.unionByName(spark.createDataFrame(cols, SCHEMA_COLS)),
        )
        return grown, saved
