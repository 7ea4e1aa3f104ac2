"""A store on disk.

Data and value tables are written as Parquet partitioned by ``latest``, so reads of the current state
skip history at the file listing. A store is always written to a new folder, never over one that is
being read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import Schema
from ..store import DATA_META, MULTI_COLUMNS, Store

PAGE_TABLES = ["titles", "pages", "assignments", "users"]


def write_store(store: Store, path: str) -> None:
    for name in store.schemas:
        store.data(name).write.partitionBy("latest").parquet(f"{path}/data_{name}")
        if any(c.multi for c in store.schema(name).columns):
            store.multi(name).write.partitionBy("latest").parquet(f"{path}/multi_{name}")
    for table in PAGE_TABLES:
        rows = getattr(store, table)
        if rows is not None:
            rows.write.parquet(f"{path}/{table}")


def _columns(schema: Schema) -> list[str]:
    return DATA_META + [c.physical for c in sorted(schema.columns, key=lambda c: c.colref)]


def read_store(
    spark: SparkSession, path: str, schemas: list[Schema], page_tables: tuple[str, ...] = ()
) -> Store:
    """Open a written store; ``page_tables`` names the page tables it has."""
    store = Store(spark)
    for schema in schemas:
        data = spark.read.parquet(f"{path}/data_{schema.name}").select(*_columns(schema))
        multi = None
        if any(c.multi for c in schema.columns):
            multi = spark.read.parquet(f"{path}/multi_{schema.name}").select(*MULTI_COLUMNS)
        store.add(schema, data, multi)
    for table in page_tables:
        setattr(store, table, spark.read.parquet(f"{path}/{table}"))
    return store


def save_bucketed(store: Store, database: str, buckets: int) -> None:
    """Save the tables of a store bucketed by page, for joins on the page without a shuffle.

    Suits stores in which no single page holds a large share of the rows.
    """

    def save(rows: DataFrame, table: str) -> None:
        rows.write.bucketBy(buckets, "pid").sortBy("pid").saveAsTable(f"{database}.{table}")

    for name in store.schemas:
        save(store.data(name), f"data_{name}")
        if any(c.multi for c in store.schema(name).columns):
            save(store.multi(name), f"multi_{name}")
    for table in PAGE_TABLES[:3]:
        rows = getattr(store, table)
        if rows is not None:
            save(rows, table)


def open_tables(
    spark: SparkSession, database: str, schemas: list[Schema], page_tables: tuple[str, ...] = ()
) -> Store:
    store = Store(spark)
    for schema in schemas:
        multi = None
        if any(c.multi for c in schema.columns):
            multi = spark.table(f"{database}.multi_{schema.name}").select(*MULTI_COLUMNS)
        data = spark.table(f"{database}.data_{schema.name}").select(*_columns(schema))
        store.add(schema, data, multi)
    for table in page_tables:
        setattr(store, table, spark.table(f"{database}.{table}"))
    return store
