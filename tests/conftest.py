import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pagegrain import Schema, Store, column, tune  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return tune(session)


class Maker:
    """Builds small stores from plain records."""

    def __init__(self, spark):
        self.spark = spark
        self.store = Store(spark)

    def schema(self, name, *columns, ts=0):
        built = []
        for ref, item in enumerate(columns, 1):
            label, kind, config = (*item, None, None)[:3] if isinstance(item, tuple) else (item, None, None)
            multi = label.endswith("[]")
            built.append(
                column(ref, label.removesuffix("[]"), kind or "Text", multi, config=config, sort=ref)
            )
        return Schema(name, tuple(built), ts)

    def add(self, schema, records):
        """``records``: (pid, rid, rev, latest, published, cell, ...) with lists for multi columns."""
        names = ", ".join(f"col{c.colref} string" for c in schema.columns)
        data, multi = [], []
        for pid, rid, rev, latest, published, *cells in records:
            row = [pid, rid, rev, latest, published]
            for definition, cell in zip(schema.columns, cells):
                if definition.multi:
                    row.append(cell[0] if cell else None)
                    multi += [
                        (definition.colref, pid, rid, rev, latest, published, n, value)
                        for n, value in enumerate(cell, 1)
                    ]
                else:
                    row.append(cell)
            data.append(tuple(row))
        meta = "pid string, rid bigint, rev bigint, latest int, published int"
        values = f"colref int, {meta}, row bigint, value string"
        self.store.add(
            schema,
            self.spark.createDataFrame(data, f"{meta}, {names}"),
            self.spark.createDataFrame(multi, values),
        )
        return self.store

    def pages(self, schema, **records):
        return self.add(schema, [(pid, 0, 10, 1, None, *cells) for pid, cells in records.items()])

    def titles(self, *rows):
        fields = "pid string, title string, lasteditor string, lastrev bigint, lastsummary string"
        self.store.titles = self.spark.createDataFrame(list(rows), fields)

    def frame(self, fields, *rows):
        return self.spark.createDataFrame(list(rows), fields)


@pytest.fixture
def make(spark):
    return Maker(spark)


@pytest.fixture
def evaluate(spark):
    """Apply a column expression to some texts."""
    from pyspark.sql import functions as F

    def run(expression, *values):
        rows = [(n, value) for n, value in enumerate(values)]
        df = spark.createDataFrame(rows, "n int, c string")
        return [r["x"] for r in df.select("n", expression(F.col("c")).alias("x")).orderBy("n").collect()]

    return run
