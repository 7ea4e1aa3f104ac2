import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType())])
# an input column for each name that some operator uses inside
CLASHES = ["row", "fp", "id", "base", "gram", "n", "key", "size", "shard", "slot", "cut", "spans", "found", "label", "words", "h", "crc"]


@pytest.fixture(scope="session")
def documents(spark):
    """A table of (doc_id, text[, lang]) with further columns whose names clash with inner ones."""

    def make(rows, clash=True):
        df = spark.createDataFrame([(*r, *[None] * (3 - len(r))) for r in rows], DOCS)
        if clash:
            df = df.selectExpr("*", *[f"'{c}' AS `{c}`" for c in CLASHES])
        return df

    return make
