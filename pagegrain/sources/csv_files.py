"""CSV exchange."""

from __future__ import annotations

import csv
import io
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..errors import StructureError
from ..functions.ids import clean_id
from ..functions.names import quoted
from ..functions.text import split_list
from ..operators.aggregate import text_rows
from ..operators.assignment import with_assignments
from ..operators.revisions import save_revisions
from ..operators.rows import save_rows
from ..operators.validation import changed_only, split_valid, validated
from ..plans.search import Search
from ..plans.spec import SearchSpec
from ..store import Store

KINDS = ("page", "global", "serial")
LINE = "line"
# Headers read at a time.
READERS = 16


def _header(spark: SparkSession, conf, file: str, multiline: bool) -> tuple[str, ...]:
    """The cells of a file's first line; none in an empty file."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        reader = jvm.org.apache.hadoop.util.LineReader(codec.createInputStream(stream) if codec else stream)
        line, text = jvm.org.apache.hadoop.io.Text(), ""
        while reader.readLine(line):
            text += line.toString() + "\n"
            if not multiline or text.count('"') % 2 == 0:
                break
    finally:
        stream.close()
    return tuple(next(csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline="")), ()))


def files_by_header(spark: SparkSession, path: str, multiline: bool = False) -> dict[tuple[str, ...], list[str]]:
    """The CSV files of a path by the cells of their first lines. Only those lines are read, one for each file."""
    files = sorted(spark.read.text(path).inputFiles())
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    with ThreadPoolExecutor(READERS) as pool:
        headers = list(pool.map(lambda file: _header(spark, conf, file, multiline), files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, header in zip(files, headers, strict=True):
        if header:
            groups.setdefault(header, []).append(unquote(file))
    return groups


def _labels(header: tuple[str, ...]) -> dict[str, int]:
    """Names with their places. Of equal ones, whatever their case, the first counts; blank names and ``line`` are left out."""
    seen = {"", LINE}
    return {name: n for n, name in enumerate(header) if not (name.lower() in seen or seen.add(name.lower()))}


def read_rows(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Raw rows of CSV files, all text, with ``line``: a unique text for each row that sorts in reading order, by file, then by place in it.

    Every file has a header of its own; the cells go to the names there, and files with one header are one scan. A
    column that a file does not have is empty in its rows. Empty cells are empty texts; a cell is NULL only where
    a row is too short to have it. Large files are read in splits. ``multiline`` allows line breaks inside quotes; then
    a file is read as a whole.
    """
    groups = files_by_header(spark, path, multiline)
    if not groups:
        raise StructureError("the CSV has no header")
    # names that differ in case are one column, spelt as in the first file
    names = {}
    for header in groups:
        names |= {name.lower(): names.get(name.lower(), name) for name in _labels(header)}
    frames = [_scan(spark, header, files, names, multiline) for header, files in groups.items()]
    return reduce(DataFrame.unionByName, frames)


def _scan(spark: SparkSession, header: tuple[str, ...], files: list[str], names: dict[str, str], multiline: bool) -> DataFrame:
    # a row with another number of cells than the header is handed over as it stands as well
    whole = "_whole_row"
    fields = [StructField(f"_{n}", StringType()) for n in range(len(header))]
    read = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multiline)
    # with columns left out Spark does not see that a row is short
    read = read.option("columnPruning", False).schema(StructType([*fields, StructField(whole, StringType())]))
    rows = read.option("columnNameOfCorruptRecord", whole).csv(files)
    short = F.col(whole).isNotNull() & F.col(fields[-1].name).isNull()
    places, cells = {name.lower(): n for name, n in _labels(header).items()}, []
    for name, spelt in names.items():
        if name not in places:
            cells.append(F.lit("").alias(spelt))
            continue
        cell = F.col(f"_{places[name]}")
        cells.append(F.when(short | cell.isNotNull(), cell).otherwise(F.lit("")).alias(spelt))
    # a split is read by one task from its first row to its last; the id's lower 33 bits count the task's rows
    offset = F.lpad(F.col("_metadata.file_block_start").cast("string"), 15, "0")
    place = F.lpad(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).cast("string"), 10, "0")
    return rows.select(*cells, F.concat_ws(":", "_metadata.file_path", offset, place).alias(LINE))


def multi_cell(cell: Column) -> Column:
    """Values of a multi-valued cell; references contain commas and are split between brackets."""
    return F.when(F.startswith(cell, F.lit("[")), F.split(cell, r",(?=\[)")).otherwise(split_list(cell))


def import_columns(store: Store, schema_name: str, rows: DataFrame, kind: str) -> DataFrame:
    """Raw rows as ``line``, ``pid`` (not for global rows) and cells by label.

    Unknown headers and disabled columns are left out; multi-valued cells become lists. A row that
    lacks a field (NULL) gets ``missing``, the labels it lacks.
    """
    if kind not in KINDS:
        raise StructureError(f"unknown kind of rows {kind!r}")
    schema = store.schema(schema_name)
    if kind != "global" and "pid" not in rows.columns:
        raise StructureError("the CSV has no pid column")
    out, lacking, seen = [F.col("line")], [], set()
    if kind != "global":
        out.append(clean_id(F.coalesce("pid", F.lit(""))).alias("pid"))
    for name in rows.columns:
        column = schema.find(name) if name not in ("pid", "line") else None
        if column is None or column.colref in seen:
            continue
        seen.add(column.colref)
        cell = F.col(f"`{name}`")
        lacking.append(F.when(cell.isNull(), F.lit(column.label)))
        out.append((multi_cell(cell) if column.multi else cell).alias(column.label))
    if not seen:
        raise StructureError("no header matches a column of the schema")
    return rows.select(*out, F.array_compact(F.array(*lacking)).alias("missing"))


def page_row_errors(rows: DataFrame, pages: DataFrame, create: bool = False) -> DataFrame:
    """Rows with ``error``: NULL, or why a page row cannot be loaded.

    The first row of a page counts. A page has to exist, unless missing ones are to be created; rows
    for such pages may repeat.
    """
    existing = pages.filter(F.col("exists") == 1).select(F.col("pid").alias("p_pid")).distinct()
    first = rows.groupBy("pid").agg(F.min("line").alias("f_line")).withColumnRenamed("pid", "f_pid")
    first = first.join(existing, F.col("f_pid") == F.col("p_pid"), "left")
    joined = rows.join(first, F.col("pid") == F.col("f_pid"), "left")
    here = F.col("p_pid").isNotNull()
    repeated = F.concat(F.lit('Page "'), "pid", F.lit('" already imported'))
    unknown = F.concat(F.lit('Page "'), "pid", F.lit('" does not exist'))
    error = F.when(here & (F.col("line") != F.col("f_line")), repeated)
    if not create:
        error = error.when(~here, unknown)
    return joined.withColumn("error", error).select(*quoted(rows.columns), "error")


def with_pages(pages: DataFrame, made: DataFrame) -> DataFrame:
    """Page table in which some pages exist; new ones are readable."""
    made = made.select(F.col("pid").alias("m_pid")).distinct()
    joined = pages.join(made, F.col("pid") == F.col("m_pid"), "full")
    is_made, is_new = F.col("m_pid").isNotNull(), F.col("pid").isNull()
    given = {
        "pid": F.coalesce("pid", "m_pid"),
        "exists": F.when(is_made, F.lit(1)).otherwise(F.col("exists")),
        "access_level": F.when(is_new, F.lit(1)).otherwise(F.col("access_level")),
    }
    return joined.select(*[given.get(c, F.col(f"`{c}`")).alias(c) for c in pages.columns])


def import_csv(
    store: Store,
    schema_name: str,
    rows: DataFrame,
    kind: str,
    ts: int = 0,
    create_pages: bool = False,
    key: str = "line",
) -> tuple[Store, DataFrame]:
    """Load raw rows (from :func:`read_rows`); returns the grown store and the rejected rows.

    Page rows become revisions at ``ts``, where they differ from what is stored, and the schema is
    assigned to their pages. Rejected rows are ``line`` and ``errors``.
    """
    schema = store.schema(schema_name)
    cells = import_columns(store, schema_name, rows, kind)
    lacking = F.concat(F.lit("missing field "), F.array_join("missing", ", "))
    bad = cells.filter(F.size("missing") > 0).select(key, F.array(lacking).alias("errors"))
    good = cells.filter(F.size("missing") == 0).drop("missing")
    if kind == "page":
        if store.pages is not None:
            judged = page_row_errors(good, store.pages, create_pages)
            refused = judged.filter(F.col("error").isNotNull())
            bad = bad.unionByName(refused.select(key, F.array("error").alias("errors")))
            good = judged.filter(F.col("error").isNull()).drop("error")
    keys = [key] if kind == "global" else [key, "pid"]
    accepted, rejected = split_valid(validated(good, schema, keys, store.users))
    bad = bad.unionByName(rejected.select(key, "errors"))
    grown = Store(**{name: getattr(store, name) for name in store.__dataclass_fields__})
    grown.data_tables, grown.multi_tables = dict(store.data_tables), dict(store.multi_tables)
    if kind == "page":
        # of the rows of a created page the last one stays
        last = accepted.groupBy("pid").agg(F.max(key).alias(key))
        accepted = accepted.join(last, ["pid", key], "left_semi").drop(key)
        if store.assignments is not None:
            pairs = accepted.select("pid", F.lit(schema.name).alias("tbl"))
            grown.assignments = with_assignments(store.assignments, pairs, 1)
        if create_pages and store.pages is not None:
            grown.pages = with_pages(store.pages, accepted.select("pid"))
        changed = changed_only(store, schema, accepted.withColumn("rev", F.lit(ts).cast("bigint")))
        data, multi = save_revisions(store, schema_name, changed)
    else:
        if kind == "global":
            accepted = accepted.withColumn("pid", F.lit(""))
        accepted = accepted.withColumn("rid", F.lit(0).cast("bigint")).withColumnRenamed(key, "line")
        data, multi = save_rows(store, schema_name, accepted)
    grown.data_tables[schema.name], grown.multi_tables[schema.name] = data, multi
    return grown, bad


def schema_rows(store: Store, schema_name: str, kind: str) -> DataFrame:
    """Export form of a schema: raw values, lists joined with commas, ``pid`` unless global."""
    found = Search(store, SearchSpec((schema_name,), ("*",)))
    rows = found.raw_cells
    out = [] if kind == "global" else [F.col("pid")]
    for i, column in enumerate(found.columns):
        cell = F.col(f"c{i}_raw")
        out.append((F.array_join(cell, ",") if column.multi else cell).alias(column.label))
    return rows.select(*out)


def write_rows(rows: DataFrame, path: str) -> None:
    """Write as CSV files with header, quotes around every cell and CRLF line ends (also inside cells)."""
    writer = rows.write.option("header", True).option("quoteAll", True)
    writer = writer.option("quote", '"').option("escape", '"').option("lineSep", "\r\n")
    writer.option("emptyValue", "").option("nullValue", "").csv(path)


def export_schema(store: Store, schema_name: str, kind: str, path: str) -> None:
    write_rows(schema_rows(store, schema_name, kind), path)


def export_table(store: Store, spec: SearchSpec, path: str) -> None:
    """Write a whole search result as shown, regardless of its paging."""
    rows = text_rows(store, replace(spec, limit=0, offset=0)).drop("pid", "rid", "rev")
    write_rows(rows, path)
