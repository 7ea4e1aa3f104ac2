"""From a :class:`SearchSpec` to a DataFrame.

The plan has two parts. The *core* holds the selected records with their single-valued cells: joins,
filters, removal of empty rows, sorting and paging happen there. Multi-valued cells never fan the core
out: filters on them become per-record flags, and their lists are folded beside the core and joined
once, after paging if there is any.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import Cell, ColumnType, Lookup, Page, Side, Text, same_forms
from ..errors import StructureError
from ..functions.text import all_of, any_of, compare, is_blank, or_empty
from ..operators.numbering import Key, positions_between, sorts
from ..schema import SchemaColumn
from ..store import DATA_KEYS, DATA_META, Store
from .folding import (
    FORMS,
    distinct_values,
    folded,
    match_flags,
    single_forms,
    value_forms,
    value_rows,
)
from .names import Names
from .relation import Relation, prefixed
from .spec import Filter, PageValue, SearchSpec

ROW_KEYS = ["pid", "rid", "rev"]
# Pages that end within so many rows are cut off sorted tasks; deeper ones are located by counting.
SHALLOW = 100_000
# Comparisons that follow from an order of the values.
ORDERED = ("=", "!=", "<", "<=", ">", ">=")


def page_values(store: Store, wanted: PageValue) -> DataFrame:
    """The values a column has on a page, one ``operand`` each; a lone empty text when there are none."""
    schema = store.schema(wanted.schema)
    column = schema.find(wanted.label)
    if column is None:
        raise StructureError(f"column {wanted.label} not in {wanted.schema}")
    of_page = (F.col("pid") == wanted.page) & (F.col("rid") == 0) & (F.col("latest") == 1)
    if column.multi:
        rows = store.multi(schema.name).filter(of_page & (F.col("colref") == column.colref))
        relation = Relation(store, rows)
        cell = Cell(F.col("value"), "value", "")
    else:
        rows = store.data(schema.name).filter(of_page & (F.col("rev") > 0))
        relation = Relation(store, rows)
        cell = Cell(F.col(column.physical), column.physical, "")
    value = column.type.forms(relation, cell).compare
    values = relation.df.select(value.alias("value")).filter(~is_blank(F.col("value"))).distinct()
    none = values.limit(1).agg(F.count("value").alias("n")).filter("n = 0").select(F.lit("").alias("value"))
    affixed = F.concat(F.lit(wanted.before), F.col("value"), F.lit(wanted.after))
    return values.unionByName(none).select(affixed.alias("operand"))


class Search:
    """A search bound to a store. No method runs a job, except that an offset beyond :data:`SHALLOW` rows, or one without a
    limit, is located when the cells are built."""

    def __init__(self, store: Store, spec: SearchSpec):
        self.store = store
        self.spec = spec
        self.names = Names(store, spec)
        self.columns = self.names.selected(spec.columns)
        self.fixed_filters = self.names.filters(spec.filters)
        self.dynamic_filters = self.names.dynamic_filters(spec.dynamic_filters)
        self.sort_columns = self.names.sorts(spec.sorts)
        self._prefix = {schema.name: f"d{i}__" for i, schema in enumerate(self.names.schemas)}
        if spec.kind == "global" and len(self.names.schemas) > 1:
            raise StructureError("global rows have no page that a second schema could be joined on")
        # rows of several schemas or revisions can agree in everything that is selected
        self.grouped = len(self.names.schemas) > 1 or not self._current_only

    # ---- pieces ---------------------------------------------------------------------------------

    @property
    def multi_columns(self) -> list[tuple[int, SchemaColumn]]:
        return [(i, c) for i, c in enumerate(self.columns) if c.multi]

    @property
    def single_columns(self) -> list[tuple[int, SchemaColumn]]:
        return [(i, c) for i, c in enumerate(self.columns) if not c.multi]

    @cached_property
    def output_names(self) -> list[str]:
        labels = [c.label for c in self.columns]
        out: list[str] = []
        for column in self.columns:
            name = column.label if labels.count(column.label) == 1 else column.qualified
            while name in out:
                name += "_"
            out.append(name)
        return out

    @property
    def _current_only(self) -> bool:
        return self.spec.latest and self.spec.publisher is True

    def _cell(self, column: SchemaColumn) -> Cell:
        prefix = self._prefix[column.table]
        name = prefix + column.physical
        return Cell(F.col(name), name, prefix)

    def _visible(self, prefix: str) -> Column | None:
        """Publishers see latest rows (or all revisions), readers the published ones."""
        publisher, latest = self.spec.publisher, F.col(prefix + "latest") == 1
        published = F.col(prefix + "published") == 1
        if publisher is True:
            return latest if self.spec.latest else None
        if publisher is False:
            return published
        seen = latest if self.spec.latest else F.lit(True)
        return F.when(F.col("page__publisher") == 1, seen).otherwise(published)

    def _base(self) -> Relation:
        df = None
        first = self.names.schemas[0]
        for schema in self.names.schemas:
            prefix = self._prefix[schema.name]
            physical = DATA_META + [c.physical for c in schema.columns]
            rows = prefixed(self.store.data(schema.name), prefix, physical)
            if isinstance(self.spec.publisher, bool):
                visible = self._visible(prefix)
                if visible is not None:
                    rows = rows.filter(visible)
            if df is None:
                df = self._of_kind(rows, prefix)
                continue
            # what a reader may not see of a later schema removes the row, except that publishers
            # reading all revisions keep it
            keeps_all = not self.spec.latest and self.spec.publisher is not False
            # global rows belong to no page, so they never make pairs
            page = F.col(self._prefix[first.name] + "pid")
            same_page = (page == F.col(prefix + "pid")) & (page != "") & (F.col(prefix + "pid") != "")
            df = df.join(rows, same_page, "left" if keeps_all else "inner")
        relation = Relation(self.store, df)
        self._check_access(relation)
        if isinstance(self.spec.publisher, str):
            for schema in self.names.schemas:
                relation.df = relation.df.filter(self._visible(self._prefix[schema.name]))
        return relation

    def _of_kind(self, rows: DataFrame, prefix: str) -> DataFrame:
        pid, rid = F.col(prefix + "pid"), F.col(prefix + "rid")
        if self.spec.kind == "global":
            return rows.filter((rid != 0) & (pid == ""))
        if self.spec.kind == "serial":
            return rows.filter((rid != 0) & (pid == self.spec.page))
        if self.spec.kind is not None:
            raise StructureError(f"unknown kind of rows {self.spec.kind!r}")
        return rows

    def _check_access(self, relation: Relation) -> None:
        """Page rows need a readable, existing page; revisioned ones also an assignment that is not
        withdrawn. Global rows need nothing."""
        prefix = self._prefix[self.names.schemas[0].name]
        pid, rid = F.col(prefix + "pid"), F.col(prefix + "rid")
        pages, assignments = self.store.pages, self.store.assignments
        needs_flag = isinstance(self.spec.publisher, str)
        if self.spec.kind == "global" and not needs_flag:
            return
        conditions = []
        if pages is not None:
            wanted = ["pid", "exists", "access_level"]
            known = prefixed(pages, "page__", wanted)
            if needs_flag:
                flag = F.col(self.spec.publisher).cast("int").alias("page__publisher")
                known = pages.select(*[F.col(c).alias("page__" + c) for c in wanted], flag)
            relation.df = relation.df.join(known, pid == F.col("page__pid"), "left")
            conditions += [F.col("page__access_level") > 0, F.col("page__exists") == 1]
        elif needs_flag:
            raise StructureError("publishing rights per page need a pages table")
        if assignments is not None:
            own = assignments.filter(F.col("tbl") == self.names.schemas[0].name)
            own = prefixed(own, "assignment__", ["pid", "assigned"])
            on_page = (pid != "") & (pid == F.col("assignment__pid"))
            relation.df = relation.df.join(own, on_page, "left")
            state = F.col("assignment__assigned")
            conditions.append((rid != 0) | (state == 1) | state.isNull())
        if conditions:
            relation.df = relation.df.filter((pid == "") | all_of(conditions))

    # ---- filters --------------------------------------------------------------------------------

    def _predicate(self, relation: Relation, cell: Cell, column: SchemaColumn, item: Filter):
        if not isinstance(item.value, PageValue):
            return column.type.matches(relation, cell, item.comparator, item.value)
        operands = page_values(self.store, item.value)
        sides = column.type.known_sides(relation, cell) if item.comparator in ORDERED else None
        if sides:
            return any_of([self._compared(relation, side, item.comparator, operands) for side in sides])
        # patterns are tried one by one
        name = f"operands{len(relation.df.columns)}"
        relation.df = relation.df.withColumn(name, operands.agg(F.collect_set("operand")).scalar())
        # joins the type needs are made here; inside the lambda they are already known
        column.type.predicate(relation, cell, item.comparator, "")
        return F.exists(
            F.col(name), lambda v: column.type.predicate(relation, cell, item.comparator, v)
        )

    @staticmethod
    def _compared(relation: Relation, side: Side, comparator: str, operands: DataFrame) -> Column:
        """Does the comparison hold for any operand? Equality is one join, order needs only the ends."""
        form = side.of_operand(F.col("operand"))
        if comparator == "=":
            name = f"operand{len(relation.df.columns)}"
            key = operands.select(form.alias(name)).distinct()
            relation.df = relation.df.join(key, side.value == F.col(name), "left")
            return F.col(name).isNotNull()
        ends = operands.agg(F.struct(F.min(form).alias("low"), F.max(form).alias("high")).alias("ends")).scalar()
        if comparator == "!=":
            return (side.value != ends["low"]) | (side.value != ends["high"])
        return compare(side.value, comparator, ends["high" if comparator in ("<", "<=") else "low"])

    @staticmethod
    def _chain(predicates: list[tuple[str, Column]]) -> Column:
        """A flat chain: AND binds tighter than OR, the first link is ignored."""
        groups: list[list[Column]] = []
        for op, predicate in predicates:
            if groups and op == "AND":
                groups[-1].append(predicate)
            else:
                groups.append([predicate])
        return any_of([all_of(group) for group in groups])

    def _drop_empty_needed(self) -> bool:
        real = [c for c in self.columns if not c.pseudo]
        if not real:
            return False
        if any(item.op == "OR" for _, item in self.fixed_filters[1:]):
            return True
        # a selected column that has to equal a text is never empty
        for column, item in self.fixed_filters:
            literal = isinstance(item.value, str) and item.value.strip() != ""
            plain = not (column.type.config.get("prefix") or column.type.config.get("postfix"))
            kind = type(column.type)
            stored = kind.predicate in (ColumnType.predicate, Text.predicate)
            if item.comparator == "=" and literal and plain and stored:
                if any(c.qualified == column.qualified for c in real):
                    return False
        return True

    def _apply_filters(self, relation: Relation, check_empty: bool) -> None:
        """Apply both filter brackets and, if asked, the removal of empty rows."""
        brackets = [b for b in (self.fixed_filters, self.dynamic_filters) if b]
        tests: dict[str, list] = {}
        flags = 0
        plans = []
        for bracket in brackets:
            links = []
            for column, item in bracket:
                if column.multi:

                    def test(rel, cell, column=column, item=item):
                        return self._predicate(rel, cell, column, item)

                    if item.value == []:
                        continue
                    tests.setdefault(column.table, []).append((flags, column, test))
                    links.append((item.op, f"flag{flags}"))
                    flags += 1
                else:
                    predicate = self._predicate(relation, self._cell(column), column, item)
                    if predicate is not None:
                        links.append((item.op, predicate))
            if links:
                plans.append(links)
        filled = []
        if check_empty:
            for _, column in self.multi_columns:

                def has_text(rel, cell):
                    return ~is_blank(cell.value)

                tests.setdefault(column.table, []).append((flags, column, has_text))
                filled.append(self._flag(f"flag{flags}"))
                flags += 1
        for table, wanted in tests.items():
            rows = value_rows(
                self.store, table, sorted({c.colref for _, c, _ in wanted}), self._current_only
            )
            hits = match_flags(self.store, rows, wanted)
            prefix = self._prefix[table]
            hits = hits.select(
                *[F.col(k).alias(f"{prefix}flags_{k}") for k in DATA_KEYS],
                *[f"flag{number}" for number, _, _ in wanted],
            )
            same = all_of([F.col(prefix + k) == F.col(f"{prefix}flags_{k}") for k in DATA_KEYS])
            relation.df = relation.df.join(hits, same, "left")
        for links in plans:
            chain = [(op, self._flag(p) if isinstance(p, str) else p) for op, p in links]
            relation.df = relation.df.filter(self._chain(chain))
        if check_empty:
            for _, column in self.single_columns:
                if not column.pseudo:
                    raw = column.type.raw(relation, self._cell(column))
                    filled.append(~is_blank(raw))
            relation.df = relation.df.filter(any_of(filled))

    @staticmethod
    def _flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    # ---- core -----------------------------------------------------------------------------------

    def _identity(self, column: SchemaColumn) -> list[str]:
        return [self._prefix[column.table] + key for key in DATA_KEYS]

    @property
    def _folds_late(self) -> bool:
        """Lists are folded for the shown page only, so empty rows must be known before."""
        return bool(self.spec.limit or self.spec.offset)

    def _records(self, check_empty: bool, display: bool = True) -> DataFrame:
        """Filtered records: keys, raw cells, sort keys and the identity of each joined row.

        Display and compare forms are added here where they cost no join, or where all rows are
        returned; otherwise :meth:`_with_display` adds them to the shown page.
        """
        relation = self._base()
        self._apply_filters(relation, check_empty)
        first = self._prefix[self.names.schemas[0].name]
        out = [F.col(first + key).alias(key) for key in ROW_KEYS]
        if self.store.assignments is not None and "assignment__assigned" in relation.df.columns:
            out.append(F.col("assignment__assigned").alias("assigned"))
        else:
            out.append(F.lit(None).cast("int").alias("assigned"))
        for n, (column, _) in enumerate(self.sort_columns):
            keys = column.type.sort_keys(relation, self._cell(column))
            out += [key.alias(f"s{n}_{k}") for k, key in enumerate(keys)]
        for i, column in self.single_columns:
            cell = self._cell(column)
            raw = or_empty(column.type.raw(relation, cell)).cast("string")
            out.append(raw.alias(f"c{i}_raw"))
            if not display:
                continue
            trial = relation.copy()
            forms = column.type.forms(trial, cell)
            if forms.display is forms.raw:
                continue
            if trial.joins > relation.joins and self._folds_late:
                continue
            relation = trial
            out += self._display(i, forms)
        owners = {column.table: self._identity(column) for _, column in self.multi_columns}
        out += [F.col(name) for names in owners.values() for name in names]
        return relation.df.select(*out)

    @staticmethod
    def _display(i: int, forms) -> list[Column]:
        _, shown, compared = single_forms(forms)
        return [
            shown.cast("string").alias(f"c{i}_display"),
            compared.cast("string").alias(f"c{i}_compare"),
        ]

    def _with_display(self, rows: DataFrame) -> DataFrame:
        """Add the display and compare forms that are not there yet."""
        relation = Relation(self.store, rows)
        added = {}
        for i, column in self.single_columns:
            if f"c{i}_display" in rows.columns:
                continue
            raw = F.col(f"c{i}_raw")
            if column.pseudo and not isinstance(column.type, Page):
                forms = same_forms(raw)
            else:
                forms = column.type.forms(relation, Cell(raw, f"c{i}_raw", ""))
            if forms.display is forms.raw:
                added[f"c{i}_display"] = added[f"c{i}_compare"] = raw
            else:
                _, added[f"c{i}_display"], added[f"c{i}_compare"] = single_forms(forms)
        return relation.df.select(*rows.columns, *[c.alias(name) for name, c in added.items()])

    def _sort_names(self, df: DataFrame) -> list[Key]:
        order = []
        for n, (_, ascending) in enumerate(self.sort_columns):
            order += [Key(name, ascending) for name in df.columns if name.startswith(f"s{n}_")]
        return order

    def _order(self, df: DataFrame) -> list[Key]:
        ties = [Key("pid"), Key("rid")]
        if self.grouped:
            ties += [Key(f"c{i}_raw") for i, _ in self.single_columns]
        else:
            ties.append(Key("rev"))
        return self._sort_names(df) + ties

    def _group_keys(self) -> list[str]:
        raw = [f"c{i}_raw" for i, _ in self.single_columns]
        return ["pid", "rid", *raw] if self.grouped else list(ROW_KEYS)

    def _merged(self, records: DataFrame) -> DataFrame:
        """Rows that agree in page, row id and all single cells become one."""
        if not self.grouped:
            return records
        sorts = [c for c in records.columns if c.startswith("s") and c[1:2].isdigit()]
        # what a cell shows follows from its raw form
        shown = [c for c in records.columns if c.endswith(("_display", "_compare"))]
        return records.groupBy(*self._group_keys()).agg(
            F.max("rev").alias("rev"),
            F.max("assigned").alias("assigned"),
            *[F.max_by(name, "rev").alias(name) for name in sorts],
            *[F.max(name).alias(name) for name in shown],
        )

    def _paged(self, rows: DataFrame) -> DataFrame:
        if not self._folds_late:
            return rows
        order, offset, limit = self._order(rows), self.spec.offset, self.spec.limit
        if offset and (not limit or offset + limit > SHALLOW):
            return positions_between(rows, order, offset, limit)
        rows = rows.orderBy(*sorts(order))
        if offset:
            rows = rows.offset(offset)
        return rows.limit(limit) if limit else rows

    def _values(self, table: str, columns, shown: DataFrame | None, records: DataFrame):
        """Values of some multi-valued columns of one schema and the key that ties them to the rows."""
        colrefs = sorted({c.colref for _, c in columns})
        rows = value_rows(self.store, table, colrefs, self._current_only)
        keys = self._group_keys()
        if self.grouped:
            # lists of merged rows are merged as well
            identity = [self._prefix[table] + key for key in DATA_KEYS]
            owners = records.select(*keys, *identity).distinct()
            if shown is not None:
                owners = owners.join(shown.select(*keys), keys, "left_semi")
            rows = rows.withColumnsRenamed({key: f"v_{key}" for key in DATA_KEYS})
            same = all_of([F.col(i) == F.col(f"v_{k}") for i, k in zip(identity, DATA_KEYS)])
            rows = owners.join(rows, same).select(*keys, "colref", "row", "value")
        elif shown is not None:
            rows = rows.join(shown.select(*keys), keys, "left_semi")
        return keys, *value_forms(self.store, rows, columns)

    @staticmethod
    def _attach(rows: DataFrame, keys: list[str], side: DataFrame) -> DataFrame:
        renamed = {key: f"l_{key}" for key in keys}
        side = side.withColumnsRenamed(renamed)
        same = all_of([F.col(key) == F.col(name) for key, name in renamed.items()])
        return rows.join(side, same, "left").drop(*renamed.values())

    @cached_property
    def cells(self) -> DataFrame:
        """All rows of the result: keys, ``assigned``, ``c<i>_raw/_display/_compare``, sort keys."""
        return self._cells()

    @cached_property
    def raw_cells(self) -> DataFrame:
        """Like :attr:`cells`, with raw single cells only, so without joins for display."""
        return self._cells(display=False)

    def exploded(self, *positions: int) -> DataFrame:
        """Like :attr:`cells`, with one row per value of the given multi-valued columns.

        The lists of these columns are never built. A column without values gives one empty cell.
        """
        return self._cells(exploded=positions)

    def without_lists(self) -> DataFrame:
        """Like :attr:`cells`, with the single-valued columns only."""
        return self._cells(lists=False)

    def values(self) -> DataFrame:
        """Every value of the result: ``slot`` (position of its column), ``raw``, ``display``; repeated and blank ones too.

        The rows are found once: each of them asks for its values in all multi-valued columns by one join.
        """
        tables = list(dict.fromkeys(c.table for _, c in self.multi_columns))
        records = self._records(self._folds_late and self._drop_empty_needed())
        rows, owners = records, {table: [self._prefix[table] + key for key in DATA_KEYS] for table in tables}
        if self._folds_late:
            rows = self._paged(self._merged(records))
            if self.grouped and tables:
                # merged rows have lost the identity of the rows they come from
                keys = self._group_keys()
                identity = records.select(*keys, *[name for names in owners.values() for name in names])
                rows = self._attach(rows, keys, identity)
        rows = self._with_display(rows)

        def item(slot: Column, raw: str, display: str) -> Column:
            return F.struct(slot.alias("slot"), F.col(raw).alias("raw"), F.col(display).alias("display"))

        items = [item(F.lit(i), f"c{i}_raw", f"c{i}_display") for i, _ in self.single_columns]
        if tables:
            asked = [
                F.struct(F.lit(n).alias("t"), *[F.col(name).alias(f"k_{key}") for name, key in zip(owners[table], DATA_KEYS)])
                for n, table in enumerate(tables)
            ]
            cells = [f"c{i}_{form}" for i, _ in self.single_columns for form in ("raw", "display")]
            rows = rows.select(*cells, F.inline(F.array(*asked)))
            stored = []
            for n, table in enumerate(tables):
                columns = [(i, c) for i, c in self.multi_columns if c.table == table]
                found = value_rows(self.store, table, sorted({c.colref for _, c in columns}), self._current_only)
                listed, forms = value_forms(self.store, found, columns)
                shown = F.col("display" if "display" in forms else "raw").alias("v_display")
                listed = listed.select(F.lit(n).alias("v_t"), *[F.col(k).alias(f"v_{k}") for k in DATA_KEYS], "slot", F.col("raw").alias("v_raw"), shown)
                # equal values of a long record are merged before they travel to the join
                stored.append(listed.distinct())
            same = all_of([F.col("t") == F.col("v_t"), *[F.col(f"k_{k}") == F.col(f"v_{k}") for k in DATA_KEYS]])
            rows = rows.join(reduce(DataFrame.unionByName, stored), same, "left")
            items.append(item(F.col("slot"), "v_raw", "v_display"))
        return rows.select(F.inline(F.array(*items)))

    def _cells(
        self, exploded: tuple[int, ...] = (), lists: bool = True, display: bool = True
    ) -> DataFrame:
        drop_empty = self._drop_empty_needed()
        folding = [(i, c) for i, c in self.multi_columns if lists and i not in exploded]
        # folded lists tell by themselves which rows are empty, unless rows are counted off before
        before = drop_empty and (self._folds_late or bool(exploded) or not folding)
        records = self._records(before, display)
        rows = self._paged(self._merged(records))
        shown = rows if self._folds_late else None
        if display:
            rows = self._with_display(rows)
        for i in exploded:
            column = self.columns[i]
            keys, values, forms = self._values(column.table, [(i, column)], shown, records)
            values = distinct_values(values, keys, forms).select(
                *keys,
                F.col("row").alias(f"c{i}_row"),
                *[F.col(f if f in forms else "raw").alias(f"c{i}_{f}") for f in FORMS],
            )
            rows = self._attach(rows, keys, values).fillna("", [f"c{i}_{form}" for form in FORMS])
        for table in dict.fromkeys(c.table for _, c in folding):
            columns = [(i, c) for i, c in folding if c.table == table]
            keys, values, forms = self._values(table, columns, shown, records)
            rows = self._attach(rows, keys, folded(values, keys, columns, forms))
        none = F.array().cast("array<string>")
        names = [f"c{i}_{form}" for i, _ in folding for form in FORMS]
        if names:
            rows = rows.withColumns({name: F.coalesce(F.col(name), none) for name in names})
        if drop_empty and not before:
            rows = rows.filter(any_of(self._filled()))
        kept = ["pid", "rid", "rev", "assigned"]
        kept += [c for c in rows.columns if c[0] == "c" and c.endswith(tuple(f"_{f}" for f in FORMS))]
        kept += [c for c in rows.columns if c.startswith("s") and c[1:2].isdigit()]
        kept += [f"c{i}_row" for i in exploded]
        return rows.select(*kept)

    def _filled(self) -> list[Column]:
        tests = []
        for i, column in enumerate(self.columns):
            if column.pseudo:
                continue
            cell = F.col(f"c{i}_raw")
            tests.append(F.size(cell) > 0 if column.multi else cell != "")
        return tests

    # ---- building blocks for aggregations -------------------------------------------------------

    @property
    def current_only(self) -> bool:
        return self._current_only

    @property
    def sorted(self) -> bool:
        return bool(self.sort_columns) or self._folds_late

    def prefix_of(self, column: SchemaColumn) -> str:
        return self._prefix[column.table]

    def source_rows(self) -> DataFrame:
        """Filtered rows of the joined schemas, before empty rows are removed and without cells."""
        relation = self._base()
        self._apply_filters(relation, check_empty=False)
        return relation.df

    def sort_expressions(self, rows: DataFrame) -> list[Column]:
        return [F.col(c) for c in rows.columns if c.startswith("s") and c[1:2].isdigit()]

    def ordered_cells(self, *exploded: int) -> tuple[DataFrame, list[Key]]:
        """Cells and the columns that order them."""
        rows = self.exploded(*exploded) if exploded else self.cells
        return rows, self._order(rows)

    def shown_type(self, column: SchemaColumn):
        """Type that renders a display value: for references the type of the target."""
        visited = set()
        while isinstance(column.type, Lookup):
            target = self.store.reference_target(
                column.type.config["schema"], column.type.config["field"]
            )
            if target is None:
                break
            if (target.table, target.label) in visited:
                raise StructureError(f"references lead in a circle at {target.table}.{target.label}")
            visited.add((target.table, target.label))
            column = target
        return column.type

    # ---- results --------------------------------------------------------------------------------

    def shown(self, rows: DataFrame, forms: tuple[str, ...], extra: list[str] = ()) -> DataFrame:
        out = [F.col(key) for key in (*ROW_KEYS, *extra)]
        for position, form in enumerate(forms):
            for i, name in enumerate(self.output_names):
                alias = name if position == 0 else f"{name}__{form}"
                out.append(F.col(f"c{i}_{form}").alias(alias))
        return rows.select(*out)

    def result(self, *forms: str) -> DataFrame:
        """``pid``, ``rid``, ``rev`` and one column per selected column.

        ``forms`` picks ``display`` (default), ``raw`` or ``compare``; further forms are added as
        ``<label>__<form>``.
        """
        rows, order = self.ordered_cells()
        return self.shown(rows.orderBy(*sorts(order)) if self.sorted else rows, forms or ("display",))

    def count(self) -> DataFrame:
        """Number of rows regardless of paging, as a one-row DataFrame."""
        rows = self._merged(self._records(self._drop_empty_needed(), display=False))
        return rows.agg(F.count(F.lit(1)).alias("count"))


def search(store: Store, spec: SearchSpec, *forms: str) -> DataFrame:
    """Run-ready DataFrame of a search; chain further DataFrame operations on it."""
    return Search(store, spec).result(*forms)
