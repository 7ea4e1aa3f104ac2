import random
from decimal import Decimal

import pytest

from pagegrain.operators.numbering import Key, bucket_column, numbered, positions_between, with_previous

FIELDS = "pid string, rev bigint, total decimal(9,2), word string"


@pytest.fixture(scope="module")
def rows():
    """One page holds most rows; keys repeat and are often missing."""
    dice = random.Random(3)
    out = []
    for rev in range(400):
        pid = "hot" if rev % 4 else f"p{rev % 20}"
        total = dice.choice([None, Decimal("1.50"), Decimal(dice.randint(-9, 9))])
        out.append((pid, rev, total, dice.choice([None, "", "a", "B", "é"])))
    return out


def in_order(rows, down):
    """By total (descending or ascending, missing ones smallest), word and revision."""
    ranked = sorted(rows, key=lambda r: (r[3] is not None, r[3] or "", r[1]))
    if down:
        return sorted(ranked, key=lambda r: (r[2] is None, -(r[2] or 0)))
    return sorted(ranked, key=lambda r: (r[2] is not None, r[2] or 0))


@pytest.mark.parametrize("down", [False, True])
def test_positions(spark, rows, down):
    df = spark.createDataFrame(rows, FIELDS).repartition(5)
    order = [Key("total", not down), Key("word"), Key("rev")]
    wanted = {r[1]: n for n, r in enumerate(in_order(rows, down), 1)}
    assert {r["rev"]: r["position"] for r in numbered(df, order).collect()} == wanted
    for offset, limit in ((0, 0), (1, 7), (123, 0), (390, 100), (400, 0), (57, 300)):
        found = {r["rev"] for r in positions_between(df, order, offset, limit).collect()}
        assert found == {rev for rev, n in wanted.items() if n > offset and (not limit or n <= offset + limit)}


def test_no_rows(spark):
    df = spark.createDataFrame([], FIELDS)
    assert numbered(df, [Key("rev")]).collect() == [] == positions_between(df, [Key("rev")], 3).collect()


def test_the_bucket_does_not_grow_with_the_split_points(spark, rows):
    df = spark.createDataFrame(rows, FIELDS)
    order, points = [Key("total"), Key("rev")], [(Decimal(n), n) for n in range(300)]
    sizes = []
    for count in (3, 300):
        column = bucket_column(df, order, points[:count])
        plan = df.select(column.alias("b"))._jdf.queryExecution().analyzed().toString()
        sizes.append(plan.count("get(array("))
    assert sizes[0] == sizes[1]


def test_previous_row_of_a_very_long_page(spark, rows):
    df = spark.createDataFrame(rows, FIELDS).repartition(5)
    last, wanted = {}, {}
    for r in sorted(rows):
        wanted[r[1]] = last.get(r[0])
        last[r[0]] = r[1]
    found = {r["rev"]: r["before"] and r["before"]["rev"] for r in with_previous(df, ["pid"], "rev", "before").collect()}
    assert found == wanted


@pytest.mark.parametrize("up", [(True, True, True), (False, False, False), (True, False, True), (False, True, True)])
def test_a_step_of_the_search_is_one_comparison_for_each_direction(spark, rows, up):
    df = spark.createDataFrame(rows, FIELDS)
    order = [Key(name, one) for name, one in zip(("total", "word", "rev"), up, strict=True)]
    ranked = [tuple(r) for r in df.orderBy(*[k.sort() for k in order]).select("total", "word", "rev").collect()]
    column = bucket_column(df, order, ranked[40::40])
    changes = sum(x != y for x, y in zip(up[1:], up[:-1], strict=True))
    assert df.select(column.alias("b"))._jdf.queryExecution().analyzed().toString().count("get(array(") <= 2 * changes + 1
    found = {r.rev: r.b for r in df.select("rev", column.alias("b")).collect()}
    assert found == {r[2]: n // 40 for n, r in enumerate(ranked)}
