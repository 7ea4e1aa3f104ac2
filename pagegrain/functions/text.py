"""Text comparison rules.

Every stored value is text. Comparisons keep text semantics unless a column type says otherwise,
so nothing here casts eagerly, and every conversion of user text is a ``try_`` conversion.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters stripped around a value.
WHITESPACE = " \t\n\r\0\x0b"

# Fixed value: longest numeric prefix of a text.
NUMERIC_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"

# Fixed value: a text that is a number as a whole.
NUMERIC = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"

UPPER_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def right_trimmed(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    """True for NULL, empty and whitespace-only text; looks no further than the first other sign."""
    return F.coalesce(~c.rlike(r"[^ \t\n\r\x00\x0b]"), F.lit(True))


def or_empty(c: Column) -> Column:
    """A single cell never shows NULL or mere whitespace."""
    return F.when(is_blank(c), F.lit("")).otherwise(c)


def nocase(c: Column) -> Column:
    """Sort key that folds ASCII letters only."""
    return F.translate(c, UPPER_ASCII, UPPER_ASCII.lower())


def number(c: Column) -> Column:
    """Numeric value of the longest numeric prefix, 0 without one, NULL for NULL."""
    # texts of digits, point and sign need no expression search
    plain = F.when(F.translate(c, "0123456789.+-", "") == "", c.try_cast("double"))
    prefix = F.regexp_extract(c, NUMERIC_PREFIX, 1).try_cast("double")
    return F.coalesce(plain, prefix, F.when(c.isNotNull(), F.lit(0.0)))


# Whole numbers from here on can lie between two doubles.
EXACT_DOUBLES = 2**53

# A prefix that is whole, without point or exponent.
WHOLE_PREFIX = r"^\s*([+-]?\d+)(?![\d.eE])"


def beyond_double(c: Column) -> Column:
    """What the double of a number loses: its whole value where doubles are not exact, else 0.

    Two numbers are equal if their doubles and this agree, and ordered by the pair.
    """
    value = number(c)
    whole = F.regexp_extract(c, WHOLE_PREFIX, 1).try_cast("bigint").cast("decimal(38,0)")
    exact = F.coalesce(whole, value.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    large = F.abs(value) >= F.lit(float(EXACT_DOUBLES))
    return F.when(large, exact).when(value.isNotNull(), F.lit(0).cast("decimal(38,0)"))


def exact_number(c: Column) -> Column:
    """A key by which texts are equal and ordered as numbers, without loss for whole numbers."""
    return F.struct(number(c).alias("near"), beyond_double(c).alias("rest"))


def compare_numbers(left: Column, comparator: str, value) -> Column:
    """One comparison of two texts as numbers, without loss for whole numbers."""
    right = operand(value)
    if not isinstance(value, Column):
        try:
            small = abs(float(value)) < EXACT_DOUBLES
        except ValueError:
            small = False
        if small:  # no other number has the same double
            return compare(number(left), comparator, number(right))
    known = left.isNotNull() & right.isNotNull()
    return F.when(known, compare(exact_number(left), comparator, exact_number(right)))


def is_number(c: Column) -> Column:
    return c.rlike(NUMERIC)


def squashed(c: Column) -> Column:
    """Tag comparison key: lower case without spaces."""
    return F.lower(F.replace(c, F.lit(" "), F.lit("")))


def operand(value) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value))


def like_pattern(value) -> Column:
    """``*`` matches anything; a backslash is an ordinary character."""
    if not isinstance(value, Column):
        return F.lit(str(value).replace("\\", "\\\\").replace("*", "%"))
    doubled = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("*"), F.lit("%"))


def compare(left: Column, comparator: str, value) -> Column:
    """One comparison, NULL when the left side is NULL."""
    right = operand(value)
    if comparator == "=":
        return left == right
    if comparator == "!=":
        return left != right
    if comparator == "<":
        return left < right
    if comparator == "<=":
        return left <= right
    if comparator == ">":
        return left > right
    if comparator == ">=":
        return left >= right
    if comparator == "~":
        return F.call_function("ilike", left, like_pattern(value))
    if comparator == "!~":
        return ~F.call_function("ilike", left, like_pattern(value))
    if comparator == "=*":
        return F.regexp_like(left, right)
    raise ValueError(f"unknown comparator {comparator!r}")


def any_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates)


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it occurs there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_list(c: Column) -> Column:
    """Comma-separated input to a list of trimmed items."""
    return F.transform(F.split(c, ","), trimmed)
