"""Regular expressions as data: what a text has to hold so that an expression can be found in it."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, nocase

# An expression between slashes, then flags.
READABLE = re.compile(r"(?s)^/(.*)/([imsx]*)$")

# The longest grams texts are indexed by. Texts with a number in them are told apart only by grams that hold all of it: with
# shorter ones the pages of a gram grow with all pages, and pages times expressions are searched.
GRAM = 12
# Groups within groups are followed so deep.
DEPTH = 4
BREAK = "\n"

# Notations whose literal parts are not told apart here: quoted spans, comments and spacing, inline flags for the rest of
# the expression, escapes with arguments, classes in classes.
UNKNOWN = r"\\[^dDwWsSbBAzZ\W]|\\_|\(\?[a-zA-Z]*-?[a-zA-Z]*\)|\[[^\]]*\[|\[\^?\]|[\n\r]"
# Flags at the beginning, which hold for the whole expression and change no literal but its case.
FLAGS = r"^\(\?[ims]{1,3}\)"


def java_regex(pattern: Column) -> Column:
    """A delimited expression in Java's notation, NULL for other patterns; one that does not end, or has other flags, is an error."""
    body, flags = (F.regexp_extract(pattern, READABLE.pattern, n) for n in (1, 2))
    bad = F.raise_error(F.concat(F.lit("not an expression between slashes with flags of imsx: "), pattern))
    regex = F.when(flags == "", body).otherwise(F.concat(F.lit("(?"), flags, F.lit(")"), body))
    return F.when(pattern.rlike(READABLE.pattern), regex).when(F.startswith(pattern, F.lit("/")), bad.cast("string"))


def required_texts(regex: Column) -> Column:
    """Texts that occur in every lower-case text the expression is found in; none where that is not certain.

    Only plain signs outside groups, classes and repetitions count; an expression with alternatives outside
    groups requires nothing.
    """
    folds = F.contains(F.regexp_extract(regex, FLAGS, 0), F.lit("i"))
    none = F.array().cast("array<string>")

    def of_plain(rest: Column) -> Column:
        signs = F.regexp_replace(rest, r"(?s).(?:[*+?]|\{[^}]*\})[+?]?", BREAK)
        texts = F.split(F.when(folds, nocase(signs)).otherwise(signs), r"[^A-Za-z0-9:_-]+")
        return F.when(rest.rlike(r"[()|\[\]]"), none).otherwise(F.array_distinct(F.filter(texts, lambda t: t != "")))

    def of_body(body: Column) -> Column:
        rest = F.regexp_replace(body, r"\\.", BREAK)
        rest = F.regexp_replace(rest, r"\[[^\]]+\]", BREAK)
        for _ in range(DEPTH):
            rest = F.regexp_replace(rest, r"\([^()]*\)", BREAK)
        return F.when(body.rlike(UNKNOWN), none).otherwise(bound(rest, of_plain))

    return bound(F.regexp_replace(regex, FLAGS, ""), of_body)


def _of_length(text: Column, length: int | Column) -> Column:
    starts = F.sequence(F.lit(1), F.length(text) - (length - 1))
    return F.transform(starts, lambda n: F.substring(text, n, length if isinstance(length, Column) else F.lit(length)))


def grams(text: Column) -> Column:
    """The distinct grams of a text, of all lengths; none for NULL."""
    none = F.array().cast("array<string>")

    def listed(t: Column) -> Column:
        return F.array_distinct(F.concat(*[F.when(F.length(t) >= n, _of_length(t, n)).otherwise(none) for n in range(1, GRAM + 1)]))

    return bound(text, listed)


def widest_grams(text: Column) -> Column:
    """The grams of the greatest length a text has. Any shorter one lies in one of them, so it is on no fewer texts."""
    return bound(text, lambda t: F.array_distinct(_of_length(t, F.least(F.length(t), F.lit(GRAM)))))
