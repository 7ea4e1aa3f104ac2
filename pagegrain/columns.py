"""Column types.

A type describes, with Spark expressions only, how a stored text is shown, filtered, sorted and
validated. Types that look elsewhere (page titles, references) ask the relation under construction
for the join; the relation remembers it, so one query never joins the same thing twice.

New types derive from :class:`ColumnType` and are made known with :func:`register_type`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import StructureError
from .functions import display as show
from .functions.ids import clean_id
from .functions.text import (
    any_of,
    beyond_double,
    compare,
    compare_numbers,
    exact_number,
    is_blank,
    is_number,
    nocase,
    number,
    operand,
    right_trimmed,
    split_list,
    squashed,
    trimmed,
)

if TYPE_CHECKING:
    from .plans.relation import Relation

# Address schemes accepted by default.
URL_SCHEMES = ["http", "https", "telnet", "gopher", "wais", "ftp", "ed2k", "irc", "ldap"]

# Media type by file extension.
MEDIA_TYPES = {
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "png": "image/png",
    "webp": "image/webp",
    "svg": "image/svg+xml",
    "ico": "image/vnd.microsoft.icon",
    "mp3": "audio/mpeg",
    "ogg": "audio/ogg",
    "wav": "audio/wav",
    "webm": "video/webm",
    "ogv": "video/ogg",
    "mp4": "video/mp4",
    "pdf": "application/pdf",
    "zip": "application/zip",
    "gz": "application/octet-stream",
    "txt": "text/plain",
    "xml": "text/xml",
    "csv": "text/csv",
}

MAIL_ADDRESS = r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$"


@dataclass(frozen=True)
class Cell:
    """A stored value inside a relation."""

    value: Column
    key: str  # names the value, so that joins on it can be shared
    owner: str  # column prefix of the row the value belongs to
    visited: frozenset = frozenset()  # columns that references have led to so far


@dataclass(frozen=True)
class Forms:
    """The three forms of a value: as stored, as shown, as compared."""

    raw: Column
    display: Column
    compare: Column


@dataclass(frozen=True)
class Side:
    """The compared form of a cell and how an operand gets the same form."""

    value: Column
    of_operand: Callable[[Column], Column] = operand


def same_forms(value: Column) -> Forms:
    return Forms(value, value, value)


class ColumnType:
    """Plain text behaviour; subclasses change what differs."""

    defaults: dict = {}
    default_comparator = "*~"

    def __init__(self, config: dict | None = None):
        self.config = {**self.defaults, **(config or {})}

    @property
    def name(self) -> str:
        return type(self).__name__

    @property
    def plain(self) -> bool:
        """True if all three forms of a value are the same text."""
        return type(self).forms is ColumnType.forms

    def raw(self, relation: Relation, cell: Cell) -> Column:
        """The raw form alone, which most types give without a join."""
        return cell.value

    def forms(self, relation: Relation, cell: Cell) -> Forms:
        return same_forms(cell.value)

    def predicate(self, relation: Relation, cell: Cell, comparator: str, value) -> Column:
        """One comparison with one operand (a text or a text column)."""
        return compare(cell.value, comparator, value)

    def sides(self, relation: Relation, cell: Cell) -> list[Side]:
        """What ``=``, ``!=``, ``<`` … of :meth:`predicate` compare; any of the sides may hold."""
        return [Side(cell.value)]

    def known_sides(self, relation: Relation, cell: Cell) -> list[Side] | None:
        """:meth:`sides`, but None for a type that changes its comparisons without saying what they compare."""
        changed = next(kind for kind in type(self).__mro__ if "predicate" in vars(kind))
        return self.sides(relation, cell) if "sides" in vars(changed) else None

    def matches(self, relation: Relation, cell: Cell, comparator: str, value) -> Column | None:
        """A comparison with one operand or any of several."""
        if not isinstance(value, (list, tuple)):
            return self.predicate(relation, cell, comparator, value)
        if not value:
            return None
        return any_of([self.predicate(relation, cell, comparator, item) for item in value])

    def sort_keys(self, relation: Relation, cell: Cell) -> list[Column]:
        return [nocase(cell.value)]

    def cloud_key(self, display: Column) -> Column:
        return display

    def split(self, c: Column) -> Column:
        return split_list(c)

    def parsed(self, c: Column) -> Column:
        """What checking needs of an incoming value; computed once per value."""
        return trimmed(c)

    def checked(self, parsed: Column) -> tuple[Column, Column]:
        """Cleaned value and error text (NULL when there is none)."""
        return parsed, F.lit(None).cast("string")

    def shown(self, c: Column) -> Column:
        """Rendered text of a display value."""
        return c


class _Affixed(ColumnType):
    defaults = {"prefix": "", "postfix": ""}

    def affixed(self, c: Column) -> Column:
        parts = []
        if self.config["prefix"]:
            parts.append(F.lit(self.config["prefix"]))
        parts.append(c)
        if self.config["postfix"]:
            parts.append(F.lit(self.config["postfix"]))
        return F.concat(*parts) if len(parts) > 1 else c

    def predicate(self, relation, cell, comparator, value):
        return compare(self.affixed(cell.value), comparator, value)

    def sides(self, relation, cell):
        return [Side(self.affixed(cell.value))]

    def shown(self, c):
        return self.affixed(c)


class Text(_Affixed):
    pass


class LongText(_Affixed):
    def parsed(self, c):
        return F.regexp_replace(right_trimmed(c), r"\r\n?", "\n")


class Wiki(LongText):
    pass


class Url(_Affixed):
    defaults = {
        "autoscheme": "https",
        "prefix": "",
        "postfix": "",
        "fixedtitle": "",
        "autoshorten": True,
        "schemes": URL_SCHEMES,
    }

    def address(self, c: Column) -> Column:
        return show.url_of(c, self.config["prefix"], self.config["postfix"], self.config["autoscheme"])

    def parsed(self, c):
        return F.struct(trimmed(c).alias("text"), self.address(c).alias("url"))

    def checked(self, parsed):
        url = parsed["url"]
        valid = url.rlike(r"^(?i)(" + "|".join(self.config["schemes"]) + r")://.+")
        return parsed["text"], F.when(~valid, F.concat(F.lit("not a valid address: "), url))

    def shown(self, c):
        if self.config["fixedtitle"]:
            return F.lit(self.config["fixedtitle"])
        url = self.address(c)
        return show.url_title(url) if self.config["autoshorten"] else url


class Mail(_Affixed):
    def checked(self, parsed):
        mail = self.affixed(parsed)
        bad = ~mail.rlike(MAIL_ADDRESS)
        return parsed, F.when(bad, F.concat(F.lit("not a valid mail address: "), mail))


class Decimal(ColumnType):
    defaults = {
        "min": "",
        "max": "",
        "roundto": "-1",
        "decpoint": ".",
        "thousands": show.NARROW_SPACE,
        "trimzeros": True,
        "prefix": "",
        "postfix": "",
        "engineering": False,
    }
    default_comparator = "="

    def predicate(self, relation, cell, comparator, value):
        stored = cell.value.cast("string")  # row ids and flags are stored as numbers
        if comparator in ("~", "!~", "=*"):
            # patterns are compared by number as well, which leaves little of the pattern
            left, right = show.plain_double(number(stored)), show.plain_double(number(operand(value)))
            return (stored != "") & compare(left, comparator, right)
        return (stored != "") & compare_numbers(stored, comparator, value)

    def sides(self, relation, cell):
        stored = cell.value.cast("string")
        return [Side(F.when(stored != "", exact_number(stored)), exact_number)]

    def sort_keys(self, relation, cell):
        stored = cell.value.cast("string")
        return [number(stored), beyond_double(stored)]

    def parsed(self, c):
        return F.replace(trimmed(c), F.lit(","), F.lit("."))

    def checked(self, parsed):
        value = number(parsed)
        error = F.when(~is_number(parsed), F.lit("a decimal number is needed"))
        if self.config["min"] != "":
            low = float(self.config["min"])
            error = error.when(value < low, F.lit(f"must not be below {low:g}"))
        if self.config["max"] != "":
            high = float(self.config["max"])
            error = error.when(value > high, F.lit(f"must not be above {high:g}"))
        return parsed, error

    def shown(self, c):
        affixes = {"prefix": self.config["prefix"], "postfix": self.config["postfix"]}
        if self.config["engineering"]:
            return show.engineering(c, **affixes)
        roundto = self.config["roundto"]
        return show.number_display(
            c,
            roundto=int(roundto) if str(roundto) != "" else 0,
            decpoint=self.config["decpoint"],
            thousands=self.config["thousands"],
            trimzeros=self.config["trimzeros"],
            **affixes,
        )


# A day is year, month and day between hyphens; what follows a number is ignored.
DAY = r"(?s)^\s*\+?(\d+)[^-]*-\s*\+?(\d+)[^-]*-\s*\+?(\d+).*$"


class Date(ColumnType):
    defaults = {"format": "yyyy/MM/dd", "pastonly": False, "futureonly": False, "now": None}

    def _day(self, c: Column) -> Column:
        """The day a text names, NULL when there is no such day."""
        return F.try_to_date(F.regexp_replace(c, DAY, "$1-$2-$3"), "y-M-d")

    @staticmethod
    def _exists(day: Column) -> Column:
        return F.coalesce(F.year(day).between(1, 32767), F.lit(False))

    def _limits(self, error: Column, stamp: Column) -> Column:
        now = F.lit(self.config["now"]).cast("timestamp") if self.config["now"] else F.now()
        if self.config["pastonly"]:
            error = error.when(stamp > now, F.lit("must be in the past"))
        if self.config["futureonly"]:
            error = error.when(stamp < now, F.lit("must be in the future"))
        return error

    def parsed(self, c):
        return self._day(F.substring_index(trimmed(c), " ", 1))

    def checked(self, parsed):
        error = F.when(~self._exists(parsed), F.lit("not a valid date"))
        return F.date_format(parsed, "y-MM-dd"), self._limits(error, parsed.cast("timestamp"))

    def shown(self, c):
        return show.date_display(c, self.config["format"])


class DateTime(Date):
    defaults = {**Date.defaults, "format": "yyyy/MM/dd HH:mm"}

    def sort_keys(self, relation, cell):
        return [cell.value]

    def parsed(self, c):
        text = trimmed(c)
        hour = F.regexp_extract(text, r"(?s)^[^ |T]*[ |T]\s*([+-]?\d+)", 1)
        minute = F.regexp_extract(text, r"(?s)^[^ |T]*[ |T][^:]*:\s*([+-]?\d+)", 1)
        return F.struct(
            self._day(F.regexp_extract(text, r"^([^ |T]*)", 1)).alias("day"),
            F.coalesce(hour.try_cast("bigint"), F.lit(0)).alias("hour"),
            F.coalesce(minute.try_cast("bigint"), F.lit(0)).alias("minute"),
        )

    def checked(self, parsed):
        day, hour, minute = parsed["day"], parsed["hour"], parsed["minute"]
        real = self._exists(day) & hour.between(0, 23) & minute.between(0, 59)
        error = F.when(~real, F.lit("not a valid date and time"))
        clock = F.format_string("%s %02d:%02d", F.date_format(day, "y-MM-dd"), hour, minute)
        seconds = F.unix_timestamp(day.cast("timestamp")) + hour * 3600 + minute * 60
        return clock, self._limits(error, F.timestamp_seconds(seconds))


class Page(ColumnType):
    defaults = {"usetitles": False, "filter": ""}

    @property
    def plain(self):
        return not self.config["usetitles"]

    def forms(self, relation, cell):
        if not self.config["usetitles"]:
            return same_forms(cell.value)
        title = relation.title(cell, "title")
        shown = F.when(is_blank(title), cell.value).otherwise(title)
        return Forms(cell.value, shown, cell.value)

    def predicate(self, relation, cell, comparator, value):
        by_id = compare(cell.value, comparator, value)
        if not self.config["usetitles"]:
            return by_id
        return by_id | compare(relation.title(cell, "title"), comparator, value)

    def sides(self, relation, cell):
        titled = [Side(relation.title(cell, "title"))] if self.config["usetitles"] else []
        return [Side(cell.value), *titled]

    def sort_keys(self, relation, cell):
        if not self.config["usetitles"]:
            return super().sort_keys(relation, cell)
        return [nocase(relation.title(cell, "title")), cell.value]

    def parsed(self, c):
        page = clean_id(F.substring_index(c, "#", 1))
        fragment = clean_id(F.regexp_extract(c, r"(?s)#(.*)$", 1))
        clean = F.rtrim(F.concat(page, F.lit("#"), fragment), F.lit("#"))
        return F.when(F.contains(c, F.lit("#")), clean).otherwise(page)


class User(ColumnType):
    defaults = {"existingonly": True}


class Tag(ColumnType):
    def predicate(self, relation, cell, comparator, value):
        return compare(squashed(cell.value), comparator, squashed(operand(value)))

    def sides(self, relation, cell):
        return [Side(squashed(cell.value), squashed)]


class Dropdown(ColumnType):
    pass


class Checkbox(ColumnType):
    pass


class Color(ColumnType):
    defaults = {"default": "#ffffff"}

    def parsed(self, c):
        return trimmed(F.lower(c))

    def checked(self, parsed):
        error = F.when(~parsed.rlike(r"^#[a-f0-9]{6}$"), F.lit("not a valid colour"))
        plain = parsed == self.config["default"].lower()
        return F.when(plain, F.lit("")).otherwise(parsed), error

    def cloud_key(self, display):
        return show.hue(display)


class Media(ColumnType):
    defaults = {"mime": "image/"}

    def checked(self, parsed):
        allowed = [item.strip() for item in self.config["mime"].split(",") if item.strip()]
        if not allowed:
            return parsed, F.lit(None).cast("string")
        extension = F.lower(F.regexp_extract(parsed, r"\.([A-Za-z0-9]+)$", 1))
        known = F.create_map(*[F.lit(part) for item in MEDIA_TYPES.items() for part in item])
        mime = F.coalesce(F.try_element_at(known, extension), F.lit(""))
        fits = any_of([F.startswith(mime, F.lit(item)) for item in allowed])
        return parsed, F.when(~fits, F.concat(F.lit("media type not allowed: "), mime))


class Lookup(ColumnType):
    """A reference to one column of a row of another schema."""

    defaults = {"schema": "", "field": ""}

    def _target(self, relation: Relation, cell: Cell):
        column = relation.store.reference_target(self.config["schema"], self.config["field"])
        if column is None:
            return None, None
        if (column.table, column.label) in cell.visited:
            raise StructureError(f"references lead in a circle at {column.table}.{column.label}")
        return column, relation.referenced(cell, column)

    def forms(self, relation, cell):
        column, target = self._target(relation, cell)
        if column is None:
            return same_forms(cell.value)
        inner = column.type.forms(relation, target)
        return Forms(cell.value, inner.display, inner.raw)

    def predicate(self, relation, cell, comparator, value):
        column, target = self._target(relation, cell)
        if column is None:
            return super().predicate(relation, cell, comparator, value)
        return column.type.predicate(relation, target, comparator, value)

    def sides(self, relation, cell):
        column, target = self._target(relation, cell)
        return super().sides(relation, cell) if column is None else column.type.known_sides(relation, target)

    def sort_keys(self, relation, cell):
        column, target = self._target(relation, cell)
        if column is None:
            return super().sort_keys(relation, cell)
        return column.type.sort_keys(relation, target)


class LastUpdate(DateTime):
    """Time of the page's last change, kept with the page metadata."""

    def _text(self, relation, cell):
        stamp = F.timestamp_seconds(relation.title(cell, "lastrev"))
        return F.date_format(stamp, "yyyy-MM-dd HH:mm:ss")

    def raw(self, relation, cell):
        return self._text(relation, cell)

    def forms(self, relation, cell):
        return same_forms(self._text(relation, cell))

    def predicate(self, relation, cell, comparator, value):
        return compare(self._text(relation, cell), comparator, value)

    def sides(self, relation, cell):
        return [Side(self._text(relation, cell))]

    def sort_keys(self, relation, cell):
        return [relation.title(cell, "lastrev")]


class _PageMetadata(ColumnType):
    field = ""

    def raw(self, relation, cell):
        return relation.title(cell, self.field)

    def forms(self, relation, cell):
        return same_forms(relation.title(cell, self.field))

    def predicate(self, relation, cell, comparator, value):
        return compare(relation.title(cell, self.field), comparator, value)

    def sides(self, relation, cell):
        return [Side(relation.title(cell, self.field))]

    def sort_keys(self, relation, cell):
        return [relation.title(cell, self.field)]


class LastEditor(_PageMetadata):
    field = "lasteditor"


class AutoSummary(_PageMetadata):
    field = "lastsummary"


_TYPES: dict[str, type[ColumnType]] = {
    cls.__name__: cls
    for cls in (
        Text,
        LongText,
        Wiki,
        Url,
        Mail,
        Decimal,
        Date,
        DateTime,
        Page,
        User,
        Tag,
        Lookup,
        Dropdown,
        Checkbox,
        Color,
        Media,
        AutoSummary,
    )
}


def register_type(name: str, cls: type[ColumnType]) -> None:
    """Make a column type available to schemas under a name."""
    if not issubclass(cls, ColumnType):
        raise StructureError(f"{cls!r} is not a column type")
    _TYPES[name] = cls


def type_named(name: str, config: dict | None = None) -> ColumnType:
    """The type of a stored class name; unknown names read as Text, Integer as Decimal."""
    if name == "Integer":
        name = "Decimal"
    return _TYPES.get(name, Text)(config)
