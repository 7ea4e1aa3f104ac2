"""Display forms of stored text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import number, trimmed

# Unit signs of the engineering notation, largest step last.
LARGE_UNITS = ["", "k", "M", "G", "T"]
SMALL_UNITS = ["", "m", "µ", "n", "p", "f", "a"]

# Fixed value: narrow no-break space, the default separator of digit groups.
NARROW_SPACE = " "


def plain_double(c: Column) -> Column:
    """A double as text without a trailing ``.0``."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def _localised(c: Column, point: str, thousands: str) -> Column:
    # '\1' marks a digit group and '\2' the decimal point, so either sign may become any text
    marked = F.translate(c, ",.", "\x01\x02")
    marked = F.replace(marked, F.lit("\x01"), F.lit(thousands))
    return F.replace(marked, F.lit("\x02"), F.lit(point))


def number_display(
    c: Column,
    roundto: int = -1,
    decpoint: str = ".",
    thousands: str = NARROW_SPACE,
    trimzeros: bool = True,
    prefix: str = "",
    postfix: str = "",
) -> Column:
    """A number with digit groups; ``roundto`` -1 keeps the fraction as it was written."""
    value = number(c)
    if roundto == -1:
        parts = F.split(c, r"\.")
        whole = F.format_number(F.abs(number(parts[0])), 0)
        out = _localised(whole, decpoint, thousands)
        fraction = F.get(parts, F.lit(1))
        out = F.when(fraction.isNotNull(), F.concat(out, F.lit(decpoint), fraction)).otherwise(out)
        out = F.when(value < 0, F.concat(F.lit("-"), out)).otherwise(out)
    else:
        rounded = F.round(value, roundto)
        # a negative number that rounds to zero shows no sign
        rounded = F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)
        out = _localised(F.format_number(rounded, roundto), decpoint, thousands)
    if trimzeros and decpoint:
        stripped = F.rtrim(F.rtrim(out, F.lit("0")), F.lit(decpoint))
        out = F.when(F.contains(out, F.lit(decpoint)), stripped).otherwise(out)
    return F.concat(F.lit(prefix), out, F.lit(postfix))


def engineering(c: Column, prefix: str = "", postfix: str = "") -> Column:
    """Powers of 1000 with a unit sign; zero and negative numbers stay plain."""
    value = number(c)
    step = F.floor(F.log10(value) / 3).cast("int")
    step = F.greatest(F.least(step, F.lit(len(LARGE_UNITS) - 1)), F.lit(1 - len(SMALL_UNITS)))
    unit = F.when(step < 0, F.element_at(F.array(*map(F.lit, SMALL_UNITS)), -step + 1)).otherwise(
        F.element_at(F.array(*map(F.lit, LARGE_UNITS)), step + 1)
    )
    scaled = value / F.pow(F.lit(1000.0), step)
    # 14 significant digits hide the binary noise of the division
    digits = F.when(scaled >= 100, F.round(scaled, 11)).when(scaled >= 10, F.round(scaled, 12))
    digits = digits.otherwise(F.round(scaled, 13))
    scaled = F.concat(plain_double(digits), F.lit(NARROW_SPACE), unit)
    shown = F.when(value > 0, scaled).otherwise(c)
    return F.concat(F.lit(prefix), shown, F.lit(postfix))


def date_display(c: Column, pattern: str = "yyyy/MM/dd") -> Column:
    """A stored date in a Spark date pattern; empty when it is no date."""
    return F.coalesce(F.date_format(F.try_to_timestamp(c), pattern), F.lit(""))


def url_of(c: Column, prefix: str = "", postfix: str = "", autoscheme: str = "https") -> Column:
    url = F.concat(F.lit(prefix), trimmed(c), F.lit(postfix))
    return F.when(url.rlike(r"\w+://"), url).otherwise(F.concat(F.lit(f"{autoscheme}://"), url))


def url_title(url: Column) -> Column:
    """Host without ``www.``, followed by ``/…`` when the address goes deeper."""
    host = F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^(?i)www\.", "")
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    deeper = (
        ~path.isin("", "/")
        | F.try_parse_url(url, F.lit("QUERY")).isNotNull()
        | F.try_parse_url(url, F.lit("REF")).isNotNull()
    )
    title = F.when(deeper, F.concat(host, F.lit("/…"))).otherwise(host)
    return F.coalesce(title, url)


def hue(c: Column) -> Column:
    """Colour angle of ``#rrggbb`` in degrees; 0 for greys and for anything else."""

    def channel(start: int) -> Column:
        return F.conv(F.substring(c, start, 2), 16, 10).cast("double")

    red, green, blue = channel(2), channel(4), channel(6)
    low, high = F.least(red, green, blue), F.greatest(red, green, blue)
    span = high - low
    angle = (
        F.when(blue == high, F.lit(4) + F.try_divide(red - green, span))
        .when(green == high, F.lit(2) + F.try_divide(blue - red, span))
        .otherwise(F.try_divide(green - blue, span))
    ) * 60
    positive = F.when(angle < 0, angle + 360).otherwise(angle)
    is_colour = F.coalesce(c.rlike(r"^(?i)#[0-9a-f]{6}$"), F.lit(False))
    return F.when(is_colour & (span != 0), positive).otherwise(F.lit(0.0))
