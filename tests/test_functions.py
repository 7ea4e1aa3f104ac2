import decimal
from datetime import date

import pytest
from pyspark.sql import functions as F

from pagegrain.columns import Color, Date, DateTime, Decimal, LongText, Mail, Media, Page, Text, Url
from pagegrain.errors import StructureError
from pagegrain.functions import display, ids, refs, text
from pagegrain.plans.params import relative_date

NNBSP = " "


def test_numeric_prefix(evaluate):
    cases = {
        "12abc": 12.0, "": 0.0, "abc": 0.0, " 3.5 ": 3.5, "-.5x": -0.5, "1e3": 1000.0, "5.": 5.0,
        "+7": 7.0, "1,5": 1.0,
    }
    assert evaluate(text.number, *cases) == list(cases.values())
    assert evaluate(text.number, None) == [None]


def test_nocase_folds_ascii_only(evaluate):
    assert evaluate(text.nocase, "AbÄ", "Z") == ["abÄ", "z"]


def test_like_takes_backslashes_and_sql_wildcards_as_given(evaluate):
    def run(pattern):
        return lambda c: text.compare(c, "~", pattern)

    assert evaluate(run("a*c"), "abc", "ABXC", "ab") == [True, True, False]
    assert evaluate(run("%ag%"), "page", "leaf") == [True, False]
    assert evaluate(run("a\\*"), "a\\b", "ab") == [True, False]
    assert evaluate(lambda c: text.compare(c, "~", F.lit("a\\*")), "a\\b", "ab") == [True, False]


def test_blank(evaluate):
    assert evaluate(text.is_blank, None, "", " \t\n", "0", "x") == [True, True, True, False, False]


def grouped(value, places, trim):
    """Comma as decimal point, blanks between thousands; ``places`` below zero keeps the digits."""
    number = decimal.Decimal(value)
    if places >= 0:
        number = number.quantize(decimal.Decimal(1).scaleb(-places), decimal.ROUND_HALF_UP)
    whole, _, rest = f"{number:,f}".partition(".")
    rest = rest.rstrip("0") if trim else rest
    return whole.replace(",", " ") + ("," + rest if rest else "")


@pytest.mark.parametrize("places", [-1, 0, 1, 3])
@pytest.mark.parametrize("trim", [True, False])
def test_number_display(evaluate, places, trim):
    values = ["0", "8", "31.62", "-31.62", "999.96", "1000", "12345.678", "-98765432.1", "0.2070", "66.000"]
    shown = evaluate(
        lambda c: display.number_display(c, decpoint=",", thousands=" ", roundto=places, trimzeros=trim), *values
    )
    assert shown == [grouped(v, places, trim) for v in values]


def test_number_affixes(evaluate):
    shown = evaluate(lambda c: display.number_display(c, decpoint=".", thousands="", prefix="ca. ", postfix=" kg"), "2750.5")
    assert shown == ["ca. 2750.5 kg"]


def test_engineering(evaluate):
    signs = {-6: "a", -5: "f", -4: "p", -3: "n", -2: "µ", -1: "m", 1: "k", 2: "M", 3: "G", 4: "T"}
    for power in range(-18, 15):
        if power // 3 not in signs:
            continue  # from one up to a thousand there is no sign
        expected = f"{2.5 * 10 ** (power % 3):g}{NNBSP}{signs[power // 3]}"
        assert evaluate(display.engineering, f"2.5e{power}") == [expected]
    # past the ends the outermost signs stay
    assert evaluate(display.engineering, "7e16", "7e-20") == [f"70000{NNBSP}T", f"0.07{NNBSP}a"]
    assert evaluate(display.engineering, "0", "-40000") == ["0", "-40000"]


def test_url_titles(evaluate):
    for scheme in ("http", "https", "ftp"):
        for host in ("seeds.example", "herbarium.seeds.example"):
            for www in ("", "www."):
                bare = [f"{scheme}://{www}{host}{end}" for end in ("", "/")]
                more = [f"{scheme}://{www}{host}/{end}" for end in ("moss", "fern/2", "?page=3", "#spores")]
                assert evaluate(display.url_title, *bare) == [host] * 2
                assert evaluate(display.url_title, *more) == [f"{host}/…"] * 4


def test_hue(evaluate):
    colours = ["#ff0000", "#00ff00", "#0000ff", "#ff00ff", "#888888", "red", ""]
    assert evaluate(display.hue, *colours) == [0.0, 120.0, 240.0, 300.0, 0.0, 0.0, 0.0]


def test_dates_shown(evaluate):
    assert evaluate(display.date_display, "2020-02-03", "x") == ["2020/02/03", ""]


def test_ids(evaluate):
    assert evaluate(ids.clean_id, "Some NS:My Page", "a//b", ":x:", "de:**") == [
        "some_ns:my_page", "a:b", "x", "de",
    ]
    assert evaluate(ids.namespace, "a:b:c", "c") == ["a:b", ""]
    assert evaluate(ids.page_name, "a:b:c", "c") == ["c", "c"]
    assert evaluate(ids.namespace_prefixes, "a:b", "") == [["a", "a:b"], []]


def test_references(evaluate):
    built = evaluate(lambda c: refs.reference(c, F.lit(5)), "pa\"ge", "")
    assert built == ['["pa\\"ge",5]', '["",5]']
    assert evaluate(refs.referenced_page, '["a",5]', "bad", "") == ["a", None, None]
    assert evaluate(refs.referenced_row, '["a",5]', '["a","6"]', "bad") == [5, 6, None]
    assert evaluate(refs.decoded, '["a",5]', "", "x") == [["a", "5"], [], None]
    assert evaluate(refs.decode_error, "", "x") == [None, "not a JSON list: x"]


def cleaned(evaluate, kind, *values):
    return evaluate(lambda c: kind.checked(kind.parsed(c))[0], *values)


def errors(evaluate, kind, *values):
    return [e is not None for e in evaluate(lambda c: kind.checked(kind.parsed(c))[1], *values)]


def test_decimal_validation(evaluate):
    values = ["-7.25", "-7,25", "0", "3.0", "12", "12.0001", "seven", "12 kg"]
    for low in ("", "-7.25", "0", "3.5"):
        for high in ("", "-1", "3", "12"):
            expected = []
            for value in values:
                try:
                    number = decimal.Decimal(value.replace(",", "."))
                except decimal.InvalidOperation:
                    expected.append(True)
                    continue
                below = low != "" and number < decimal.Decimal(low)
                expected.append(below or (high != "" and number > decimal.Decimal(high)))
            assert errors(evaluate, Decimal({"min": low, "max": high}), *values) == expected, (low, high)
    assert cleaned(evaluate, Decimal(), "\t-0,75 ", "18") == ["-0.75", "18"]


def test_date_validation(evaluate):
    assert cleaned(evaluate, Date(), "2017-04-12", "2017-4-1 18:00") == ["2017-04-12", "2017-04-01"]
    assert errors(evaluate, Date(), "2017-02-31", "2017-13-31", "foo", "2017-02", "2016-02-29") == [
        True, True, True, True, False,
    ]
    past = Date({"pastonly": True, "now": "2020-01-01 00:00:00"})
    assert errors(evaluate, past, "2019-12-31", "2020-01-02") == [False, True]
    future = Date({"futureonly": True, "now": "2020-01-01 00:00:00"})
    assert errors(evaluate, future, "2019-12-31", "2020-01-02") == [True, False]


def test_datetime_validation(evaluate):
    shown = cleaned(evaluate, DateTime(), "2017-04-12", "2017-4-1T8:05:59", "2017-04-12 23:59")
    assert shown == ["2017-04-12 00:00", "2017-04-01 08:05", "2017-04-12 23:59"]
    bad = errors(evaluate, DateTime(), "2017-02-31 10:00", "2017-04-12 24:00", "2017-04-12 10:60", "x")
    assert bad == [True] * 4


def test_other_validation(evaluate):
    colours = ["#123abc", " #123EDF ", "#ffffff"]
    assert cleaned(evaluate, Color(), *colours) == ["#123abc", "#123edf", ""]
    assert errors(evaluate, Color(), "ffffff", "foo bar", "#ccc", "#123abc") == [True] * 3 + [False]
    assert errors(evaluate, Mail(), "a@example.com", "foo", "a b@example.com") == [False, True, True]
    assert errors(evaluate, Mail({"postfix": "@example.com"}), "foo") == [False]
    assert errors(evaluate, Url({"autoscheme": ""}), "foo", "https://x.org") == [True, False]
    assert errors(evaluate, Url(), "foo", "gem://x") == [False, True]
    assert errors(evaluate, Media(), "wiki:a.png", "b.PDF", "c") == [False, True, True]
    assert errors(evaluate, Media({"mime": "image/, application/"}), "b.pdf") == [False]
    assert cleaned(evaluate, Page(), "Some Page#A b", "x") == ["some_page#a_b", "x"]
    assert cleaned(evaluate, LongText(), "a\r\nb\rc  \n") == ["a\nb\nc"]
    assert cleaned(evaluate, Text(), "  a ") == ["a"]


def test_relative_dates():
    day = date(2024, 1, 31)
    assert relative_date("", day) == day
    assert relative_date("+1 month", day) == date(2024, 3, 2)
    assert relative_date("-2 weeks", day) == date(2024, 1, 17)
    assert relative_date("3 days ago", day) == date(2024, 1, 28)
    assert relative_date("2020-02-29 +1 year", day) == date(2021, 3, 1)
    assert relative_date("tomorrow", day) == date(2024, 2, 1)
    with pytest.raises(StructureError):
        relative_date("whenever", day)
