from datetime import date

import pytest

from lettermill.plans.querylang import DateFilter, Field, SizeFilter, Term, build_query, parse_query, tokenize


def groups(text):
    return [[(t.field.value, t.value, t.negated) for t in g] for g in parse_query(text).groups]


def test_tokens():
    assert tokenize('a "b c" d:"e f"g "open end') == ["a", '"b c"', 'd:"e f"g', '"open end']


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("from:a OR from:b subject:c", [[("from", "a", False), ("from", "b", False)], [("subject", "c", False)]]),
        ("a OR OR b", [[("", "a", False), ("", "b", False)]]),
        ("OR a OR", [[("", "a", False)]]),
        ("-to:x", [[("to", "x", True)]]),
        ("FROM:x", [[("", "FROM:x", False)]]),
        ("from:", [[("from", "", False)]]),
        ("-", [[("", "", True)]]),
        ('"OR"', [[("", "OR", False)]]),
        ('from:"John Doe"', [[("from", "John Doe", False)]]),
        ('"abc', [[("", '"abc', False)]]),
        ("date:2024 OR from:a", [[("from", "a", False)]]),
    ],
)
def test_terms(text, expected):
    assert groups(text) == expected


@pytest.mark.parametrize("text", ["", "  ", "size:5mb", "date:2024-13", "has:foo", "size:>1.5mb", "size:>99999999999gb", "date:1969", "before:2024-06"])
def test_dropped(text):
    assert parse_query(text).empty


def test_filters():
    q = parse_query("date:2024-02 -date:1969..1970 before:2024-1-5 after:2020-01-01 size:>2kb has:no-attachment -has:no-attachments")
    assert q.dates == (DateFilter(date(2024, 2, 1), date(2024, 3, 1)), DateFilter(date(1969, 1, 1), date(1971, 1, 1)), DateFilter(None, date(2024, 1, 5)), DateFilter(date(2020, 1, 1), None))
    assert q.sizes == (SizeFilter(True, 2048),) and q.attachments is True


def test_exact_names():
    assert parse_query('filename:"a.txt"').groups[0][0] == Term(Field.FILENAME, "a.txt", False, True)
    assert parse_query("x").needs_body and not parse_query("from:x").needs_body


def test_build():
    assert build_query("t", from_="a b", date_from="2024-01-01", date_to="2024-02-01", size=">1mb", attachment=False) == 't from:"a b" date:2024-01-01..2024-02-01 size:>1mb has:no-attachment'
    assert build_query(date_to="2024-02-01") == "before:2024-02-01"
