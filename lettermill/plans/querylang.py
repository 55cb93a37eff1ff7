"""The search language: tokens, terms, groups and filters. Parsing never fails; what is no valid filter is dropped."""

from __future__ import annotations

import re
from calendar import monthrange
from dataclasses import dataclass
from datetime import date, timedelta
from enum import Enum


class Field(Enum):
    FROM = "from"
    TO = "to"
    CC = "cc"
    SUBJECT = "subject"
    BODY = "body"
    LABEL = "label"
    FILENAME = "filename"
    ID = "id"
    ANY = ""


@dataclass(frozen=True)
class Term:
    """One condition on a field; an exact one came in quotes, which matters to file names only."""

    field: Field
    value: str
    negated: bool = False
    exact: bool = False

    @property
    def needs_body(self) -> bool:
        return self.field in (Field.BODY, Field.FILENAME, Field.ANY)


@dataclass(frozen=True)
class DateFilter:
    """Days from ``first`` on and before ``after``; either end may be open."""

    first: date | None
    after: date | None


@dataclass(frozen=True)
class SizeFilter:
    larger: bool
    size: int


@dataclass(frozen=True)
class SearchQuery:
    """Groups are joined by AND, the terms of a group by OR."""

    groups: tuple[tuple[Term, ...], ...] = ()
    dates: tuple[DateFilter, ...] = ()
    sizes: tuple[SizeFilter, ...] = ()
    attachments: bool | None = None

    @property
    def empty(self) -> bool:
        return not (self.groups or self.dates or self.sizes) and self.attachments is None

    @property
    def needs_body(self) -> bool:
        return any(t.needs_body for g in self.groups for t in g)


UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
_FIELDS = {f.value: f for f in Field if f.value}


def tokenize(text: str) -> list[str]:
    """Parts between white space that stands outside quotes; quotes stay, an open one takes the rest."""
    return re.findall(r'(?:[^\s"]|"[^"]*(?:"|$))+', text)


def parse_day(text: str) -> date | None:
    m = re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})", text)
    try:
        return date(*map(int, m.groups())) if m else None
    except ValueError:
        return None


def parse_period(text: str) -> tuple[date, date] | None:
    """First and last day of a day, month or year."""
    if day := parse_day(text):
        return day, day
    if m := re.fullmatch(r"(\d{4})(?:-(\d{1,2}))?", text):
        year, month = int(m[1]), int(m[2] or 0)
        if year and (not m[2] or 1 <= month <= 12):
            return date(year, month or 1, 1), date(year, month or 12, monthrange(year, month or 12)[1])
    return None


def parse_date_filter(text: str) -> DateFilter | None:
    begin, dots, end = text.partition("..")
    if dots:
        a, b = parse_period(begin), parse_period(end)
        return DateFilter(a[0], _next(b[1])) if a and b else None
    period = parse_period(text)
    if not period or (re.fullmatch(r"\d{4}", text) and not 1970 <= period[0].year <= 2100):
        return None
    return DateFilter(period[0], _next(period[1]))


def _next(d: date) -> date | None:
    return d + timedelta(days=1) if d < date.max else None


def parse_size_filter(text: str) -> SizeFilter | None:
    m = re.fullmatch(r"([<>])(\d+)([a-z]*)", text.strip().lower())
    if not m or m[3] not in UNITS or (size := int(m[2]) * UNITS[m[3]]) >= 1 << 64:
        return None
    return SizeFilter(m[1] == ">", min(size, (1 << 63) - 1))


def _term(kind: Field, value: str, negated: bool) -> Term:
    exact = len(value) > 1 and value[0] == value[-1] == '"'
    return Term(kind, value[1:-1] if exact else value, negated, exact)


def parse_query(text: str) -> SearchQuery:
    """``OR`` joins the terms beside it into a group; all else is joined by AND, and a filter never joins a group."""
    groups: list[list[Term]] = []
    dates: list[DateFilter] = []
    sizes: list[SizeFilter] = []
    attachments: bool | None = None
    joining = False
    for token in tokenize(text):
        if token == "OR":
            joining = bool(groups)
            continue
        negated = token.startswith("-")
        token = token[negated:]
        prefix, colon, value = token.partition(":")
        if colon and prefix in ("has", "date", "before", "after", "size"):
            if prefix == "has":
                if value in ("attachment", "attachments", "no-attachment", "no-attachments"):
                    attachments = value.startswith("no-") == negated
            elif prefix == "size":
                sizes += [s] if (s := parse_size_filter(value)) else []
            elif prefix == "date":
                dates += [d] if (d := parse_date_filter(value)) else []
            elif day := parse_day(value):
                dates.append(DateFilter(None, day) if prefix == "before" else DateFilter(day, None))
            joining = False
            continue
        term = _term(_FIELDS[prefix], value, negated) if colon and prefix in _FIELDS else _term(Field.ANY, token, negated)
        if joining:
            groups[-1].append(term)
        else:
            groups.append([term])
        joining = False
    return SearchQuery(tuple(map(tuple, groups)), tuple(dates), tuple(sizes), attachments)


def quote_if_needed(value: str) -> str:
    value = value.replace('"', "")
    return f'"{value}"' if re.search(r"\s", value) else value


def build_query(text: str = "", from_: str = "", to: str = "", subject: str = "", date_from: str = "", date_to: str = "", size: str = "", attachment: bool | None = None, label: str = "") -> str:
    """The query text of a search form. Two dates make an inclusive range; a last day alone is exclusive."""
    parts = [text.strip()] + [f"{n}:{quote_if_needed(v.strip())}" for n, v in (("from", from_), ("to", to), ("subject", subject), ("label", label)) if v.strip()]
    if date_from and date_to:
        parts.append(f"date:{date_from}..{date_to}")
    elif date_from or date_to:
        parts.append(f"after:{date_from}" if date_from else f"before:{date_to}")
    if size:
        parts.append(f"size:{size}")
    if attachment is not None:
        parts.append("has:attachment" if attachment else "has:no-attachment")
    return " ".join(p for p in parts if p)
