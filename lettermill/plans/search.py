"""Queries over messages as two filters: one on message columns, which reaches the scan, and one on decoded bodies."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date
from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mime import parse_body
from ..functions.text import contains_folded
from ..schema import BODY
from ..sources.mbox import fetch_raw
from .querylang import DateFilter, Field, SearchQuery, Term, parse_query

ATTACHMENT = pa.struct([("filename", pa.string()), ("content_type", pa.string()), ("size", pa.int64()), ("encoding", pa.string()), ("content_id", pa.string()), ("is_inline", pa.bool_()), ("content_offset", pa.int64()), ("content_length", pa.int64()), ("part_index", pa.int32()), ("payload", pa.binary())])
BODY_ARROW = pa.struct([("text", pa.string()), ("html", pa.string()), ("raw_headers", pa.string()), ("attachments", pa.list_(ATTACHMENT))])


def _in_address(a: Column, needle: str) -> Column:
    return contains_folded(a["address"], needle) | contains_folded(a["display_name"], needle)


def _metadata_term(t: Term) -> Column:
    """A term as far as message columns decide it."""
    match t.field:
        case Field.FROM:
            return _in_address(F.col("from"), t.value)
        case Field.TO | Field.CC:
            return F.exists(t.field.value, lambda a: _in_address(a, t.value))
        case Field.SUBJECT:
            return contains_folded(F.col("subject"), t.value)
        case Field.LABEL:
            return F.exists("labels", lambda x: contains_folded(x, t.value))
        case Field.ID:
            return contains_folded(F.col("message_id"), t.value)
        case Field.ANY:
            return contains_folded(F.col("subject"), t.value) | _in_address(F.col("from"), t.value) | F.exists("to", lambda a: _in_address(a, t.value))
    return F.lit(False)


def _full_term(t: Term) -> Column:
    """A term with its negation, given a column ``body``."""
    if t.field is Field.BODY:
        found = contains_folded(F.col("body.text"), t.value)
    elif t.field is Field.FILENAME:
        name = lambda a: F.lower(a["filename"])
        found = F.exists("body.attachments", lambda a: name(a) == F.lower(F.lit(t.value)) if t.exact else contains_folded(a["filename"], t.value))
        found = F.coalesce(found, F.lit(False))
    elif t.field is Field.ANY:
        found = _metadata_term(t) | contains_folded(F.col("body.text"), t.value)
    else:
        found = _metadata_term(t)
    return ~found if t.negated else found


def _metadata_or_negated(t: Term) -> Column:
    return ~_metadata_term(t) if t.negated else _metadata_term(t)


def _day(d: date) -> Column:
    return F.lit(f"{d.isoformat()} 00:00:00").cast("timestamp")


def _date_range(d: DateFilter) -> list[Column]:
    return ([F.col("date") >= _day(d.first)] if d.first else []) + ([F.col("date") < _day(d.after)] if d.after else [])


def compile_query(q: SearchQuery, bodies: bool = True) -> tuple[Column | None, Column | None]:
    """(filter on message columns, filter that also needs ``body``). With ``bodies`` false all terms look at message columns only."""
    meta: list[Column] = [c for d in q.dates for c in _date_range(d)]
    meta += [F.col("length") > s.size if s.larger else F.col("length") < s.size for s in q.sizes]
    if q.attachments is not None:
        meta.append(F.col("has_attachments") == F.lit(q.attachments))
    body: list[Column] = []
    for group in q.groups:
        if bodies and any(t.needs_body for t in group):
            body.append(reduce(or_, map(_full_term, group)))
        else:
            meta.append(reduce(or_, map(_metadata_or_negated, group)))
    return (reduce(and_, meta) if meta else None), (reduce(and_, body) if body else None)


def decode_bodies(messages: DataFrame, payloads: bool = False) -> DataFrame:
    """``messages`` with a column ``body``, from their raw bytes, which are fetched if they are not there.

    A message that cannot be read gets a null body."""
    with_raw = messages if "raw" in messages.columns else fetch_raw(messages)
    kept = [c for c in with_raw.columns if c != "body"]

    def run(columns: pa.Array) -> pa.Array:
        return pa.array([None if r is None else parse_body(r, payloads) for r in columns.to_pylist()], BODY_ARROW)

    def batches(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in it:
            yield pa.concat_arrays([run(column.slice(i, 32)) for i in range(0, len(column), 32)]) if len(column) else pa.array([], BODY_ARROW)

    return with_raw.select(*kept).withColumn("body", F.arrow_udf(batches, BODY, F.ArrowUDFType.SCALAR_ITER)("raw"))


def search(messages: DataFrame, query: str | SearchQuery, bodies: bool = True, with_body: Callable[[DataFrame], DataFrame] = decode_bodies) -> DataFrame:
    """The messages that match; an empty query matches all.

    The filter on message columns comes first, so that only survivors are decoded. A message whose body cannot be
    read matches no condition on bodies, not even a negated one. ``with_body`` adds the column ``body`` where it is
    not there yet.
    """
    q = parse_query(query) if isinstance(query, str) else query
    meta, body = compile_query(q, bodies)
    out = messages if meta is None else messages.where(meta)
    if body is None:
        return out
    decoded = out if "body" in out.columns else with_body(out)
    return decoded.where(F.col("body").isNotNull() & body).select(*messages.columns)


def within(messages: DataFrame, scope: DataFrame, keys: tuple[str, ...] = ("mailbox", "offset")) -> DataFrame:
    """Messages that are also in ``scope``: a search inside earlier results, or a selection by marks."""
    return messages.join(scope.select(*keys), list(keys), "left_semi")


def without(messages: DataFrame, marked: DataFrame, keys: tuple[str, ...] = ("mailbox", "offset")) -> DataFrame:
    return messages.join(marked.select(*keys), list(keys), "left_anti")


def with_label(messages: DataFrame, label: str | None) -> DataFrame:
    """Messages with exactly this label; all for none."""
    return messages if label is None else messages.where(F.array_contains("labels", label))
