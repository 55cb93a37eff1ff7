"""Column functions on strings, addresses, dates and sizes; and the few that need Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .headers import clamp, decode_words, parse_addresses, parse_date
from .mime import html_to_text, sanitize_html

#: Trimming takes all Unicode white space, which trim() does not.
_EDGES = r"(?U)^\s+|\s+$"
FILE_NAME_BYTES = 200


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def contains_folded(c: Column, needle: str) -> Column:
    """Case-insensitive substring, both sides lowered by Spark; an empty needle is in everything."""
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lower(F.lit(needle)))


def address_display(a: Column) -> Column:
    return F.when(a["display_name"] == "", a["address"]).otherwise(F.concat(a["display_name"], F.lit(" <"), a["address"], F.lit(">")))


def normalize_id(c: Column) -> Column:
    """A Message-ID without white space around it and without its angle brackets."""
    return trim_all(F.regexp_replace(trim_all(c), "^<+|>+$", ""))


def normalize_subject(c: Column) -> Column:
    """Lower case without reply and forward prefixes."""
    return F.lower(F.regexp_replace(trim_all(c), r"(?iU)^(?:(?:re:|fwd:|fw:)\s*)+", ""))


def file_name_part(c: Column, chars: int) -> Column:
    """At most ``chars`` characters that are safe in a file name; never empty."""
    safe = F.replace(F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}\-._@]", "_"), 1, chars), F.lit(".."), F.lit("_"))
    bare = F.regexp_replace(safe, r"^\.+|\.+$", "")
    return F.when(bare == "", F.lit("unknown")).otherwise(bare)


def cut_bytes(c: Column, most: int) -> Column:
    """The longest prefix of ``most`` UTF-8 bytes or fewer."""
    raw = F.substring(F.encode(c, "utf-8"), 1, most)
    # a character that is cut decodes to a replacement character at the end
    return F.when(F.octet_length(c) <= most, c).otherwise(F.regexp_replace(F.decode(raw, "utf-8"), "�+$", ""))


def message_file_name(date: Column, parts: list[tuple[Column, int]], extension: str) -> Column:
    """``{date}_{part}...{extension}``, cut to ``FILE_NAME_BYTES``."""
    stem = F.concat_ws("_", F.date_format(date, "yyyyMMdd_HHmmss"), *(file_name_part(c, n) for c, n in parts))
    whole = F.concat(stem, F.lit(extension))
    return F.when(F.octet_length(whole) > FILE_NAME_BYTES, F.concat(cut_bytes(stem, FILE_NAME_BYTES - len(extension)), F.lit(extension))).otherwise(whole)


def csv_field(c: Column) -> Column:
    """A field quoted where it must be; one that a spreadsheet would take for a formula gets an apostrophe."""
    guarded = F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
    return F.when(guarded.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(guarded)


def escape_html(c: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def quote_from(c: Column) -> Column:
    return F.regexp_replace(c, "(?m)^From ", ">From ")


def unquote_from(c: Column) -> Column:
    return F.regexp_replace(c, "(?m)^>(>*From )", "$1")


def header_value(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\x00-\x1F\x7F]", ""))


def urls(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"""(https?://[^\s>)"]*)"""), F.lit(1))


def human_size(n: Column) -> Column:
    """Binary units: a whole number as it is, any other with two digits, exact halves to the even one."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1024**i, _in_unit(n.cast("long"), 1024**i, unit)).otherwise(out)
    return out


def _in_unit(n: Column, size: int, unit: str) -> Column:
    # whole units and the rest apart, so that nothing is rounded before the last digit
    whole, rest = F.shiftright(n, size.bit_length() - 1), n % size
    cents, over = F.shiftright(rest * 100, size.bit_length() - 1), (rest * 100) % size
    cents = cents + F.when((over * 2 > size) | ((over * 2 == size) & (cents % 2 == 1)), 1).otherwise(0)
    full = F.concat((whole + F.floor(cents / 100)).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return F.concat(F.when(rest == 0, whole.cast("string")).otherwise(full), F.lit(f" {unit}"))


def ctime(d: Column) -> Column:
    """``Www Mmm dd hh:mm:ss yyyy`` with the day padded by a blank."""
    return F.concat(F.date_format(d, "EEE MMM "), F.lpad(F.dayofmonth(d).cast("string"), 2, " "), F.date_format(d, " HH:mm:ss yyyy"))


def rfc3339(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def from_line(address: Column, date: Column) -> Column:
    sender = F.regexp_replace(F.coalesce(address, F.lit("")), r"(?U)\s", "")
    return F.concat(F.lit("From "), F.when(sender == "", F.lit("MAILER-DAEMON")).otherwise(sender), F.lit(" "), ctime(date))


def group_label(groups: Column, been_there: Column) -> Column:
    """A group's name from its header, else from the list address."""
    named, posted = F.nullif(trim_all(groups), F.lit("")), trim_all(been_there)
    return F.coalesce(named, F.nullif(F.regexp_extract(posted, r"(?i)^([^@]+)@googlegroups\.com$", 1), F.lit("")))


def thread_indent(depth: Column) -> Column:
    return F.when(depth == 0, F.lit("")).otherwise(F.concat(F.repeat(F.lit("│"), F.least(depth, F.lit(4)) - 1), F.lit("└ ")))


def header_lines(raw: Column) -> Column:
    """(label, value) of each line of a header block that has a colon."""
    lines = F.filter(F.split(raw, "\r?\n"), lambda x: F.contains(x, F.lit(":")))
    return F.transform(lines, lambda x: F.struct(F.substring_index(x, ":", 1).alias("label"), trim_all(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))


def wrap_next(current: int, n: int, step: int = 1) -> int | None:
    """The next of n matches, past the end at the first again."""
    return (current + step) % n if n else None


# ---- functions that need Python --------------------------------------------------------------


def match_ranges(text: str, needle: str) -> list[tuple[int, int]]:
    """Byte ranges of the case-insensitive matches that do not overlap."""
    if not needle:
        return []
    folded, places = [], []
    for i, c in enumerate(text):
        for low in c.lower():
            folded.append(low)
            places.append(i)
    hay, want, out, at = "".join(folded), needle.lower(), [], 0
    starts = [0]
    for c in text:
        starts.append(starts[-1] + len(c.encode()))
    while (at := hay.find(want, at)) >= 0:
        end = at + len(want)
        if (at == 0 or places[at] != places[at - 1]) and (end == len(hay) or places[end] != places[end - 1]):
            out.append((starts[places[at]], starts[places[end - 1] + 1]))
            at = end
        else:
            at += 1
    return out


def char_width(c: str) -> int:
    return 0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1


def terminal_line(text: str, tab: int = 8) -> str:
    """Tabs to the next stop by display width; other control characters made visible as U+FFFD."""
    out, column = [], 0
    for c in text:
        if c == "\t":
            c = " " * (tab - column % tab)
        elif unicodedata.category(c) == "Cc":
            c = "�"
        out.append(c)
        column += sum(map(char_width, c))
    return "".join(out)


def cut_width(text: str, most: int) -> str:
    """Text of ``most`` columns at most, an ellipsis standing for what is cut."""
    if sum(map(char_width, text)) <= most:
        return text
    out, used = "", 0
    for c in text:
        if used + char_width(c) > most - 3:
            break
        out += c
        used += char_width(c)
    return out + "..." if most > 3 else "." * most


def _on_strings(f, c: Column | str) -> Column:
    """f on each string of a column, a batch at a time; a null stays null."""

    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f(v) for v in values.to_pylist()], pa.string())

    return F.arrow_udf(run, "string", F.ArrowUDFType.SCALAR)(c)


def rfc2047_decode(c: Column | str) -> Column:
    return _on_strings(decode_words, c)


def html_text(c: Column | str) -> Column:
    return _on_strings(html_to_text, c)


def html_clean(c: Column | str) -> Column:
    return _on_strings(sanitize_html, c)


def safe_line(c: Column | str) -> Column:
    return _on_strings(terminal_line, c)


def mail_date(c: Column) -> Column:
    """A mail date as a timestamp; null where no layout fits."""

    def run(values: pa.Array) -> pa.Array:
        return pa.array([clamp(d) if (d := parse_date(v)) else None for v in values.to_pylist()], pa.timestamp("us", "UTC"))

    return F.arrow_udf(run, "timestamp", F.ArrowUDFType.SCALAR)(c)


def address_list(c: Column) -> Column:
    def run(values: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("display_name", pa.string()), ("address", pa.string())]))
        return pa.array([None if v is None else parse_addresses(v) for v in values.to_pylist()], kind)

    return F.arrow_udf(run, "array<struct<display_name:string,address:string>>", F.ArrowUDFType.SCALAR)(c)


def body_matches(c: Column, needle: str) -> Column:
    """(line, start, end) of each match in a text, lines counted from 0, places in bytes of the line."""

    def run(values: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("line", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        rows = [[{"line": n, "start": a, "end": b} for n, line in enumerate((v or "").split("\n")) for a, b in match_ranges(line, needle)] for v in values.to_pylist()]
        return pa.array(rows, kind)

    return F.arrow_udf(run, "array<struct<line:int,start:int,end:int>>", F.ArrowUDFType.SCALAR)(c)


def register(spark: SparkSession) -> None:
    """The Python functions under their SQL names."""
    for name, f in (("rfc2047_decode", decode_words), ("html_to_text", html_to_text), ("sanitize_html", sanitize_html), ("terminal_line", terminal_line)):

        def run(values: pd.Series, f=f) -> pd.Series:
            return values.map(f, na_action="ignore")

        spark.udf.register(name, F.pandas_udf(run, "string"))
