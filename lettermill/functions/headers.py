"""Message headers: unfolding, encoded words, addresses, dates, and the row they make."""

from __future__ import annotations

import base64
import codecs
import re
from datetime import UTC, datetime, timedelta, timezone
from email.utils import parsedate_to_datetime

from ..schema import MAX_RECIPIENTS

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
BOM = b"\xef\xbb\xbf"
#: Web labels of character sets that Python names differently or decodes differently.
LABELS = {"iso-8859-1": "cp1252", "latin1": "cp1252", "iso8859-1": "cp1252", "us-ascii": "cp1252", "ascii": "cp1252", "l1": "cp1252", "iso-8859-9": "cp1254", "x-sjis": "cp932", "shift_jis": "cp932", "gb2312": "gb18030", "gbk": "gb18030", "ks_c_5601-1987": "cp949", "euc-kr": "cp949", "unicode-1-1-utf-8": "utf-8", "x-mac-cyrillic": "mac_cyrillic", "macintosh": "mac_roman", "unicode": "utf-16-le", "utf-16": "utf-16-le"}
_WORD = re.compile(r"=\?([^?]*)\?([^?]*)\?(.*?)\?=", re.S)
_HEX = re.compile(r"=([0-9A-Fa-f]{2})")


def windows_1252(data: bytes) -> str:
    """Every byte has a character: the five that the code page leaves open are controls."""
    return "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in data) if any(b in data for b in b"\x81\x8d\x8f\x90\x9d") else data.decode("cp1252")


def decode_bytes(data: bytes) -> str:
    data = data.removeprefix(BOM)
    try:
        return data.decode()
    except UnicodeDecodeError:
        return windows_1252(data)


def decode_charset(label: str, data: bytes) -> str:
    """By a character set's label; an unknown one is read as UTF-8."""
    name = label.strip().lower()
    name = LABELS.get(name, name)
    if name == "cp1252":
        return windows_1252(data)
    try:
        return data.decode(codecs.lookup(name).name, "replace")
    except (LookupError, UnicodeError):
        return data.decode("utf-8", "replace")


def lenient_base64(text: str) -> bytes:
    """Base64 whose foreign characters count as zero bits and whose end may be missing."""
    text = re.sub(r"[ \t\r\n]", "", text)
    out = b""
    for i in range(0, len(text), 4):
        quad = text[i : i + 4].ljust(4, "=")
        pad = (quad[3] == "=") + (quad[3] == "=" and quad[2] == "=")
        out += base64.b64decode(re.sub(r"[^A-Za-z0-9+/]", "A", quad))[: 3 - pad]
    return out


def decode_q(text: str) -> bytes:
    raw = text.replace("_", " ")
    return b"".join(bytes([int(p, 16)]) if i % 2 else p.encode() for i, p in enumerate(_HEX.split(raw)))


def decode_words(value: str) -> str:
    """RFC 2047 encoded words; white space between two of them goes, and what cannot be decoded stays."""
    out, at, after_word = [], 0, False
    while (start := value.find("=?", at)) >= 0:
        gap = value[at:start]
        if not after_word or gap.strip():
            out.append(gap)
        m = _WORD.match(value, start)
        kind = m[2].upper() if m else ""
        if kind not in ("B", "Q"):
            out.append("=?")
            at, after_word = start + 2, False
            continue
        out.append(decode_charset(m[1], lenient_base64(m[3]) if kind == "B" else decode_q(m[3])))
        at, after_word = m.end(), True
    return "".join(out) + value[at:]


def unfold(text: str) -> dict[str, list[str]]:
    """Header values by lower-cased name, in order; a continuation is joined by one space, a line without a colon is dropped."""
    lines: list[str] = []
    for line in text.split("\n"):
        line = line.removesuffix("\r")
        if line[:1] in (" ", "\t") and lines:
            lines[-1] += " " + line.strip()
        else:
            lines.append(line)
    out: dict[str, list[str]] = {}
    for name, colon, value in (x.partition(":") for x in lines):
        if colon:
            out.setdefault(name.strip().lower(), []).append(value.strip())
    return out


def angle_tokens(value: str) -> list[str]:
    return re.findall(r"<[^>]*>", value)


def parse_address(raw: str) -> dict[str, str]:
    raw = raw.strip()
    begin, end = raw.rfind("<"), raw.rfind(">")
    if 0 <= begin < end:
        name = raw[:begin].strip()
        if len(name) > 1 and name[0] == name[-1] == '"':
            name = name[1:-1].strip()
        return {"display_name": name, "address": raw[begin + 1 : end].strip()}
    return {"display_name": "", "address": raw}


def parse_addresses(raw: str) -> list[dict[str, str]]:
    """A list split at commas that stand in neither quotes nor angle brackets; empty addresses go."""
    parts, quoted, angled = [""], False, False
    for c in raw:
        if c == '"':
            quoted = not quoted
        elif c in "<>" and not quoted:
            angled = c == "<"
        elif c == "," and not quoted and not angled:
            parts.append("")
            continue
        parts[-1] += c
    return [a for a in map(parse_address, parts) if a["address"]]


#: Named zones by their offsets; a longer name comes before one that ends it.
ZONES = {"CEST": "+0200", "CET": "+0100", "JST": "+0900", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700", "GMT": "+0000", "UTC": "+0000"}
#: Date layouts in the order they are tried.
LAYOUTS = ("%d %b %Y %H:%M:%S %z", "%d %b %Y %H:%M:%S", "%b %d %H:%M:%S %Y", "%b %d %H:%M:%S %z %Y", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%d %H:%M:%S %z", "%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M:%S", "%m/%d/%Y %H:%M:%S")
_WEEKDAY = re.compile(r"(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[, ]\s*")
_HYPHENS = re.compile(r"-(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)-")


def _utc(d: datetime) -> datetime:
    return (d if d.tzinfo else d.replace(tzinfo=UTC)).astimezone(UTC)


def parse_date(value: str | None) -> datetime | None:
    """A mail date in UTC. Tried in turn: RFC 2822, RFC 3339, the layouts (a date without zone is UTC), any other RFC 2822-like one."""
    value = (value or "").strip()
    for name, offset in ZONES.items():
        if value.endswith(name):
            value = value[: -len(name)] + offset
            break
    if not value:
        return None
    try:
        if re.match(r"(?:[A-Za-z]{3},)?\s*\d{1,2}\s+[A-Za-z]{3}\s+\d{2,4}\s+\d", value):
            return _utc(parsedate_to_datetime(value))
    except (ValueError, TypeError, OverflowError):
        pass
    try:
        if re.match(r"\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)$", value):
            return _utc(datetime.fromisoformat(value.upper()))
    except ValueError:
        pass
    plain = _WEEKDAY.sub("", value, count=1) if _WEEKDAY.match(value) else value
    for text in dict.fromkeys((plain.strip(), _HYPHENS.sub(lambda m: f" {m[1].title()} ", plain.strip(), count=1))):
        for layout in LAYOUTS:
            try:
                return _utc(datetime.strptime(text, layout))
            except (ValueError, OverflowError):
                continue
    try:
        return _utc(parsedate_to_datetime(value))
    except (ValueError, TypeError, IndexError, OverflowError):
        return None


def envelope_date(first_line: str) -> datetime | None:
    """The date of a ``From `` line: what follows the sender."""
    parts = first_line.split(None, 2) if first_line.startswith("From ") else []
    return parse_date(parts[2]) if len(parts) > 2 else None


def group_label(headers: dict[str, list[str]]) -> str | None:
    """The discussion group of a message, from its group header or its list address."""
    if group := headers.get("x-google-groups", [""])[0].strip():
        return group
    local, at, domain = headers.get("x-beenthere", [""])[0].strip().partition("@")
    return local if local and at and domain.lower() == "googlegroups.com" else None


def message_row(raw: bytes) -> dict:
    """The message columns from a header block (any body is ignored)."""
    text = decode_bytes(raw)
    h = unfold(text)
    first = lambda name: h.get(name, [""])[0]
    addresses = lambda name: parse_addresses(decode_words(first(name)))[:MAX_RECIPIENTS]
    labels = [x for x in (p.strip() for p in decode_words(first("x-gmail-labels")).split(",")) if x]
    if (group := group_label(h)) and group not in labels:
        labels.append(group)
    kind = first("content-type").split(";")[0].strip().lower() or "text/plain"
    reply = first("in-reply-to")
    ids = angle_tokens(first("message-id"))
    return {
        "date": parse_date(first("date")) or envelope_date(text.split("\n", 1)[0]) or EPOCH,
        "from": parse_address(decode_words(first("from"))),
        "to": addresses("to"),
        "cc": addresses("cc"),
        "subject": decode_words(first("subject")),
        "message_id": ids[0] if ids else first("message-id").strip(),
        "in_reply_to": (angle_tokens(reply) or [reply.strip()])[0] or None,
        "references": angle_tokens(first("references")),
        "has_attachments": kind.startswith(("multipart/mixed", "multipart/related")) or any("attachment" in v.lower() for v in h.get("content-disposition", [])),
        "content_type": kind,
        "text_size": 0,
        "labels": labels,
        "thread_id": first("x-gm-thrid").strip() or None,
    }


def clamp(date: datetime) -> datetime:
    """Within what a timestamp column can hold."""
    return min(max(date, datetime(1, 1, 2, tzinfo=UTC)), datetime(9999, 12, 30, tzinfo=timezone(timedelta(0))))
