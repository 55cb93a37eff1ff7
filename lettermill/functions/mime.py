"""Message bodies: texts, attachments, and rewriting of raw messages."""

from __future__ import annotations

import html
import re
from email import message_from_bytes, policy
from email.message import Message
from html.parser import HTMLParser

from .headers import BOM, decode_bytes, decode_charset, decode_words

MAX_DEPTH = 32


def skip_from_line(raw: bytes) -> bytes:
    raw = raw.removeprefix(BOM)
    return raw.partition(b"\n")[2] if raw.startswith(b"From ") else raw


def header_end(raw: bytes) -> int:
    """Where the header block ends: the earlier of the two kinds of blank line, or the end."""
    ends = [i for i in (raw.find(b"\n\n"), raw.find(b"\r\n\r\n")) if i >= 0]
    return min(ends, default=len(raw))


class _Text(HTMLParser):
    """Visible text with line breaks at blocks and bullets at list items."""

    BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
    SILENT = frozenset("script style head title template".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.SILENT:
            self.silent += 1
        elif tag in self.BLOCKS:
            self.out.append("\n* " if tag == "li" else "\n")
        elif tag in ("td", "th"):
            self.out.append(" ")

    def handle_endtag(self, tag):
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(re.sub(r"\s+", " ", data))


def html_to_text(source: str | None, width: int = 80) -> str | None:
    """The text of an HTML page, its lines wrapped at ``width`` (20 at least) columns between words."""
    if source is None:
        return None
    parser = _Text()
    parser.feed(source)
    parser.close()
    lines: list[str] = []
    for line in "".join(parser.out).split("\n"):
        now = ""
        for word in line.split():
            if now and len(now) + 1 + len(word) > max(20, width):
                lines.append(now)
                now = word
            else:
                now = f"{now} {word}" if now else word
        lines.append(now)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")


#: The elements, attributes and link kinds that sanitized HTML keeps.
ALLOWED = frozenset("a abbr acronym area article aside b bdi bdo blockquote br caption center cite code col colgroup data dd del details dfn div dl dt em figcaption figure footer h1 h2 h3 h4 h5 h6 header hgroup hr i img ins kbd li map mark nav ol p pre q rp rt ruby s samp small span strike strong sub summary sup table tbody td th thead time tr tt u ul var wbr".split())
ATTRIBUTES = frozenset("lang title href src alt width height align valign colspan rowspan cite datetime start span".split())
SCHEMES = frozenset("http https mailto ftp ftps tel sms news irc xmpp".split())
DROPPED = frozenset("script style".split())
VOID = frozenset("area br col hr img wbr".split())


class _Sanitizer(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.dropped = 0
        self.open: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.dropped += 1
        elif tag in ALLOWED and not self.dropped:
            kept = [(n, v or "") for n, v in attrs if n in ATTRIBUTES and (n not in ("href", "src", "cite") or self._safe(v or ""))]
            self.out.append("<" + "".join([tag, *(f' {n}="{html.escape(v)}"' for n, v in kept), ' rel="noopener noreferrer"' if tag == "a" else ""]) + ">")
            if tag not in VOID:
                self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        if tag not in DROPPED:
            self.handle_starttag(tag, attrs)

    @staticmethod
    def _safe(url: str) -> bool:
        scheme, colon, _ = re.sub(r"[\x00-\x20]", "", url).partition(":")
        return not colon or "/" in scheme or "?" in scheme or "#" in scheme or scheme.lower() in SCHEMES

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.dropped = max(0, self.dropped - 1)
        elif tag in self.open and not self.dropped:
            while (last := self.open.pop()) != tag:
                self.out.append(f"</{last}>")
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.dropped:
            self.out.append(html.escape(data, quote=False))


def sanitize_html(source: str | None) -> str | None:
    """Only allowed elements, attributes and link schemes; scripts and styles go with their content."""
    if source is None:
        return None
    parser = _Sanitizer()
    parser.feed(source)
    parser.close()
    return "".join(parser.out) + "".join(f"</{t}>" for t in reversed(parser.open))


def _payload(part: Message) -> bytes:
    if part.get_content_type() == "message/rfc822" and part.is_multipart():
        return part.get_payload(0).as_bytes()
    return part.get_payload(decode=True) or b""


def _decoded(part: Message) -> str:
    label = part.get_content_charset()
    data = _payload(part)
    return (decode_charset(label, data) if label else decode_bytes(data)).replace("\r\n", "\n")


def _file_name(part: Message) -> str | None:
    try:
        name = part.get_filename()
    except (LookupError, UnicodeError, ValueError):
        name = None
    return decode_words(name).strip() or None if name else None


def _leaves(part: Message, depth: int = 0):
    if part.get_content_maintype() == "multipart" and part.is_multipart() and depth < 100:
        for sub in part.get_payload():
            yield from _leaves(sub, depth + 1)
    else:
        yield part


def parse_body(raw: bytes, payloads: bool = False) -> dict:
    """text, html, raw_headers and attachments of a raw message.

    text is the first text part, or else the HTML rendered as text; html the first HTML part, null without one.
    Attachments are the leaves that have a file name or an attachment disposition, or are neither of
    these bodies nor text; ``payload`` is their content if asked for.
    """
    raw = skip_from_line(raw)
    split = header_end(raw)
    out: dict = {"text": None, "html": None, "raw_headers": decode_bytes(raw[:split]), "attachments": []}
    try:
        leaves = list(_leaves(message_from_bytes(raw, policy=policy.compat32)))
    except Exception:  # a parser failure is the message's own: its bytes are all there is
        return out | {"text": decode_bytes(raw[split:].lstrip(b"\r\n"))}
    for part in leaves:
        disposition, name, kind = (part.get_content_disposition() or ""), _file_name(part), part.get_content_type()
        if disposition != "attachment" and not name:
            if kind == "text/plain" and out["text"] is None:
                out["text"] = _decoded(part)
                continue
            if kind == "text/html" and out["html"] is None:
                out["html"] = _decoded(part)
                continue
            if part.get_content_maintype() == "text":
                continue
        data = _payload(part)
        index = len(out["attachments"])
        out["attachments"].append({"filename": name or f"attachment_{index}", "content_type": kind if part.get("content-type") else "application/octet-stream", "size": len(data), "encoding": "", "content_id": None, "is_inline": disposition == "inline", "content_offset": 0, "content_length": len(data), "part_index": index, "payload": data if payloads else None})
    if out["text"] is None and out["html"] is not None:
        out["text"] = html_to_text(out["html"], 80)
    return out


def to_eml(raw: bytes, quoted_printable: bool = False) -> bytes:
    """A record as a message file: without its ``From `` line, quoted ``From `` lines opened, blank lines at the end dropped."""
    raw = raw.partition(b"\n")[2] if raw.startswith(b"From ") else raw
    raw = re.sub(rb"(?m)^>(>*From )", rb"\1", raw)
    while raw.endswith((b"\n\n", b"\n\r\n")):
        raw = raw[: -2 if raw.endswith(b"\r\n") else -1]
    return to_quoted_printable(raw) if quoted_printable else raw


def _qp(data: bytes, newline: bytes) -> bytes:
    """Quoted-printable lines of 76 characters at most; line ends stay."""
    out = []
    for line in re.split(rb"\r?\n", data):
        now, lines = b"", []
        tokens = [bytes([b]) if (33 <= b <= 126 and b != 61) or b in (9, 32) else b"=%02X" % b for b in line]
        if tokens and tokens[-1] in (b" ", b"\t"):
            tokens[-1] = b"=%02X" % tokens[-1][0]
        for t in tokens:
            if len(now) + len(t) > 75:
                lines.append(now + b"=")
                now = b""
            now += t
        out.append(newline.join([*lines, now]))
    return newline.join(out)


def to_quoted_printable(raw: bytes, depth: int = 0) -> bytes:
    """8-bit ``text/*`` leaves re-encoded as quoted-printable; all other bytes stay, ``MAX_DEPTH`` multipart levels deep."""
    m = re.search(rb"\r?\n\r?\n", raw)
    if not m or depth > MAX_DEPTH:
        return raw
    head, gap, body = raw[: m.start()], m[0], raw[m.end() :]
    newline = b"\r\n" if b"\r\n" in head or gap.startswith(b"\r\n") else b"\n"
    fields = re.split(rb"\r?\n(?![ \t])", head)
    value = lambda n: next((decode_bytes(f.partition(b":")[2]).strip() for f in fields if f.partition(b":")[0].strip().lower() == n), "")
    kind = value(b"content-type") or "text/plain"
    if kind.lower().startswith("multipart/"):
        boundary = boundary_of(kind)
        if not boundary:
            return raw
        mark = re.compile(rb"(?m)^--" + re.escape(boundary.encode()) + rb"(?:--)?[ \t]*\r?$\n?")
        marks = list(mark.finditer(body))
        out, at = [], 0
        for i, b in enumerate(marks):
            piece = body[at : b.start()]
            if i:
                tail = re.search(rb"\r?\n\Z", piece)
                core = piece[: tail.start()] if tail else piece
                piece = to_quoted_printable(core, depth + 1) + (tail[0] if tail else b"")
            out += [piece, b[0]]
            at = b.end()
        return head + gap + b"".join(out) + body[at:]
    encoding = value(b"content-transfer-encoding").lower()
    if not kind.lower().startswith("text/") or encoding in ("base64", "quoted-printable") or not any(b > 127 for b in body):
        return raw
    kept = [f for f in fields if f.partition(b":")[0].strip().lower() != b"content-transfer-encoding"]
    return newline.join([*kept, b"Content-Transfer-Encoding: quoted-printable"]) + gap + _qp(body, newline)


def boundary_of(content_type: str) -> str | None:
    m = re.search(r'boundary\s*=\s*(?:"([^"]*)"|([^\s;]+))', content_type, re.I)
    return (m[1] if m[1] is not None else m[2]) or None if m else None


def inject_source(raw: bytes, name: str) -> bytes:
    """An ``X-Mbox-Source`` header after the ``From `` line, with that line's kind of line end; first of all if there is none."""
    header = b"X-Mbox-Source: " + re.sub(r"[\x00-\x1f\x7f]", "", name).strip().encode()
    bom, rest = (BOM, raw[3:]) if raw.startswith(BOM) else (b"", raw)
    if not rest.startswith(b"From ") or b"\n" not in rest:
        return bom + header + (b"\r\n" if b"\r\n" in rest[:4096] else b"\n") + rest
    first, _, after = rest.partition(b"\n")
    newline = b"\r\n" if first.endswith(b"\r") else b"\n"
    return bom + first + b"\n" + header + newline + after


def mbox_record(raw: bytes, from_line: bytes) -> bytes:
    """A record that can stand in a mailbox: as it is if it begins with ``From ``, else with that line and quoted lines; ends with a line end."""
    if not raw.startswith(b"From "):
        raw = from_line + b"\n" + re.sub(rb"(?m)^From ", b">From ", raw)
    return raw if raw.endswith(b"\n") else raw + b"\n"
