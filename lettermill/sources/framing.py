"""Message boundaries of MBOX bytes, for any byte range of a file."""

from __future__ import annotations

import re
from collections.abc import Iterator
from enum import Enum
from typing import BinaryIO

from ..schema import MAX_HEADER_BYTES, MAX_MESSAGE_BYTES

BOM = b"\xef\xbb\xbf"
BLOCK = 4 << 20
MAX_LINE_BYTES = 8 << 20


class Line(Enum):
    CONTENT = 0
    SEPARATOR = 1
    PATCH = 2


_DAY = r"(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)"
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_DATE = r"(?:[12]\d|3[01]|0?[1-9]|\+[1-9])"
_CLOCK = r"(?:[01]?\d|2[0-3]|\+\d):(?:[0-5]?\d|\+\d):(?:[0-5]?\d|6[01]|\+\d)"
_ZONE = r"(?:[+-]\d{4}|[A-Z]{1,5})"
_ENVELOPE = re.compile(rf"\S+ {_DAY} {_MONTH} {_DATE} {_CLOCK} (?:\d{{4}}(?: {_ZONE})?|{_ZONE} \d{{4}})", re.ASCII)
#: Fixed value: the date that marks mails made by a version control tool's patch command.
PATCH_DATE = "Mon Sep 17 00:00:00 2001"
_CANDIDATE = re.compile(rb"^(?:\xef\xbb\xbf)?From ", re.M)
_END_OF_HEADERS = re.compile(rb"^[ \t\r]*\n", re.M)


def classify(line: bytes) -> Line:
    """What a line is: a separator is a bare ``From `` or one with a sender and a complete date, a zone being optional on either side of the year."""
    line = line.removeprefix(BOM)
    if not line.startswith(b"From "):
        return Line.CONTENT
    try:
        rest = line[5:].decode()
    except UnicodeDecodeError:
        return Line.CONTENT
    tokens = re.split(r"[ \t\n\r\f]+", rest.strip(" \t\n\r\f"))
    if tokens == [""]:
        return Line.SEPARATOR
    if not _ENVELOPE.fullmatch(" ".join(tokens)):
        return Line.CONTENT
    return Line.PATCH if rest.rstrip().endswith(PATCH_DATE) else Line.SEPARATOR


def patch_mailbox(first_line: bytes) -> bool:
    """Whether patch markers separate messages: only where the file begins with one."""
    return classify(first_line) is Line.PATCH


def separators(f: BinaryIO, begin: int, end: int, patches: bool) -> Iterator[int]:
    """Offsets in [begin, end) where a separator line starts; the file's first line counts with any ``From ``."""
    if begin:
        f.seek(begin - 1)
        at, held = begin - 1, b""
    else:
        f.seek(0)
        at, held = -1, b"\n"  # as if a line had ended before the file
    while True:
        block = f.read(BLOCK)
        data = held + block
        # lines that are complete; the last one waits for the next block, unless the file ends
        stop = len(data) if not block else data.rfind(b"\n") + 1
        for m in _CANDIDATE.finditer(data, 0, stop):
            start = m.start()
            if start == 0:  # a line only if one ends before it, which is in an earlier block
                continue
            offset = at + start
            if offset >= end:
                return
            close = data.find(b"\n", start, stop)
            kind = classify(data[start : close if close >= 0 else stop])
            if offset == 0 or kind is Line.SEPARATOR or (kind is Line.PATCH and patches):
                yield offset
        if not block:
            return
        keep = max(stop - 1, 0)  # with the line end that proves the next line's start
        at, held = at + keep, data[keep:]
        if at + 1 >= end:
            return
        if len(held) > MAX_LINE_BYTES:  # one line without end: only its last byte matters
            at, held = at + len(held) - 1, b"."


def spans(f: BinaryIO, begin: int, end: int, size: int, patches: bool) -> Iterator[tuple[int, int]]:
    """(offset, length) of the messages whose separator starts in [begin, end); text before the first separator is dropped."""
    before = None
    for offset in separators(f, begin, end, patches):
        if before is not None:
            yield before, offset - before
        before = offset
    if before is not None:
        after = next((o for o in separators(f, max(end, before + 1), size, patches) if o > before), size) if end < size else size
        yield before, after - before


def headers_of(f: BinaryIO, offset: int, length: int) -> bytes:
    """The header block of a message: up to its first blank line, or all of it; ``MAX_HEADER_BYTES`` at most."""
    f.seek(offset)
    data, want = b"", 16 << 10
    while True:
        data += f.read(min(want, length, MAX_HEADER_BYTES) - len(data))
        line = data.find(b"\n") + 1
        if m := _END_OF_HEADERS.search(data, line):
            return data[: m.start()]
        if len(data) >= min(length, MAX_HEADER_BYTES) or len(data) < min(want, length):
            return data
        want *= 4


def message_at(f: BinaryIO, offset: int, length: int) -> bytes:
    """The raw message; beyond ``MAX_MESSAGE_BYTES`` the lines that do not fit are left out."""
    f.seek(offset)
    data = f.read(min(length, MAX_MESSAGE_BYTES))
    return data if length <= MAX_MESSAGE_BYTES else data[: data.rfind(b"\n") + 1]
