from datetime import UTC, datetime

import pytest

from lettermill.functions.headers import decode_bytes, decode_words, envelope_date, group_label, lenient_base64, message_row, parse_address, parse_addresses, parse_date, unfold


@pytest.mark.parametrize(
    ("raw", "text"),
    [
        ("=?UTF-8?B?SG9sYQ==?= =?UTF-8?B?IG11bmRv?=", "Hola mundo"),
        ("=?iso-8859-1?Q?Fran=E7ois?=", "François"),
        ("a =?utf-8?q?=C3=BC_b?= c", "a ü b c"),
        ("=?utf-8?x?abc?=", "=?utf-8?x?abc?="),
        ("=?broken", "=?broken"),
        ("=?no-such?Q?=C3=BC?=", "ü"),
        ("=?windows-1252?Q?=80?=", "€"),
        ("plain", "plain"),
    ],
)
def test_encoded_words(raw, text):
    assert decode_words(raw) == text


def test_lenient_base64():
    assert lenient_base64("SG9s YQ") == b"Hola"
    assert lenient_base64("SG9sYQ==") == b"Hola"
    assert lenient_base64("****") == b"\0\0\0"


def test_bytes_fall_back_to_windows_1252():
    assert decode_bytes(b"\xef\xbb\xbfa") == "a"
    assert decode_bytes(b"caf\xe9 \x81") == "café \x81"


def test_unfold():
    h = unfold("Subject: a\r\n\tb\nX:1\nno colon\nSUBJECT: c")
    assert h == {"subject": ["a b", "c"], "x": ["1"]}


@pytest.mark.parametrize(
    ("text", "utc"),
    [
        ("Thu, 04 Jan 2024 10:00:00 +0100", (2024, 1, 4, 9)),
        ("4 Jan 2024 10:00:00 CEST", (2024, 1, 4, 8)),
        ("Thu, 4 Jan 2024 10:00:00 EST", (2024, 1, 4, 15)),
        ("2024-01-04T10:00:00Z", (2024, 1, 4, 10)),
        ("2024-01-04T10:00:00+02:00", (2024, 1, 4, 8)),
        ("2024-01-04 10:00:00", (2024, 1, 4, 10)),
        ("16-JUL-2025 03:00:00", (2025, 7, 16, 3)),
        ("Thu Apr 16 09:00:00 +0000 2015", (2015, 4, 16, 9)),
        ("Thu Apr 16 09:00:00 2015", (2015, 4, 16, 9)),
        ("05/06/2020 07:00:00", (2020, 6, 5, 7)),
        ("05/16/2020 07:00:00", (2020, 5, 16, 7)),
    ],
)
def test_dates(text, utc):
    assert parse_date(text) == datetime(*utc, tzinfo=UTC)


def test_no_date():
    assert parse_date("") is None and parse_date("soon") is None and parse_date(None) is None
    assert envelope_date("From a@b Thu Jan  1 01:00:00 1970") == datetime(1970, 1, 1, 1, tzinfo=UTC)
    assert envelope_date("From ") is None


def test_addresses():
    assert parse_address('"Last, First" <a@b.c>') == {"display_name": "Last, First", "address": "a@b.c"}
    assert parse_address(" bare ") == {"display_name": "", "address": "bare"}
    assert [a["address"] for a in parse_addresses('"x, y" <a@b>, , c@d')] == ["a@b", "c@d"]


def test_row():
    raw = b"From g Thu Apr 16 09:53:04 +0000 2015\nFrom: =?utf-8?q?J=C3=BCrgen?= <j@x>\nTo: " + b", ".join(b"u%d@x" % i for i in range(7)) + b"\nMessage-ID: <m1@x>\nReferences: <a> junk <b>\nIn-Reply-To: raw-id\nX-Gmail-Labels: A,, B\nX-BeenThere: my-group@googlegroups.com\nX-GM-THRID:  7 \nContent-Type: Multipart/Mixed; boundary=x\n"
    r = message_row(raw)
    assert r["date"] == datetime(2015, 4, 16, 9, 53, 4, tzinfo=UTC)
    assert r["from"] == {"display_name": "Jürgen", "address": "j@x"}
    assert len(r["to"]) == 5 and r["cc"] == []
    assert (r["message_id"], r["references"], r["in_reply_to"], r["thread_id"]) == ("<m1@x>", ["<a>", "<b>"], "raw-id", "7")
    assert r["labels"] == ["A", "B", "my-group"] and r["has_attachments"] and r["content_type"] == "multipart/mixed"
    assert message_row(b"")["date"].year == 1970 and message_row(b"")["content_type"] == "text/plain"


def test_group_label():
    assert group_label({"x-google-groups": [" g "]}) == "g"
    assert group_label({"x-beenthere": ["g@other.org"]}) is None
