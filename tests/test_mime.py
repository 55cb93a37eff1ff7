from lettermill.functions.mime import boundary_of, html_to_text, inject_source, mbox_record, parse_body, sanitize_html, skip_from_line, to_eml, to_quoted_printable

MULTI = (
    b'From a Thu Jan  1 00:00:00 1970\nSubject: s\nContent-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Type: text/plain; charset=utf-8\n\nh\xc3\xa9llo\n'
    b'--b\nContent-Type: text/plain; name="n.txt"\nContent-Disposition: attachment; filename="n.txt"\nContent-Transfer-Encoding: base64\n\naGVq\n'
    b"--b\nContent-Type: image/png\nContent-Disposition: inline\n\nxx\n--b--\n"
)


def test_body():
    body = parse_body(MULTI, payloads=True)
    assert body["text"].strip() == "héllo" and body["html"] is None and body["raw_headers"].startswith("Subject")
    a, b = body["attachments"]
    assert (a["filename"], a["size"], a["payload"], a["is_inline"]) == ("n.txt", 3, b"hej", False)
    assert (b["filename"], b["is_inline"], b["part_index"]) == ("attachment_1", True, 1)


def test_html_only():
    body = parse_body(b"Content-Type: text/html\n\n<p>One</p><script>no</script><p>Two &amp; 3</p>")
    assert "One" in body["text"] and "Two & 3" in body["text"] and "no" not in body["text"] and "<p>" in body["html"]


def test_empty_and_broken():
    assert parse_body(b"")["attachments"] == []
    assert parse_body(b"no headers at all")["text"] is not None


def test_html_to_text_width():
    assert max(map(len, html_to_text("<p>" + "word " * 50, 5).split("\n"))) <= 20
    assert html_to_text(None) is None


def test_sanitize():
    out = sanitize_html('<p onclick="x()">a<script>bad()</script><a href="javascript:x">l</a><a href="http://x/">m</a><img src=y onerror=z><b>')
    assert "onclick" not in out and "bad" not in out and "javascript" not in out and "onerror" not in out
    assert 'href="http://x/"' in out and out.endswith("</b></p>")


def test_eml():
    assert skip_from_line(b"\xef\xbb\xbfFrom a\nX: 1") == b"X: 1"
    assert to_eml(b"From a\nX: 1\n\n>From b\n>>From c\n\n\n") == b"X: 1\n\nFrom b\n>From c\n"


def test_quoted_printable():
    out = to_quoted_printable("Content-Type: text/plain; charset=utf-8\n\nübergröße\n".encode())
    assert b"quoted-printable" in out and b"=C3=BC" in out and all(b < 128 for b in out)
    assert to_quoted_printable(b"Content-Type: text/plain\n\nascii\n") == b"Content-Type: text/plain\n\nascii\n"
    nested = b'Content-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: text/plain\n\n\xe9\n--b\nContent-Type: image/png\n\n\xe9\n--b--\n'
    out = to_quoted_printable(nested)
    assert out.count(b"quoted-printable") == 1 and b"=E9" in out and b"image/png\n\n\xe9" in out
    assert boundary_of('multipart/x; boundary="a b"; c=d') == "a b" and boundary_of("text/plain") is None


def test_records():
    assert mbox_record(b"X: 1\n\nFrom me", b"From a Thu") == b"From a Thu\nX: 1\n\n>From me\n"
    assert mbox_record(b"From a\nX", b"") == b"From a\nX\n"
    assert inject_source(b"From a\r\nX: 1\r\n", "n\x00ame") == b"From a\r\nX-Mbox-Source: name\r\nX: 1\r\n"
    assert inject_source(b"X: 1\n", "n") == b"X-Mbox-Source: n\nX: 1\n"
