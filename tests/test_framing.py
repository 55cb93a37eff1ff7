import io

import pytest

from lettermill.sources.framing import Line, classify, headers_of, patch_mailbox, spans

GOOD = [b"From ", b"From a@b Thu Jan  1 00:00:00 1970", b"From - Mon Feb 29 9:05:61 2016", b"From x Thu Apr 16 09:53:04 +0000 2015", b"From x Thu Apr 16 09:53:04 2015 CEST", b"\xef\xbb\xbfFrom a Fri Mar 3 23:59:59 2023 -0800\r\n"]
BAD = [b"From here on", b"from a Thu Jan 1 00:00:00 1970", b">From a Thu Jan 1 00:00:00 1970", b"From a Thu Jan 1 00:00:00 1970<br>", b"From a Thu Jan 32 00:00:00 1970", b"From a Thu Jan 1 24:00:00 1970", b"From a Thu Jan 1 00:00:00 70", b"From a thu Jan 1 00:00:00 1970", b"From \xff", b"From a Thu Jan 1 00:00:00 1970 cest", b"From a b Thu Jan 1 00:00:00 1970 +0000"]

MAIL = (
    b"dropped text\n"
    b"From a@x Thu Jan  1 00:00:00 1970\nSubject: one\n\nbody\nFrom here to there\n>From a@x Thu Jan  1 00:00:00 1970\n\n"
    b"From \nSubject: two\n\nx\n"  # no blank line before the next one
    b"From b@x Fri Jan  2 00:00:00 1970\nSubject: three\n"
    b"From c@x Fri Jan  2 00:00:00 1970 CET\nSubject: four\n\nFrom c Mon Sep 17 00:00:00 2001\nend"
)


@pytest.mark.parametrize("line", GOOD)
def test_separators(line):
    assert classify(line) is Line.SEPARATOR


@pytest.mark.parametrize("line", BAD)
def test_content(line):
    assert classify(line) is Line.CONTENT


def whole(data, patches=False):
    return list(spans(io.BytesIO(data), 0, len(data), len(data), patches))


def test_spans():
    found = whole(MAIL)
    assert [MAIL[o : o + n].split(b"Subject: ")[1].split(b"\n")[0] for o, n in found] == [b"one", b"two", b"three", b"four"]
    assert found[0][0] == len(b"dropped text\n") and sum(found[-1]) == len(MAIL)
    assert all(a + n == b for (a, n), (b, _) in zip(found, found[1:]))


@pytest.mark.parametrize("step", [1, 7, 64, 97, 1000])
@pytest.mark.parametrize("patch", [False, True])
def test_ranges_give_the_same_messages(step, patch):
    data = b"From d Mon Sep 17 00:00:00 2001\nSubject: patch\n\n\n" * patch + MAIL
    patches = patch_mailbox(data.split(b"\n")[0])
    assert patches is patch
    found = [s for a in range(0, len(data), step) for s in spans(io.BytesIO(data), a, min(a + step, len(data)), len(data), patches)]
    assert found == whole(data, patches)
    assert len(found) == 4 + 2 * patch


def test_first_line_is_lenient_and_empty_file():
    assert whole(b"From me to you\nSubject: x\n\n") == [(0, 27)]
    assert whole(b"") == []


def test_headers_end_at_the_first_blank_line():
    o, n = whole(MAIL)[0]
    assert headers_of(io.BytesIO(MAIL), o, n).endswith(b"Subject: one\n")
    o, n = whole(MAIL)[2]
    assert headers_of(io.BytesIO(MAIL), o, n).endswith(b"Subject: three\n")


def test_blocks_smaller_than_lines(monkeypatch):
    import lettermill.sources.framing as f

    expected = whole(MAIL)
    for block in (1, 3, 16):
        monkeypatch.setattr(f, "BLOCK", block)
        assert whole(MAIL) == expected
