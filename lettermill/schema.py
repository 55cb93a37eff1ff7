"""Schemas of messages, bodies and attachments, and the limits of the readers."""

from __future__ import annotations

ADDRESS = "struct<display_name:string,address:string>"
MESSAGE = (
    f"mailbox string, offset bigint, length bigint, date timestamp, `from` {ADDRESS}, `to` array<{ADDRESS}>, cc array<{ADDRESS}>, subject string, message_id string, in_reply_to string, "
    "`references` array<string>, has_attachments boolean, content_type string, text_size bigint, labels array<string>, thread_id string, part int, ordinal bigint, raw binary"
)
ATTACHMENT = "struct<filename:string,content_type:string,size:bigint,encoding:string,content_id:string,is_inline:boolean,content_offset:bigint,content_length:bigint,part_index:int,payload:binary>"
BODY = f"struct<text:string,html:string,raw_headers:string,attachments:array<{ATTACHMENT}>>"

MAX_RECIPIENTS = 5
MAX_MESSAGE_BYTES = 256 << 20
MAX_HEADER_BYTES = 16 << 20
RANGE_BYTES = 64 << 20
INDEX_VERSION = 4


class MailError(Exception):
    """Any failure of this package."""


class MailboxNotFound(MailError):
    """A mailbox path that does not exist."""


class InvalidIndex(MailError):
    """An index that cannot be read."""


class ParseError(MailError):
    """Bytes that cannot be parsed, with their offset."""

    def __init__(self, offset: int, message: str):
        super().__init__(f"at byte {offset}: {message}")
        self.offset = offset


class ExportError(MailError):
    """An output that cannot be written."""
