"""Opening and listing files by path or URI, on the driver and on executors."""

from __future__ import annotations

import glob
import os
from typing import BinaryIO

from ..schema import MailboxNotFound


def _remote(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return None if "://" in path else path


def open_file(path: str) -> BinaryIO:
    if (here := local(path)) is not None:
        if not os.path.isfile(here):
            raise MailboxNotFound(path)
        return open(here, "rb")
    system, name = _remote(path)
    return system.open_input_file(name)


def file_size(path: str) -> int:
    if (here := local(path)) is not None:
        if not os.path.isfile(here):
            raise MailboxNotFound(path)
        return os.path.getsize(here)
    system, name = _remote(path)
    info = system.get_file_info(name)
    if not info.is_file:
        raise MailboxNotFound(path)
    return info.size


def modified_ns(path: str) -> int:
    if (here := local(path)) is not None:
        return os.stat(here).st_mtime_ns
    system, name = _remote(path)
    return system.get_file_info(name).mtime_ns or 0


def expand(paths: str | list[str]) -> list[str]:
    """Paths in argument order, with local patterns expanded in name order."""
    out: list[str] = []
    for p in [paths] if isinstance(paths, str) else paths:
        here = local(p)
        out += sorted(glob.glob(here)) if here is not None and glob.has_magic(here) else [p]
    return out
