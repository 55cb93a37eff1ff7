"""What a mailbox is called: package folders, group exports, and names that stay apart in a list."""

from __future__ import annotations

from pathlib import PurePosixPath

GROUP_DOMAIN = "@googlegroups.com"
MOST_LEVELS = 4


def is_group_folder(name: str) -> bool:
    return name.lower().endswith(GROUP_DOMAIN) and len(name) > len(GROUP_DOMAIN)


def presentation_path(path: str) -> PurePosixPath:
    """The path whose last part names the mailbox: a ``Name.mbox`` package for its inner ``mbox`` file, a group's folder for a file in it."""
    p = PurePosixPath(path)
    if p.name == "mbox" and p.parent.suffix.lower() == ".mbox" and p.parent.stem:
        return p.parent
    return p.parent if is_group_folder(p.parent.name) else p


def display_name(path: str) -> str:
    return presentation_path(path).name or str(path)


def _at_level(path: str, level: int) -> str:
    parts = [x for x in presentation_path(path).parts if x != "/"]
    return "/".join(parts[-level:])


def unique_display_names(paths: list[str]) -> list[str]:
    """Names with as many trailing path parts, ``MOST_LEVELS`` at most, as tell them apart; equal paths stay equal."""
    levels = [1] * len(paths)
    for _ in range(MOST_LEVELS - 1):
        names = [_at_level(p, n) for p, n in zip(paths, levels, strict=True)]
        clash = {n for n in names if len({paths[i] for i, m in enumerate(names) if m == n}) > 1}
        if not clash:
            break
        levels = [n + (name in clash) for n, name in zip(levels, names, strict=True)]
    return [_at_level(p, n) for p, n in zip(paths, levels, strict=True)]
