"""Settings from a TOML file; whatever cannot be read leaves the defaults."""

from __future__ import annotations

import os
import tomllib
from dataclasses import asdict, dataclass, fields

from .schema import RANGE_BYTES


@dataclass
class Config:
    range_bytes: int = RANGE_BYTES
    cache_dir: str = ""
    sanitize_html: bool = True
    top_senders: int = 10


def config_path() -> str:
    return os.environ.get("LETTERMILL_CONFIG") or os.path.join(os.environ.get("XDG_CONFIG_HOME", os.path.expanduser("~/.config")), "lettermill", "config.toml")


def load_config(path: str | None = None) -> Config:
    try:
        with open(path or config_path(), "rb") as f:
            found = tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError):
        return Config()
    kinds = {f.name: type(f.default) for f in fields(Config)}
    return Config(**{k: v for k, v in found.items() if k in kinds and type(v) is kinds[k]})


def save_config(config: Config, path: str | None = None) -> None:
    path = path or config_path()
    os.makedirs(os.path.dirname(path), exist_ok=True)
    quote = lambda v: str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"'
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(f"{k} = {quote(v)}\n" for k, v in asdict(config).items())
