"""Settings from the environment and a .env file, one base of all errors, and logging."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass, fields
from pathlib import Path


class EngineError(Exception):
    """Base of every error that this package raises on purpose."""


class ConfigError(EngineError):
    """A setting cannot be read."""


@dataclass(frozen=True)
class Settings:
    """Where things lie and how sources are fetched; folders may be of any file system Spark reaches, save ``cache``."""

    seed: int = 20260911
    n_customers: int = 25_000
    data: str = "data"
    cache: str = ""
    ttl_days: float = 7.0
    timeout: float = 30.0
    max_retries: int = 4
    log_level: str = "INFO"


def read_env(path: str | Path) -> dict[str, str]:
    """KEY=value lines: blank ones and comments are skipped, ``export`` and matching quotes are taken off."""
    found = {}
    for line in Path(path).read_text().splitlines():
        name, sign, value = line.strip().removeprefix("export ").partition("=")
        if sign and not name.startswith("#"):
            value = value.strip()
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "'\""
            found[name.strip()] = value[1:-1] if quoted else value
    return found


def settings(env_file: str | Path | None = None, environ: dict[str, str] | None = None) -> Settings:
    """HARBORLINE_<NAME> of the environment, then of the file, then the default; an empty value is none."""
    given = read_env(env_file) if env_file and Path(env_file).is_file() else {}
    given |= {k: v for k, v in (os.environ if environ is None else environ).items() if v.strip()}
    chosen = {}
    for f in fields(Settings):
        raw = given.get(f"HARBORLINE_{f.name.upper()}", "").strip()
        if raw:
            try:
                chosen[f.name] = type(f.default)(raw)
            except ValueError as e:
                raise ConfigError(f"HARBORLINE_{f.name.upper()}={raw!r} is no {type(f.default).__name__}") from e
    return Settings(**chosen)


def logger(name: str = "harborline") -> logging.Logger:
    """A logger below the package's own; handlers and levels are the application's choice."""
    return logging.getLogger(name if name.startswith("harborline") else f"harborline.{name}")


def log_to_console(level: str = "INFO") -> None:
    """Sends the package's messages to stderr; a second call changes the level only."""
    top = logger()
    if not any(h.get_name() == "harborline" for h in top.handlers):
        handler = logging.StreamHandler()
        handler.set_name("harborline")
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        top.addHandler(handler)
    top.setLevel(level.upper())
