"""Settings from a TOML file and the environment; the environment wins, bad values are refused at once."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from .errors import ConfigError

PREFIX = "TIDEMARK_"


class Secret(str):
    """Text that doesn't show itself in logs."""

    __slots__ = ()

    def __repr__(self) -> str:
        return "Secret('***')"

    def __str__(self) -> str:
        return "***"

    def reveal(self) -> str:
        return str.__str__(self)


@dataclass(frozen=True)
class Config:
    parquet_path: str
    cdc_path: str
    postgres_uri: Secret
    postgres_schemas: tuple[str, ...] = ("public",)
    cache_max_entries: int = 1024
    cache_ttl_seconds: int = 300
    cdc_poll_seconds: int = 10


_KEYS = tuple(Config.__dataclass_fields__)


def _text(name: str, value: Any) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ConfigError(f"{name} is needed and must not be blank")
    return value.strip()


def _positive(name: str, value: Any) -> int:
    try:
        number = int(value) if not isinstance(value, bool) and not isinstance(value, float) else None
    except ValueError:
        number = None
    if number is None or number <= 0:
        raise ConfigError(f"{name} must be a positive whole number")
    return number


def load(path: str | None = None, env: Mapping[str, str] | None = None) -> Config:
    """`path`, or the file that TIDEMARK_CONFIG names, or ./tidemark.toml if there; a file that is named must exist."""
    env = os.environ if env is None else env
    named = path or env.get(PREFIX + "CONFIG")
    file = Path(named or "tidemark.toml")
    values: dict[str, Any] = {}
    if file.exists():
        try:
            values = tomllib.loads(file.read_text())
        except tomllib.TOMLDecodeError as e:
            raise ConfigError(f"{file}: {e}") from e
        if unknown := set(values).difference(_KEYS):
            raise ConfigError(f"{file}: unknown settings {', '.join(sorted(unknown))}")
    elif named:
        raise ConfigError(f"{file} does not exist")
    for key in _KEYS:
        if (given := env.get(PREFIX + key.upper())) is not None:
            values[key] = given
    if "DATABASE_URL" in env:
        values["postgres_uri"] = env["DATABASE_URL"]
    uri = _text("postgres_uri", values.get("postgres_uri"))
    if not uri.startswith(("postgres://", "postgresql://")) and "=" not in uri:
        raise ConfigError("postgres_uri must be a postgres:// address or key=value pairs")
    schemas = values.get("postgres_schemas", ["public"])
    schemas = [s.strip() for s in (schemas.split(",") if isinstance(schemas, str) else schemas)]
    if not schemas or not all(schemas):
        raise ConfigError("postgres_schemas needs at least one name and no blank ones")
    return Config(
        _text("parquet_path", values.get("parquet_path")),
        _text("cdc_path", values.get("cdc_path")),
        Secret(uri),
        tuple(schemas),
        *(_positive(k, values.get(k, Config.__dataclass_fields__[k].default)) for k in ("cache_max_entries", "cache_ttl_seconds", "cdc_poll_seconds")),
    )
