"""Settings of a scan from a TOML file, checked before anything runs."""

from __future__ import annotations

import re
import tomllib
from pathlib import Path


class ConfigError(ValueError):
    """A setting that is missing or does not fit; the text names it."""


def _at(config: dict, path: str, default=None):
    for key in path.split("."):
        if not isinstance(config, dict) or key not in config:
            return default
        config = config[key]
    return config


def validate(config: dict) -> dict:
    """``config`` itself, or a ``ConfigError`` for its first fault."""
    if not _at(config, "http.user_agent"):
        raise ConfigError("http.user_agent is empty")
    if not _at(config, "http.request_timeout_secs"):
        raise ConfigError("http.request_timeout_secs is empty")
    secure, plain = _at(config, "dns.doh_servers", []), _at(config, "dns.dns_servers", [])
    if not secure and not plain:
        raise ConfigError("no DNS servers are named")
    for i, server in enumerate(secure):
        if not str(server.get("url", "")).startswith("https://"):
            raise ConfigError(f"dns.doh_servers[{i}].url is no https address: {server.get('url')}")
    for i, server in enumerate(plain):
        if ":" not in str(server.get("address", "")):
            raise ConfigError(f"dns.dns_servers[{i}].address has no port: {server.get('address')}")
    patterns = {f"patterns.regex.{k}": v for k, v in _at(config, "patterns.regex", {}).items()} | {f"patterns.verification.{k}": k for k in _at(config, "patterns.verification", {})}
    for name, pattern in patterns.items():
        try:
            re.compile(pattern)
        except re.error as e:
            raise ConfigError(f"{name} is no pattern: {e}") from e
    if not _at(config, "analysis.concurrency_per_depth"):
        raise ConfigError("analysis.concurrency_per_depth is empty")
    strategy = str(_at(config, "analysis.strategy", "")).lower()
    if strategy == "limits" and not _at(config, "analysis.vendor_limits_per_depth"):
        raise ConfigError("analysis.vendor_limits_per_depth is empty")
    if strategy == "budget" and not _at(config, "analysis.total_vendor_budget"):
        raise ConfigError("analysis.total_vendor_budget is zero")
    return config


def load(path: str, **overrides) -> dict:
    """The checked settings of a file; ``overrides`` (``section__key=value``) replace single ones."""
    if not Path(path).exists():
        raise ConfigError(f"{path} does not exist")
    try:
        config = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"{path} is no TOML: {e}") from e
    for name, value in overrides.items():
        *sections, key = name.split("__")
        at = config
        for s in sections:
            at = at.setdefault(s, {})
        at[key] = value
    return validate(config)
