"""Run settings: defaults, then environment, then flags; validated once."""

from __future__ import annotations

import argparse
import logging
import os
import re
import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path


class ConfigError(ValueError):
    """Settings that cannot be run with."""


class CaptureError(RuntimeError):
    """A page that could not be captured."""


@dataclass(frozen=True)
class Config:
    start_url: str
    out_dir: str = "./knowledge-base"
    max_pages: int = 50
    max_depth: int = 5
    delay_ms: int = 500
    same_site: bool = True
    headless: bool = True
    concurrency: int = 3
    max_click_candidates: int | None = None
    max_forms_per_page: int | None = None
    auth_mode: str = "none"
    login_url: str | None = None
    username: str | None = None
    password: str | None = None
    user_selector: str | None = None
    pass_selector: str | None = None
    submit_selector: str | None = None


def _whole(value: str) -> int:
    m = re.match(r"\s*([+-]?\d+)", value)
    if not m:
        raise ConfigError(f"not a whole number: {value!r}")
    return int(m[1])


#: Setting, environment variable, flag, type.
_SETTINGS = [
    ("start_url", "SITE_URL", "--url", str), ("out_dir", "OUT_DIR", "--out", str), ("max_pages", "MAX_PAGES", "--max-pages", _whole), ("max_depth", "MAX_DEPTH", "--max-depth", _whole),
    ("delay_ms", "DELAY_MS", "--delay-ms", _whole), ("concurrency", "WORKERS", "--workers", _whole), ("headless", "HEADLESS", None, lambda v: v.lower() != "false"),
    ("max_click_candidates", None, "--max-click-candidates", _whole), ("max_forms_per_page", None, "--max-forms-per-page", _whole), ("auth_mode", "AUTH_MODE", "--auth", str), ("login_url", "LOGIN_URL", "--login-url", str),
    ("username", "USERNAME", "--username", str), ("password", "PASSWORD", "--password", str), ("user_selector", "USER_SELECTOR", "--user-selector", str), ("pass_selector", "PASS_SELECTOR", "--pass-selector", str), ("submit_selector", "SUBMIT_SELECTOR", "--submit-selector", str),
]


def load_env_file(path: str = ".env", env: dict[str, str] | None = None) -> dict[str, str]:
    """env (the process's own by default) with the file's entries that it lacks."""
    env = os.environ if env is None else env  # type: ignore[assignment]
    file = Path(path)
    for line in file.read_text(encoding="utf-8").split("\n") if file.exists() else []:
        key, mark, value = line.strip().partition("=")
        key, value = key.strip(), value.strip()
        if not mark or key.startswith("#"):
            continue
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        env.setdefault(key, value)
    return env  # type: ignore[return-value]


def from_env(env: Mapping[str, str]) -> dict:
    return {name: kind(env[var]) for name, var, _, kind in _SETTINGS if var and env.get(var)}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="webquarry", description="Analyse captured web pages.", argument_default=argparse.SUPPRESS, allow_abbrev=False)
    for name, _, flag, kind in _SETTINGS:
        if flag:
            out.add_argument(flag, dest=name, type=kind)
    out.add_argument("--allow-cross-origin", dest="same_site", action="store_false")
    out.add_argument("--headed", dest="headless", action="store_false")
    return out


def load_config(argv: Sequence[str] | None = None, env: Mapping[str, str] | None = None) -> Config:
    """Settings from flags over environment over defaults; unknown flags only warn."""
    given, unknown = parser().parse_known_args(sys.argv[1:] if argv is None else list(argv))
    for flag in unknown:
        logging.getLogger("webquarry").warning("Unknown arg: %s", flag)
    values = from_env(os.environ if env is None else env) | vars(given)
    if not values.get("start_url"):
        raise ConfigError("Missing required --url (or SITE_URL in .env).")
    values["concurrency"] = max(1, min(values.get("concurrency", 3) or 1, 8))
    return Config(**values)
