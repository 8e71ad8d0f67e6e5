"""Configuration and the corpus contract: found upward from a folder, checked strictly."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Any

import yaml

from quillmere.functions.markdown import Loader
from quillmere.sources.corpus import SKIP

# Names and defaults of the configuration.
FILE = ".quillmere.yaml"
ENVIRONMENT = "QUILLMERE_CONFIG"
DEBOUNCE_MS = 6_000
ON_CHANGE_TIMEOUT_MS = 120_000
KEYS = {"version", "role", "rule_packs", "profiles", "default_profile", "scan", "watch", "foreign_roots", "rule_params", "cache", "strict"}
ROLES = ("private", "team", "public")


@dataclass
class Config:
    role: str = ""
    rule_packs: list[str] = field(default_factory=list)
    profiles: dict[str, dict] = field(default_factory=dict)
    default_profile: str = ""
    skip: list[str] = field(default_factory=lambda: list(SKIP))
    max_file_size: int = 0
    debounce_ms: int = DEBOUNCE_MS
    ignore: list[str] = field(default_factory=list)
    hooks: list[dict] = field(default_factory=list)
    on_change_timeout_ms: int = ON_CHANGE_TIMEOUT_MS
    foreign_roots: list[str] = field(default_factory=list)
    rule_params: dict[str, dict] = field(default_factory=dict)
    cache: bool = True
    strict: bool = False


def parse(text: str) -> Config:
    raw = yaml.load(text, Loader=Loader) or {}
    if not isinstance(raw, dict) or (unknown := sorted(set(raw) - KEYS)):
        raise ValueError(f"unknown configuration keys: {', '.join(unknown) if isinstance(raw, dict) else 'not a mapping'}")
    scan, watch = raw.get("scan") or {}, raw.get("watch") or {}
    if raw.get("role", "") not in ("", *ROLES):
        raise ValueError(f"unknown role {raw['role']!r}")
    return Config(
        raw.get("role", ""), [p["path"] for p in raw.get("rule_packs") or []], raw.get("profiles") or {}, raw.get("default_profile", ""), scan.get("skip", list(SKIP)), int(scan.get("max_file_size", 0)),
        int(watch.get("debounce_ms", DEBOUNCE_MS)), watch.get("ignore") or [], parse_hooks(watch.get("hooks") or []), int(watch.get("on_change_timeout_ms", ON_CHANGE_TIMEOUT_MS)), raw.get("foreign_roots") or [], raw.get("rule_params") or {},
        bool((raw.get("cache") or {}).get("enabled", True)), bool(raw.get("strict", False)),
    )


def parse_hooks(raw: Any) -> list[dict]:
    """Hooks as rows (op, action, scope); delete has none."""
    entries = [{"on": k, **v} for k, v in raw.items()] if isinstance(raw, dict) else raw
    out = []
    for h in entries:
        if h.get("on") not in ("create", "modify") or not isinstance(h.get("action"), str):
            raise ValueError(f"bad hook {h!r}")
        out.append({"op": h["on"], "action": h["action"], "scope": h.get("scope", ".")})
    return out


def discover(start: str) -> str | None:
    """The configuration that holds for a folder: named by the environment, else the nearest above."""
    if named := os.environ.get(ENVIRONMENT):
        return named
    here = os.path.abspath(start)
    while True:
        if os.path.isfile(os.path.join(here, FILE)):
            return os.path.join(here, FILE)
        if os.path.dirname(here) == here:
            return None
        here = os.path.dirname(here)


def effective_schema(base: dict[str, Any], local: dict[str, Any]) -> dict[str, Any]:
    """A contract with what a corpus states laid over it, key by key at the top; the corpus wins."""
    return base | local


def role(config_role: str, page_role: str) -> str:
    """The role, declared in one place only."""
    if config_role and page_role:
        raise ValueError("the role is declared both in the configuration and in the corpus")
    return config_role or page_role or "private"
