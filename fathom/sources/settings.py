"""Configurations and quality gates from files."""

from __future__ import annotations

import json
import tomllib
from dataclasses import fields, replace
from pathlib import Path

from fathom.plans.analysis import Config
from fathom.sources.catalog import SEVERITIES

#: Names that are looked for, in this order, in a folder and those above it.
NAMES = ("fathom.toml", ".fathom.toml", "fathom.json")
TEMPLATE = """# Analysis settings
min_severity = "info"
# enabled_rules = ["S106"]
disabled_rules = []
exclude_patterns = ["target/", "build/", "node_modules/", ".git/"]
max_complexity = 15
max_params = 7
max_nesting = 4
# fail_on_severity = "critical"
"""


def parse(text: str) -> dict:
    """TOML, or else JSON."""
    try:
        return tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return json.loads(text)


def config(text: str) -> Config:
    known = {f.name for f in fields(Config)}
    return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in parse(text).items() if k in known})


def discover(folder: str) -> Config | None:
    at = Path(folder).resolve()
    for place in (at, *at.parents):
        for name in NAMES:
            if (place / name).is_file():
                return config((place / name).read_text())
    return None


def merge(left: Config, right: Config) -> Config:
    """Settings of the right side, and the left one's where the right has the default."""
    default = Config()
    return replace(left, **{f.name: getattr(right, f.name) for f in fields(Config) if getattr(right, f.name) != getattr(default, f.name)})


def gate(text: str) -> list[tuple]:
    """Conditions (type, severity, threshold); severities have to be in lower case."""
    out = []
    for c in parse(text).get("conditions", []):
        if c.get("severity") is not None and c["severity"] not in SEVERITIES:
            raise ValueError(f"unknown severity {c['severity']}")
        out.append((c["type"], c.get("severity"), c.get("threshold")))
    return out


def gate_or_pass(path: str) -> list[tuple]:
    """A gate that can't be loaded has no conditions, and so passes."""
    try:
        return gate(Path(path).read_text())
    except (OSError, ValueError, KeyError):
        return []


def write_template(path: str) -> None:
    Path(path).write_text(TEMPLATE)
