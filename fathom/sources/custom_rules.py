"""Rules of the user's own, from YAML: ids start with ``CUSTOM-``; one bad rule makes the whole file bad."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

CATEGORIES = ("Naming", "Security", "Bug", "CodeSmell", "Complexity", "Documentation", "Performance")
SEVERITIES = ("info", "minor", "major", "critical", "blocker")


@dataclass(frozen=True)
class CustomRule:
    rule_id: str
    title: str
    severity: str
    category: str
    pattern: str
    message: str
    negative_pattern: str | None = None
    debt_minutes: int = 5
    description: str | None = None


def custom_rule(spec: dict) -> CustomRule:
    """A checked rule; ValueError if anything is wrong with it."""
    missing = [k for k in ("id", "title", "severity", "category", "pattern", "message") if not spec.get(k)]
    if missing:
        raise ValueError(f"custom rule lacks {', '.join(missing)}")
    if not spec["id"].startswith("CUSTOM-"):
        raise ValueError(f"{spec['id']}: ids of custom rules start with CUSTOM-")
    category = {c.lower(): c for c in CATEGORIES}.get(re.sub(r"[_\s-]", "", spec["category"].lower()))
    if spec["severity"].lower() not in SEVERITIES or category is None:
        raise ValueError(f"{spec['id']}: unknown severity or category")
    for key in ("pattern", "negative_pattern"):
        try:
            re.compile(spec.get(key) or "")
        except re.error as e:
            raise ValueError(f"{spec['id']}: {key}: {e}") from e
    return CustomRule(spec["id"], spec["title"], spec["severity"].lower(), category, spec["pattern"], spec["message"], spec.get("negative_pattern") or None, int(spec.get("debt_minutes", 5)), spec.get("description"))


def parse_custom_rules(text: str) -> tuple[CustomRule, ...]:
    return tuple(custom_rule(spec) for spec in (parse_yaml(text) or {}).get("rules", []))


def parse_yaml(text: str):
    """YAML by the usual library where there is one, and otherwise the list of flat mappings that rule files are."""
    try:
        import yaml
    except ImportError:
        return _flat_yaml(text)
    return yaml.safe_load(text)


def _scalar(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] == '"':
        return re.sub(r'\\(["\\nt])', lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])
    if len(text) > 1 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    text = re.sub(r"\s+#.*$", "", text)
    return int(text) if re.fullmatch(r"-?\d+", text) else None if text in ("", "null", "~") else text


def _flat_yaml(text: str):
    out: dict = {}
    rows: list | None = None
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if m := re.fullmatch(r"(\w+):\s*", line):
            rows = out.setdefault(m[1], [])
        elif (m := re.fullmatch(r"\s*-\s+(\w+):\s*(.*)", line)) and rows is not None:
            rows.append({m[1]: _scalar(m[2])})
        elif (m := re.fullmatch(r"\s+(\w+):\s*(.*)", line)) and rows:
            rows[-1][m[1]] = _scalar(m[2])
        elif m := re.fullmatch(r"(\w+):\s+(.*)", line):
            out[m[1]] = _scalar(m[2])
        else:
            raise ValueError(f"not understood: {line}")
    return out


def custom_catalog(spark: SparkSession, rules: tuple[CustomRule, ...], first: int) -> DataFrame:
    """Custom rules as rows of the catalogue, numbered from ``first``."""
    rows = [(first + n, f"{r.category}:{r.rule_id}", r.rule_id, r.title, r.severity, SEVERITIES.index(r.severity), r.category, "CUSTOM", None, None, r.debt_minutes) for n, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_ord int, rule_key string, rule_id string, title string, severity string, severity_rank int, category string, kind string, owasp string, cwe int, debt_minutes int")
