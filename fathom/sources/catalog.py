"""The rule catalogue: read from Markdown tables, which are a parameter of the engine.

The table of each category has the columns ``Id``, ``Severity``, ``Title``, ``Class`` and ``Detection``, and may have
``OWASP/CWE/debt`` and ``Message``, for rules whose message isn't their title.  The detection of a pattern rule is its
pattern; that of a predicate rule is in the notation of :mod:`fathom.functions.predicates`.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.predicates import Node, NotAPredicate, parse

DEFAULT = os.environ.get("FATHOM_CATALOG", str(Path(__file__).resolve().parents[1] / "data" / "catalog.md"))
SEVERITIES = ("info", "minor", "major", "critical", "blocker")
CATEGORIES = {"Naming": "Naming", "Security": "Security", "Bugs": "Bug", "Code smells": "CodeSmell", "Complexity": "Complexity"}
DEFAULT_DEBT = 5

#: Predicates of rules that the catalogue describes in words.
WORDED = {
    "Security:S2245": "line~WEAK_RANDOM",
    "Security:S4423": "line~WEAK_SSL",
    "Security:S5808": "line~PERMIT_ALL",
    "Security:S4426": '(line~WEAK_KEY AND line∋"KeyGenerator") OR line∋"KeyPairGenerator"',
    "Security:S5261": 'line~INLINE_REGEX AND (line∋"for" OR line∋"while")',
    "Security:S5361": 'line∋".replaceAll(" AND NOT line∋"Pattern"',
    "Security:S2257": 'src∋"extends MessageDigest" OR src∋"extends Cipher" OR src∋"implements Cipher"',
    "Security:S5322": 'src∋"extends BroadcastReceiver"',
    "Bug:S2134": 'src∋"extends Thread" AND NOT src∋"void run()"',
    "Bug:S2060": "line~RE",
    "Bug:S3067": 'line∋"synchronized" AND line∋"getClass()"',
    "Bug:S3984": 'line∋"new" AND line∋"Exception" AND NOT line∋"throw" AND ltrim ends ";"',
    "Bug:S4454": 'src∋"ConcurrentHashMap" AND (line∋".containsKey" OR line∋".get(")',
    "Bug:S5411": 'line∋"Boolean" AND (line∋"if (" OR line∋"while (")',
    "Bug:S5863": 'line∋"assertSame" AND (line∋"int" OR line∋"long" OR line∋"double")',
    "CodeSmell:S1132": "line~RE",
    "CodeSmell:S1135": "line~RE",
}
#: Rules that look at the trimmed line's start themselves, besides those whose predicate says so.
GUARDS = {"Naming": ("//",), "Security": ("//",), "Bug": ("//",), "Complexity": ("//",), "CodeSmell": ("//", "*")}


@dataclass(frozen=True)
class Rule:
    ordinal: int
    rule_id: str
    category: str
    severity: str
    title: str
    kind: str
    detection: str
    owasp: str | None = None
    cwe: int | None = None
    debt: int = DEFAULT_DEBT
    patterns: dict[str, str] = field(default_factory=dict, hash=False, compare=False)
    message: str | None = None

    @property
    def key(self) -> str:
        return f"{self.category}:{self.rule_id}"

    @property
    def rank(self) -> int:
        return SEVERITIES.index(self.severity)

    def predicate(self) -> Node | None:
        """The rule as a predicate on a line or file; None if it is of another kind."""
        if self.kind == "MAC":
            guards = [Node("not", (Node("starts", text=g),)) for g in GUARDS[self.category]]
            return Node("and", (*guards, Node("like", subject="line", text=self.detection)))
        if self.kind not in ("LINE", "GATE", "FILE"):
            return None
        text = WORDED.get(self.key, re.sub(r"\s*\[\w+=`.*$", "", self.detection))
        try:
            return parse(text, self.patterns)
        except NotAPredicate:
            return None


@lru_cache(maxsize=4)
def load(path: str = DEFAULT) -> tuple[Rule, ...]:
    """All rules in the order of the catalogue."""
    rules: list[Rule] = []
    category, names = None, []
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        if m := re.match(r"## (?:A\.\d+ )?([A-Za-z ]+?)(?: \(\d+\).*)?$", line):
            category = CATEGORIES.get(m[1])
        elif line.startswith("#"):
            category = None
        elif category and line.startswith("| Id |"):
            names = [{"Cls": "Class"}.get(n, n) for n in _row(line)]
        elif category and re.match(r"\| S\w+ \|", line):
            cells = dict(zip(names, _row(line)))
            extra = {}
            if m := re.fullmatch(r"(A\d\d)/CWE-(\d+)/(\d+)m", cells.get("OWASP/CWE/debt", "")):
                extra = {"owasp": m[1], "cwe": int(m[2]), "debt": int(m[3])}
            detection = cells["Detection"]
            patterns = dict(re.findall(r"(\w+)=`([^`]*)`", detection))
            if cells["Class"] == "MAC":
                detection = re.search(r"`(.*)`", detection)[1]
            rules.append(Rule(len(rules), cells["Id"], category, cells["Severity"].lower(), cells["Title"], cells["Class"], detection, **extra, patterns=patterns, message=cells.get("Message") or None))
    return tuple(rules)


def _row(line: str) -> list[str]:
    """Cells of a row; ``\\|`` is a bar in a cell."""
    cells = re.split(r"(?<!\\)\|", line.strip()[1:-1].replace("\\\\|", "\x00"))
    return [c.strip().replace("\\|", "|").replace("\x00", "\\|") for c in cells]


def rule(key: str, path: str = DEFAULT) -> Rule:
    return next(r for r in load(path) if r.key == key)


def catalog(spark: SparkSession, category: str | None = None, path: str = DEFAULT) -> DataFrame:
    """The catalogue as a table; ``category`` keeps those whose lower-case category holds it."""
    rows = [(r.ordinal, r.key, r.rule_id, r.title, r.severity, r.rank, r.category, r.kind, r.owasp, r.cwe, r.debt, r.message) for r in load(path)]
    schema = "rule_ord int, rule_key string, rule_id string, title string, severity string, severity_rank int, category string, kind string, owasp string, cwe int, debt_minutes int, rule_message string"
    df = spark.createDataFrame(rows, schema)
    return df.where(F.lower("category").contains(category.lower())) if category else df
