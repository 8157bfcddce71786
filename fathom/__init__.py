"""Static analysis of Java sources and preparation of text corpora on Apache Spark.

The names below are imported when they are first used.
"""

from importlib import import_module

_EXPORTS = {
    "fathom.functions.naming": ("format_debt", "to_camel_case", "to_pascal_case", "to_upper_snake_case"),
    "fathom.operators.autofix": ("fixed_files",),
    "fathom.operators.baseline": ("comparison", "fixed", "new", "unchanged"),
    "fathom.operators.cache": ("Cache", "config_hash"),
    "fathom.operators.coverage": ("file_coverage", "jacoco_lines", "lcov_lines", "read_coverage", "total_coverage"),
    "fathom.operators.declarations": ("class_info", "declarations", "imports", "string_literals", "uses_import"),
    "fathom.operators.duplication": ("duplicate_blocks", "duplicate_places", "duplication_summary"),
    "fathom.operators.metrics": ("source_metrics",),
    "fathom.operators.modules": ("assign",),
    "fathom.operators.reviews": ("GATES", "debt_breakdown", "debt_rating", "debt_summary", "debt_top", "exit_status", "gate_conditions", "gate_passed", "hotspot_summary", "hotspots"),
    "fathom.operators.source_rules": ("Finding", "Limits", "SourceFile", "rule"),
    "fathom.operators.suppression": ("suppressions", "unsuppressed"),
    "fathom.plans.analysis": ("Config", "active_rules", "all_issues", "issues_of_rules"),
    "fathom.sinks.reports": ("document", "report", "write"),
    "fathom.sources.builds": ("Module", "detect", "gradle", "maven", "modules_table"),
    "fathom.sources.catalog": ("Rule", "catalog", "load"),
    "fathom.sources.custom_rules": ("CustomRule", "parse_custom_rules"),
    "fathom.sources.files": ("listing", "scan", "scan_all", "scan_one"),
    "fathom.streaming.watch": ("debounced", "follow", "start", "watched"),
}
_HOME = {name: module for module, names in _EXPORTS.items() for name in names}
__version__ = "0.2.0"
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module 'fathom' has no attribute {name!r}")
    return getattr(import_module(_HOME[name]), name)
