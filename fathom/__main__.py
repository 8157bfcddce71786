"""Command line: ``python -m fathom COMMAND ...``; exit status 1 says that a gate, threshold or comparison failed."""

from __future__ import annotations

import argparse
import json
import sys
import time
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import fathom
from fathom.operators import baseline, cache, coverage, duplication, modules, reviews
from fathom.plans.analysis import Config, active_rules, all_issues
from fathom.sinks import reports
from fathom.sources import builds, catalog, custom_rules, files, settings
from fathom.streaming import watch


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fathom")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, help_: str, path: bool = True, form: bool = False) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=help_)
        if path:
            p.add_argument("path")
        if form:
            p.add_argument("--format", default="text", choices=("text", "json"))
        return p

    names = lambda text: [n for n in text.split(",") if n]
    p = add("analyse", "issues of a folder or file")
    p.add_argument("--format", default="text")
    p.add_argument("--output", help="a file for the report")
    p.add_argument("--config", help="settings file; otherwise one is looked for from the folder upwards")
    p.add_argument("--min-severity", choices=catalog.SEVERITIES)
    p.add_argument("--enable", action="append")
    p.add_argument("--disable", action="append", default=[])
    p.add_argument("--exclude", action="append", default=[], help="text of paths to leave out")
    p.add_argument("--max-complexity", type=int)
    p.add_argument("--max-params", type=int)
    p.add_argument("--max-nesting", type=int)
    p.add_argument("--custom-rules")
    p.add_argument("--module", "--modules", dest="module", type=names, action="extend", default=[])
    p.add_argument("--exclude-module", "--exclude-modules", dest="exclude_module", type=names, action="extend", default=[])
    p.add_argument("--show-modules", action="store_true")
    p.add_argument("--gate", help="strict, standard, lenient or a file")
    p.add_argument("--fail-on-severity", choices=catalog.SEVERITIES)
    p.add_argument("--fail-on-issues", action="store_true")
    p.add_argument("--compliance", choices=("owasp", "cwe"))
    p.add_argument("--summary-only", action="store_true")
    p.add_argument("--verbose", action="store_true")
    which = p.add_mutually_exclusive_group()
    which.add_argument("--cache", action="store_true")
    which.add_argument("--no-cache", action="store_true")
    p.add_argument("--cache-file", default=cache.DEFAULT, help="the cache's folder")
    p.add_argument("--show-cache-stats", action="store_true")
    add("debt", "technical debt", form=True).add_argument("--max", type=int)
    add("hotspots", "code to be looked at for security", form=True)
    p = add("duplication", "copied code", form=True)
    p.add_argument("--min-lines", type=int, default=duplication.MIN_LINES)
    p.add_argument("--keep-whitespace", action="store_true")
    p = add("baseline", "save the issues for later comparison")
    p.add_argument("--out", required=True, help="a folder, or a file that ends in .json")
    p.add_argument("--description")
    p = add("diff", "compare with a baseline", form=True)
    p.add_argument("--baseline", required=True)
    p.add_argument("--new-only", action="store_true")
    p = add("coverage", "line coverage of a report", form=True)
    p.add_argument("--threshold", type=float, default=80.0)
    p.add_argument("--uncovered", metavar="FILE", help="list the lines of a file that nothing ran")
    p = add("watch", "analyse files again when they change")
    p.add_argument("--debounce", type=int, default=300, help="milliseconds for which a file has to be quiet")
    p.add_argument("--no-initial", action="store_true")
    p.add_argument("--min-severity", default="info", choices=catalog.SEVERITIES)
    p.add_argument("--cache", action="store_true")
    p.add_argument("--cache-file", default=cache.DEFAULT)
    p.add_argument("--rounds", type=int, help="looks at the folder before it ends; without it, it doesn't")
    p = add("rules", "the rule catalogue", path=False)
    p.add_argument("--category")
    p.add_argument("--details", action="store_true")
    add("init", "write a settings template")
    add("version", "version of the library", path=False)
    return top


def scanned(spark: SparkSession, path: str, config: Config) -> DataFrame:
    return files.scan_one(spark, path) if Path(path).is_file() else files.scan(spark, path, config.exclude_patterns)


def with_modules(spark: SparkSession, path: str, issues: DataFrame) -> DataFrame:
    """Issues with their modules where the folder is a build."""
    tree = builds.detect(str(Path(path).resolve())) if Path(path).is_dir() else {}
    return modules.assign(issues, builds.modules_table(spark, tree)) if tree else issues


def issues_of(spark: SparkSession, path: str, config: Config = Config()) -> DataFrame:
    return with_modules(spark, path, all_issues(scanned(spark, path, config), config))


def configured(args: argparse.Namespace) -> Config:
    """Settings of the file, with those of the command line over them; rules that can't be read are told and left out."""
    config = settings.config(Path(args.config).read_text()) if args.config else settings.discover(args.path) or Config()
    told = {"min_severity": args.min_severity, "max_complexity": args.max_complexity, "max_params": args.max_params, "max_nesting": args.max_nesting, "enabled_rules": tuple(args.enable) if args.enable else None}
    config = replace(config, **{k: v for k, v in told.items() if v is not None})
    config = replace(config, disabled_rules=(*config.disabled_rules, *args.disable), exclude_patterns=(*config.exclude_patterns, *args.exclude))
    if source := args.custom_rules or config.custom_rules_file:
        try:
            config = replace(config, custom_rules=tuple(custom_rules.parse_custom_rules(Path(source).read_text())))
        except (OSError, ValueError) as e:
            print(f"warning: no custom rules: {e}", file=sys.stderr)
    return config


def analyse(spark: SparkSession, args: argparse.Namespace) -> int:
    config, began = configured(args), time.monotonic()
    tell = lambda text: print(text, file=sys.stderr) if args.verbose else None
    tell(f"{len(active_rules(config)) + len(config.custom_rules)} rules are active")
    if args.cache and not args.no_cache and Path(args.path).is_dir():
        tell(f"using the cache in {args.cache_file}")
        now, stats = cache.analyse(spark, args.path, cache.load(spark, args.cache_file, config), config)
        if args.show_cache_stats or args.verbose:
            row = stats.first()
            print(f"{row.hits} hits, {row.misses} misses, {row.hit_rate:.1f} % from the cache", file=sys.stderr)
        cache.save(now, args.cache_file, config)
        issues = with_modules(spark, args.path, cache.load(spark, args.cache_file, config).issues)
    else:
        issues = issues_of(spark, args.path, config)
    if args.show_modules and Path(args.path).is_dir():
        for m in builds.detect(str(Path(args.path).resolve())).values():
            print(f"{m.name} ({m.build_system}) {m.path}" + (f", in {m.parent}" if m.parent else ""))
    issues = modules.only(issues, args.module, args.exclude_module).persist()
    n = files.files_analysed(scanned(spark, args.path, config))
    spent = int(1000 * (time.monotonic() - began))
    if args.summary_only:
        pieces = [reports.summary(issues, n, spent)]
    elif args.compliance:
        rows = {"owasp": reviews.owasp_report, "cwe": reviews.cwe_report}[args.compliance](issues).collect()
        pieces = [f"{r[0]} {r['name']}: {r.n}" + (f" ({r.examples})" if r.examples else "") + "\n" for r in rows]
    elif reports.format_of(args.format) in ("csv", "gitlab", "sarif"):
        pieces = reports.document(issues, args.format)
    else:
        pieces = [reports.report(issues, args.format, n, spent)]
    write(pieces, args.output)
    gate = reviews.GATES.get(args.gate) or (settings.gate_or_pass(args.gate) if args.gate else ())
    return 0 if reviews.exit_status(issues, gate, args.fail_on_issues, args.fail_on_severity or config.fail_on_severity).first().passed else 1


def write(pieces, path: str | None) -> None:
    if path is None:
        for piece in pieces:
            print(piece, end="" if piece.endswith("\n") else "\n")
        return
    with open(path, "w", encoding="utf-8") as out:
        out.writelines(pieces)


def told(rows: DataFrame, form: str, line) -> None:
    """Rows as a JSON list or as lines."""
    found = [r.asDict(recursive=True) for r in rows.toLocalIterator()]
    print(json.dumps(found, indent=2) if form == "json" else "\n".join(map(line, found)))


def watched(spark: SparkSession, args: argparse.Namespace) -> int:
    config = Config(min_severity=args.min_severity)
    known = cache.load(spark, args.cache_file, config) if args.cache else None

    def found(source: DataFrame) -> DataFrame:
        return all_issues(source, config).persist()

    steps = watch.follow(spark, args.path, found, lambda: scanned(spark, args.path, config), lambda: files.listing(spark, args.path, config.exclude_patterns), args.debounce / 1000, initial=not args.no_initial, rounds=args.rounds)
    for kind, issues in steps:
        if known is not None:
            now, _ = cache.analyse(spark, args.path, cache.load(spark, args.cache_file, config), config)
            cache.save(now, args.cache_file, config)
        if kind == "initial":
            print(f"initial analysis: {issues.count()} issues", flush=True)
        else:
            for r in issues.orderBy(*reports.ORDER).toLocalIterator():
                print(f"{r.file}:{r.line}:{r.column} {r.severity} [{r.rule_id}] {r.message}", flush=True)
        issues.unpersist()
    return 0


def covered(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = coverage.read_coverage(spark, args.path)
    total = coverage.total_coverage(rows, args.threshold).first()
    if args.uncovered:
        told(coverage.uncovered(rows, args.uncovered).orderBy("line"), args.format, lambda r: f"{r['file']}:{r['line']}")
    elif args.format == "json":
        told(coverage.file_coverage(rows).orderBy("percentage", "file"), "json", None)
    else:
        print(f"{total.covered} of {total.covered + total.uncovered} lines, {total.percentage:.1f} %")
        told(coverage.below(rows, args.threshold).orderBy("percentage", "file"), "text", lambda r: f"{r['percentage']:5.1f} % {r['file']}")
    return 0 if total.passed else 1


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.command == "analyse":
        return analyse(spark, args)
    if args.command == "watch":
        return watched(spark, args)
    if args.command == "coverage":
        return covered(spark, args)
    if args.command == "init":
        settings.write_template(args.path)
        return 0
    if args.command == "version":
        print(f"fathom {fathom.__version__}, {len(catalog.load())} rules")
        return 0
    if args.command == "rules":
        rows = catalog.catalog(spark, args.category).orderBy("rule_ord")
        told(rows, "text", lambda r: f"{r['rule_id']} {r['severity']} {r['category']}: {r['title']}" + (f" (debt {r['debt_minutes']} min{', ' + r['owasp'] if r['owasp'] else ''}{f', CWE-{r['cwe']}' if r['cwe'] else ''})" if args.details else ""))
        return 0
    if args.command == "duplication":
        found, how = files.scan_all(spark, args.path), {"ignore_whitespace": not args.keep_whitespace}
        row = duplication.duplication_summary(found, args.min_lines, **how).first()
        if args.format == "json":
            print(json.dumps(row.asDict()))
        else:
            print(f"{row.blocks} blocks, {row.duplicated_lines} of {row.total_lines} lines, {row.percentage:.1f} %")
            told(duplication.duplicate_places(found, args.min_lines, **how).orderBy("hash", "file", "start_line"), "text", lambda r: f"{r['hash'][:8]} {r['file']}:{r['start_line']}-{r['end_line']}")
        return 0
    issues = issues_of(spark, args.path).persist()
    if args.command == "baseline":
        if args.out.endswith(".json"):
            write(baseline.document(issues, args.description), args.out)
        else:
            baseline.save(issues, args.out, args.description)
        return 0
    if args.command == "diff":
        then = baseline.load(spark, args.baseline)
        row = baseline.comparison(issues, then).first()
        if args.format == "json":
            print(json.dumps(row.asDict()))
        else:
            if not args.new_only:
                print(f"{row['new']} new, {row.fixed} fixed, {row.unchanged} unchanged: {row.net_change:+d}")
            told(baseline.new(issues, then).orderBy(*reports.ORDER), "text", lambda r: f"new {r['file']}:{r['line']} [{r['rule_id']}] {r['message']}")
        return 1 if row["new"] else 0
    if args.command == "hotspots":
        spots = reviews.hotspots(issues)
        if args.format == "json":
            told(spots.orderBy("file", "line", "rule_key"), "json", None)
        else:
            told(reviews.hotspot_summary(spots).orderBy("dimension", "name"), "text", lambda r: f"{r['dimension']} {r['name']}: {r['n']}")
            told(spots.orderBy("priority", "file", "line"), "text", lambda r: f"{r['priority']} {r['file']}:{r['line']} [{r['rule_id']}] {r['hotspot_category']}")
        return 1 if spots.where("priority = 'High'").limit(1).count() else 0
    row = reviews.debt_rating(issues, args.max).first()
    if args.format == "json":
        told(reviews.debt_summary(issues).orderBy("dimension", "name"), "json", None)
    else:
        print(f"{row.text} ({row.minutes} minutes), rating {row.rating}")
        told(reviews.debt_top(issues, "file"), "text", lambda r: f"{r['minutes']:6d} min, {r['n']} issues: {r['name']}")
        told(reviews.debt_breakdown(issues).orderBy("name"), "text", lambda r: f"{r['percentage']:5.1f} % {r['name']}")
    return 0 if row.acceptable else 1


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("fathom").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
