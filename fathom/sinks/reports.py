"""Reports of issues.  Rows are made by expressions on the cluster; only documents meant for reading come to the driver."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.sources.catalog import SEVERITIES

NAME, VERSION = "fathom", "0.1.0"
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
FORMATS = {"text": "text", "txt": "text", "json": "json", "html": "html", "sarif": "sarif", "csv": "csv", "markdown": "markdown", "md": "markdown", "gitlab": "gitlab", "codequality": "gitlab", "gitlab-code-quality": "gitlab"}
CSV_HEADER = "file,line,column,severity,rule_id,title,message"


def format_of(name: str) -> str | None:
    """The format that a name stands for, or None."""
    return FORMATS.get(name.lower())


def relative_path(path: Column) -> Column:
    """An absolute path from its first ``/src/`` below the root on, without the slash; other paths as they are."""
    return F.regexp_replace(path, "(?s)^/.*?/src/", "src/")


def csv_lines(issues: DataFrame) -> DataFrame:
    """``value``: each issue as a line; file, title and message stand in quotes."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    return issues.select(F.concat_ws(",", quote("file"), F.col("line").cast("string"), F.col("column").cast("string"), "severity", "rule_id", quote("title"), quote("message")).alias("value"))


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("blocker", "critical"), "error").when(severity == "major", "warning").otherwise("note")


def sarif_results(issues: DataFrame) -> DataFrame:
    """``value``: each issue as a result object."""
    region = F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return issues.select(F.to_json(F.struct(F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("value"))


def fingerprint(issues: DataFrame | None = None) -> Column:
    """Sixteen hex digits of rule, file, line and message."""
    return F.substring(F.md5(F.concat_ws("\u0001", "rule_id", "file", F.col("line").cast("string"), "message")), 1, 16)


def gitlab_rows(issues: DataFrame) -> DataFrame:
    """``value``: each issue as a code quality object."""
    where = F.struct(relative_path(F.col("file")).alias("path"), F.struct(F.col("line").alias("begin")).alias("lines"))
    return issues.select(F.to_json(F.struct(F.concat_ws(": ", "rule_id", "message").alias("description"), F.col("rule_id").alias("check_name"), fingerprint().alias("fingerprint"), "severity", where.alias("location"))).alias("value"))


def json_rows(issues: DataFrame) -> DataFrame:
    return issues.select(F.to_json(F.struct(*[c for c in issues.columns if c != "rule_ord"]), {"ignoreNullFields": "false"}).alias("value"))


ORDER = ("file", "rule_ord", "line", "column")


def write(issues: DataFrame, form: str, path: str) -> None:
    """A report as a directory of parts, in order: lines of CSV, or a JSON object a line for the other row formats."""
    rows = {"csv": csv_lines, "sarif": sarif_results, "gitlab": gitlab_rows, "json": json_rows}[format_of(form)]
    rows(issues.orderBy(*ORDER)).write.text(path)


def document(issues: DataFrame, form: str) -> Iterator[str]:
    """A CSV, GitLab or SARIF document in pieces; ordered rows come to the driver a partition at a time."""
    form = format_of(form)
    ordered = issues.orderBy(*ORDER)
    if form == "csv":
        yield CSV_HEADER + "\n"
        for r in csv_lines(ordered).toLocalIterator():
            yield r.value + "\n"
        return
    driver = json.dumps({"name": NAME, "version": VERSION, "informationUri": ""})
    start, end = {
        "gitlab": ("[", "\n]\n"),
        "sarif": (f'{{"$schema": "{SARIF_SCHEMA}", "version": "2.1.0", "runs": [{{"tool": {{"driver": {driver}}}, "results": [', "\n]}]}\n"),
    }[form]
    yield start
    for n, r in enumerate({"gitlab": gitlab_rows, "sarif": sarif_results}[form](ordered).toLocalIterator()):
        yield ("," if n else "") + "\n" + r.value
    yield end


def report(issues: DataFrame, form: str, files_analysed: int, duration_ms: int = 0, snippets: bool = True) -> str:
    """One document for a reader, with all issues; for results that a person or a tool reads whole."""
    form = format_of(form)
    if form is None:
        raise ValueError("unknown format")
    if form in ("csv", "gitlab", "sarif"):
        return "".join(document(issues, form))
    rows = [json.loads(r.value) for r in json_rows(issues.orderBy(*ORDER)).toLocalIterator()]
    counts = {s: sum(r["severity"] == s for r in rows) for s in reversed(SEVERITIES)}
    by_file: dict[str, list] = {}
    for r in rows:
        by_file.setdefault(r["file"], []).append(r)
    if form == "json":
        rules: dict[str, int] = {}
        for r in rows:
            rules[r["rule_id"]] = rules.get(r["rule_id"], 0) + 1
        summary = {"files_analyzed": files_analysed, "total_issues": len(rows), "duration_ms": duration_ms}
        return json.dumps({"summary": summary, "issues": rows, "issues_by_file": by_file, "issues_by_severity": counts, "issues_by_rule": rules}, indent=2)
    return {"text": _text, "markdown": _markdown, "html": _html}[form](by_file, counts, len(rows), files_analysed, duration_ms, snippets)


def summary(issues: DataFrame, files_analysed: int, duration_ms: int = 0) -> str:
    """Counts by severity alone, which are made on the cluster."""
    n = {r["severity"]: r["n"] for r in issues.groupBy("severity").agg(F.count("*").alias("n")).collect()}
    rows = [f"Files: {files_analysed}", f"Issues: {sum(n.values())}", f"Duration: {duration_ms} ms", *[f"{s}: {n.get(s, 0)}" for s in reversed(SEVERITIES)]]
    return "\n".join(rows) + "\n"


def _text(by_file, counts, total, files, ms, snippets):
    out = ["Analysis report", "=" * 15, f"Files: {files}", f"Issues: {total}", f"Duration: {ms} ms", "", *[f"{s}: {n}" for s, n in counts.items()], ""]
    for file, rows in sorted(by_file.items()):
        out.append(file)
        for r in rows:
            out.append(f"  {r['line']}:{r['column']} {r['severity']} [{r['rule_id']}] {r['message']}")
            if snippets and r["code_snippet"]:
                out.append(f"    | {r['code_snippet']}")
    return "\n".join(out) + "\n"


def _markdown(by_file, counts, total, files, ms, _):
    cell = lambda v: str(v).replace("|", "\\|")
    out = ["# Analysis report", "", f"- **Files**: {files}", f"- **Issues**: {total}", f"- **Duration**: {ms} ms", "", "| Severity | Issues |", "|---|---|", *[f"| {s} | {n} |" for s, n in counts.items()], ""]
    for file, rows in sorted(by_file.items()):
        out += [f"## {file}", "", "| Line | Severity | Rule | Message |", "|---|---|---|---|", *[f"| {r['line']} | {r['severity']} | {r['rule_id']} | {cell(r['message'])} |" for r in rows], ""]
    return "\n".join(out)


def _html(by_file, counts, total, files, ms, snippets):
    esc = html.escape
    body = [f"<h1>Analysis report</h1><p>{files} files, {total} issues, {ms} ms</p><ul>", *[f"<li class='{s}'>{s}: {n}</li>" for s, n in counts.items()], "</ul>"]
    for file, rows in sorted(by_file.items()):
        body.append(f"<h2>{esc(file)}</h2><table>")
        for r in rows:
            code = f"<pre>{esc(r['code_snippet'])}</pre>" if snippets and r["code_snippet"] else ""
            body.append(f"<tr class='{r['severity']}'><td>{r['line']}</td><td>{r['severity']}</td><td>{esc(r['rule_id'])}</td><td>{esc(r['message'])}{code}</td></tr>")
        body.append("</table>")
    return "<!DOCTYPE html><html><head><meta charset='utf-8'><title>Analysis report</title></head><body>" + "".join(body) + "</body></html>"
