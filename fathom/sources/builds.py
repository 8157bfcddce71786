"""Module trees of Maven and Gradle builds.  They are small and are read on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Module:
    name: str
    path: str
    build_system: str
    parent: str | None = None
    children: list[str] = field(default_factory=list)


def _tag(element) -> str:
    return element.tag.rpartition("}")[2]


def _pom(path: Path) -> tuple[str | None, list[str]] | None:
    """The name and the listed folders of a build file; None where there is none that can be read."""
    try:
        top = ElementTree.parse(path).getroot()
    except (OSError, ElementTree.ParseError, UnicodeDecodeError):
        return None
    name = next((e.text.strip() for e in top if _tag(e) == "artifactId" and e.text and e.text.strip()), None)
    return name, [m.text.strip() for e in top if _tag(e) == "modules" for m in e.iter() if _tag(m) == "module" and m.text and m.text.strip()]


def maven(root: str) -> dict[str, Module]:
    """Modules by name; a listed folder without a build file that can be read is a child under the name that is listed.

    A build file without a name makes a module called ``root``.  Nothing where the top folder's can't be read.
    """

    def visit(folder: Path, above: frozenset[Path]) -> dict[str, Module] | None:
        if (read := _pom(folder / "pom.xml")) is None or folder.resolve() in above:
            return None
        name, listed = read[0] or "root", read[1]
        top, out = Module(name, str(folder), "maven"), {}
        for child in listed:
            below = folder / child
            if not below.exists():
                continue
            if (found := visit(below, above | {folder.resolve()})) is not None:
                for module in found.values():
                    module.parent = module.parent or name
                out.update(found)
            else:
                top.children.append(child)
                out[child] = Module(child, str(below), "maven", name)
        return out | {name: top}

    return visit(Path(root), frozenset()) or {}


def _quoted(line: str) -> list[str]:
    return [text for _, text in re.findall(r"([\"'])(.*?)\1", line)]


def gradle(root: str) -> dict[str, Module]:
    """Modules by name: the included folders that there are, below the module that their path names before them."""
    folder = Path(root)
    settings = next((folder / n for n in ("settings.gradle", "settings.gradle.kts") if (folder / n).is_file()), None)
    if settings is None:
        return {folder.name: Module(folder.name, str(folder), "gradle")}
    rows = [line.strip() for line in settings.read_text().splitlines()]
    names = [found[0] for line in rows if line.startswith("rootProject.name") and (found := _quoted(line))]
    top, out = Module(names[0] if names else folder.name, str(folder), "gradle"), {}
    for listed in (text for line in rows if line.startswith("include") for text in _quoted(line) if text):
        parts = listed.lstrip(":").split(":")
        below = folder.joinpath(*parts)
        if not below.exists():
            continue
        if len(parts) == 1:
            top.children.append(parts[0])
        out[parts[-1]] = Module(parts[-1], str(below), "gradle", parts[-2] if len(parts) > 1 else top.name)
    return out | {top.name: top}


def detect(root: str) -> dict[str, Module]:
    """Maven before Gradle; nothing for other folders."""
    folder = Path(root)
    if found := maven(root):
        return found
    if any((folder / n).is_file() for n in ("settings.gradle", "settings.gradle.kts", "build.gradle", "build.gradle.kts")):
        return gradle(root)
    return {}


def modules_table(spark: SparkSession, modules: dict[str, Module]) -> DataFrame:
    rows = [(m.name, m.path, m.build_system, m.parent, m.children) for m in modules.values()]
    return spark.createDataFrame(rows, "name string, path string, build_system string, parent string, children array<string>")
