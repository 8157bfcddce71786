"""What a scan opens: excluded and over-long files aren't read, and odd names are matched as they are spelled."""

import pytest

from fathom.plans.analysis import Config, all_issues
from fathom.sources import files


@pytest.fixture
def limit(spark):
    spark.conf.set(files.LONGEST, "100")
    yield
    spark.conf.unset(files.LONGEST)


def write(root, **texts):
    for name, text in texts.items():
        target = root / name.replace("__", "/")
        target = target.with_name(target.name + ".java")
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_excluded_files_are_not_opened(spark, tmp_path, limit):
    write(tmp_path, src__A="class A {}", target__Huge="x" * 5000)
    assert {(r.path, r.src) for r in files.scan(spark, str(tmp_path)).collect()} == {(f"{tmp_path}/src/A.java", "class A {}")}


def test_long_files_count_and_have_no_issues(spark, tmp_path, limit):
    write(tmp_path, src__A="// TODO: later\n", src__Long="// TODO: later\n" * 500, src__Bytes=b"\xff\xfe TODO")
    found = files.scan(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.src for r in found.collect()} == {"A.java": "// TODO: later\n", "Long.java": None, "Bytes.java": None}
    assert files.files_analysed(found) == 3
    hit = {r.file.rsplit("/", 1)[1] for r in all_issues(found, Config(enabled_rules=("S1135",))).collect()}
    assert hit == {"A.java"}
    one = files.scan_one(spark, str(tmp_path / "src" / "Long.java")).collect()
    assert [r.src for r in one] == [None]


def test_names_are_compared_as_spelled(spark, tmp_path):
    write(tmp_path, **{"a b__A": "1", "a+b__B": "2", "a%20b__C": "3", "größe__D": "4"})
    names = lambda *exclude: sorted(r.src for r in files.scan(spark, str(tmp_path), exclude).collect())
    assert names() == ["1", "2", "3", "4"]
    assert names("a b/") == ["2", "3", "4"]
    assert names("a+b/") == ["1", "3", "4"]
    assert names("a%20b/") == ["1", "2", "4"]
    assert names("größe/", "a b") == ["2", "3"]
    assert sorted(r.size for r in files.listing(spark, str(tmp_path), ("größe",)).collect()) == [1, 1, 1]

