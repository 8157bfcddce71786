"""The stream of a folder's changes: what its log tells again after a restart, and a query that is stopped in the middle."""

import os
import time

import pytest

from fathom.streaming import changes
from fathom.streaming.changes import FolderReader


def put(folder, **texts):
    folder.mkdir(exist_ok=True)
    for name, text in texts.items():
        target = folder / f"{name}.java"
        target.write_text(text)
        os.utime(target, ns=(time.time_ns(), time.time_ns()))


def reader(tmp_path, **options):
    return FolderReader({"path": str(tmp_path / "src"), "state": str(tmp_path / "log"), **options})


def told(source, start, end):
    return sorted(os.path.basename(path) for part in source.partitions(start, end) for path, _ in source.read(part))


def test_log(tmp_path, monkeypatch):
    put(tmp_path / "src", A="1", B="1")
    (tmp_path / "src" / "target").mkdir()
    put(tmp_path / "src" / "target", X="1")
    (tmp_path / "src" / "note.txt").write_text("no source")
    one = reader(tmp_path)
    zero, first = one.initialOffset(), one.latestOffset()
    assert told(one, zero, first) == ["A.java", "B.java"] and one.latestOffset() == first
    put(tmp_path / "src", A="22")
    second = one.latestOffset()
    assert told(one, first, second) == ["A.java"]
    # a new reader tells the same of what wasn't committed, and what changed while there was none
    put(tmp_path / "src", B="22", C="1")
    os.remove(tmp_path / "src" / "A.java")
    again = reader(tmp_path)
    third = again.latestOffset()
    assert told(again, zero, second) == ["A.java", "A.java", "B.java"] and told(again, second, third) == ["B.java", "C.java"]
    again.commit(second)
    assert again._names("entry") == [third["entry"]] and again._names("snapshot")[-1] == third["entry"]
    assert told(reader(tmp_path), second, third) == ["B.java", "C.java"]
    again.commit(third)
    assert reader(tmp_path).latestOffset() == third
    # a file that is back is new
    put(tmp_path / "src", A="22")
    back = reader(tmp_path)
    assert told(back, third, back.latestOffset()) == ["A.java"]
    monkeypatch.setattr(changes, "PIECE_ROWS", 2)
    put(tmp_path / "src", **{f"N{n}": "1" for n in range(5)})
    before = {"entry": back.entry}
    after = back.latestOffset()
    assert len(back.partitions(before, after)) == 3 and len(told(back, before, after)) == 5


def test_an_entry_that_was_not_told_is_written_again(tmp_path):
    put(tmp_path / "src", A="1")
    one = reader(tmp_path)
    first = one.latestOffset()
    put(tmp_path / "src", A="22")
    one.latestOffset()
    os.remove(tmp_path / "log" / "snapshot" / "2")  # as if it had ended before the snapshot was there
    put(tmp_path / "src", B="1")
    again = reader(tmp_path)
    assert told(again, first, again.latestOffset()) == ["A.java", "B.java"]


def test_only_later_changes(tmp_path):
    put(tmp_path / "src", A="1")
    one = reader(tmp_path, initial="false")
    assert one.latestOffset() == one.initialOffset()
    put(tmp_path / "src", A="22")
    assert told(one, one.initialOffset(), one.latestOffset()) == ["A.java"]


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_restart_loses_and_repeats_nothing(spark, tmp_path, few_partitions):
    src, out, state = tmp_path / "src", tmp_path / "out", tmp_path / "state"
    read = lambda paths: spark.read.text([r.path for r in paths.collect()], wholetext=True).selectExpr("_metadata.file_name as path", "value as src") if not paths.isEmpty() else paths.selectExpr("path", "'' as src").where("false")

    def start():
        return changes.watch(spark, str(src), read, lambda files: files, str(out), str(state), quiet=0.2, every="200 milliseconds")

    def seen():
        done = [str(mark.parent) for mark in out.glob("batch=*/_SUCCESS")]
        return sorted((r.path, r.src) for r in spark.read.parquet(*done).collect()) if done else []

    def until(query, want):
        for _ in range(240):
            if query.exception():
                raise query.exception()
            if seen() == sorted(want):
                return
            time.sleep(0.25)
        raise AssertionError(f"{seen()} isn't {want}")

    put(src, A="1", B="1")
    query = start()
    want = [("A.java", "1"), ("B.java", "1")]
    try:
        until(query, want)
        put(src, A="22")
        want += [("A.java", "22")]
        until(query, want)
    finally:
        query.stop()
    put(src, B="333", C="1")  # while nothing looks
    query = start()
    try:
        want += [("B.java", "333"), ("C.java", "1")]
        until(query, want)
        time.sleep(2)
        assert seen() == sorted(want)
    finally:
        query.stop()
