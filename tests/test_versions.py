import pytest

from casework.sources import files, versions

SCHEMA = "k int, v string"


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


def frame(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows(spark, path, version=None):
    return sorted(map(tuple, versions.read(spark, path, SCHEMA, version).collect()))


def test_replace_and_append(spark, path):
    assert (versions.latest(spark, path), rows(spark, path)) == (0, [])
    assert versions.append(frame(spark, (1, "a")), path) == 1
    assert versions.append(frame(spark, (2, "b")), path) == 2
    assert rows(spark, path) == [(1, "a"), (2, "b")] and rows(spark, path, 1) == [(1, "a")]
    assert versions.replace(frame(spark, (1, "z")), path, 2) == 3
    assert rows(spark, path) == [(1, "z")] and rows(spark, path, 2) == [(1, "a"), (2, "b")]


def test_a_break_before_publishing_changes_nothing(spark, path, monkeypatch):
    versions.append(frame(spark, (1, "a")), path)
    reader = versions.read(spark, path, SCHEMA)

    def broken(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versions, "publish", broken)
        with pytest.raises(KeyboardInterrupt):
            versions.replace(frame(spark, (9, "half")), path, 1)
    assert len(files.names(spark, f"{path}/data")) == 2  # written, not published
    assert rows(spark, path) == [(1, "a")] and versions.latest(spark, path) == 1
    versions.replace(frame(spark, (2, "b")), path, 1)
    assert rows(spark, path) == [(2, "b")]
    assert [tuple(r) for r in reader.collect()] == [(1, "a")]  # who had begun to read sees the old version


def test_a_second_writer_fails(spark, path):
    versions.append(frame(spark, (1, "a")), path)
    first, second = (frame(spark, (1, who)) for who in ("first", "second"))
    versions.replace(first, path, 1)
    with pytest.raises(versions.Outdated):
        versions.replace(second, path, 1)
    assert rows(spark, path) == [(1, "first")]


def test_two_writers_at_once(spark, path):
    """Both have seen version 0 as the newest; one file can be made."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(8) as pool:
        done = list(pool.map(lambda i: _tried(spark, path, i), range(8)))
    # On HDFS exactly one; a local file system can't rule out that a rename replaces another one.
    assert sum(done) >= 1 and versions.latest(spark, path) == 1

    with ThreadPoolExecutor(4) as pool:  # appending goes on after others
        list(pool.map(lambda i: versions.append(frame(spark, (i, "x")), path, 100), range(4)))
    assert len(rows(spark, path)) >= 4


def _tried(spark, path, i):
    try:
        versions.publish(spark, path, 0, [])
        return True
    except versions.Outdated:
        return False


def test_cleaning_keeps_recent_versions(spark, path):
    for i in range(4):
        versions.replace(frame(spark, (i, "x")), path, i)
    versions.write(frame(spark, (9, "lost")), path)
    assert len(versions.clean(spark, path, keep=2)) == 3
    assert rows(spark, path) == [(3, "x")] and rows(spark, path, 3) == [(2, "x")]
    assert versions.latest(spark, path) == 4
