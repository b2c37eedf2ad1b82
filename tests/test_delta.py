"""The buffer of changes of a table of codes: versions, crashes, flushes, backups."""

import pytest

from gridquarry.operators.delta import CODES, DeltaError, DeltaIndex


def codes(spark, **named):
    return spark.createDataFrame([(int(k[1:]), [v]) for k, v in named.items()], CODES)


def live(index):
    return {r["id"]: r["v"][0] for r in index.live().collect()}


def test_round_trip(spark, tmp_path):
    """create, insert, size, backup, another table, restore."""
    index = DeltaIndex.create(codes(spark, i1=1, i2=2), str(tmp_path / "a"), 100)
    assert index.size() == 0 and not index.needs_flush()
    index.insert(codes(spark, i42=7))
    assert index.size() == 1
    index.delete(codes(spark, i2=0))
    index.insert(codes(spark, i1=5))
    index.insert(codes(spark, i1=6))
    index.backup(str(tmp_path / "backup"))
    assert live(index) == {1: 6, 42: 7} and index.size() == 2
    other = DeltaIndex.create(codes(spark, i1=1, i2=2, i3=3), str(tmp_path / "b"), 100)
    other.insert(codes(spark, i9=9))
    other.restore(str(tmp_path / "backup"))
    assert other.size() == 2 and live(other) == {1: 6, 3: 3, 42: 7}
    assert live(DeltaIndex(spark, str(tmp_path / "b"))) == live(other) and live(other.at(1)) == {1: 1, 2: 2, 3: 3, 9: 9}
    index.delete(codes(spark, i42=0))
    assert index.size() == 1


def test_crash_before_the_manifest(spark, tmp_path, monkeypatch):
    """Tables without a manifest do not count: the version before stands, and the change can be made again."""
    path = str(tmp_path / "a")
    index = DeltaIndex.create(codes(spark, i1=1), path, 3)
    index.insert(codes(spark, i2=2))

    def lost(self, manifest):
        raise OSError("lost")

    for change in (lambda x: x.insert(codes(spark, i3=3)), lambda x: x.flush(), lambda x: x.delete(codes(spark, i1=0))):
        with monkeypatch.context() as m:
            m.setattr(DeltaIndex, "_commit", lost)
            with pytest.raises(OSError, match="lost"):
                change(DeltaIndex(spark, path))
        again = DeltaIndex(spark, path)
        assert (again.version, live(again), again.size()) == (1, {1: 1, 2: 2}, 1)
    again.insert(codes(spark, i3=3))
    assert live(DeltaIndex(spark, path)) == {1: 1, 2: 2, 3: 3}


def test_flush_at_capacity_and_second_writer(spark, tmp_path):
    path = str(tmp_path / "a")
    index = DeltaIndex.create(codes(spark, i1=1), path, 3)
    index.insert(codes(spark, i2=2))
    late = DeltaIndex(spark, path)
    index.insert(codes(spark, i3=3, i1=9))
    assert index.size() == 0 and {r["id"]: r["v"][0] for r in index.main().collect()} == {1: 9, 2: 2, 3: 3}
    with pytest.raises(DeltaError, match="another writer"):
        late.insert(codes(spark, i4=4))
    assert live(DeltaIndex(spark, path)) == {1: 9, 2: 2, 3: 3}
    with pytest.raises(DeltaError, match="no table"):
        DeltaIndex(spark, str(tmp_path / "none"))
    found = index.search(spark.createDataFrame([(0, [8])], "query long, v array<long>"), 2).collect()
    assert [(r["id"], r["distance"]) for r in found] == [(1, 1), (2, 2)]
