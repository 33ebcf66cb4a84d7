"""Replacing a table: whatever fails, one whole table is left."""

import pytest

from tallyvane.sources import files


class Folder:
    """A file system of names; a rename fails, or raises, at the n-th call."""

    def __init__(self, fails=0, raises=False, **tables):
        self.tables, self.calls, self.fails, self.raises = dict(tables), 0, fails, raises

    def exists(self, name):
        return name in self.tables

    def rename(self, old, new):
        self.calls += 1
        if self.calls == self.fails:
            if self.raises:
                raise RuntimeError("lost")
            return False
        assert new not in self.tables
        self.tables[new] = self.tables.pop(old)
        return True

    def delete(self, name, _):
        self.tables.pop(name, None)


@pytest.mark.parametrize("raises", [False, True])
@pytest.mark.parametrize("fails", [1, 2])
def test_a_failing_rename_keeps_the_old_table(fails, raises):
    folder = Folder(fails, raises, there="old", beside="new")
    with pytest.raises((OSError, RuntimeError)):
        files.swap(folder, "beside", "there", "before")
    assert folder.tables == {"there": "old", "beside": "new"}


def test_swap_replaces(spark, tmp_path):
    folder = Folder(there="old", beside="new")
    files.swap(folder, "beside", "there", "before")
    assert folder.tables == {"there": "new"}
    path = str(tmp_path / "table")
    files.write_atomic(spark.range(3), path)
    files.write_atomic(spark.range(4), path)
    assert spark.read.json(path).count() == 4 and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["table"]
