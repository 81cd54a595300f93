import os

import pytest

from linkweave.sources import folder


def read(spark, path, pattern):
    return {r.path.removeprefix(f"file://{path}/"): r.content for r in folder.read_folder(spark, str(path), pattern).collect()}


def test_every_name_and_empty_files_are_read(spark, tmp_path):
    for name, text in {"a.py": "x\r\ny", "pkg/__init__.py": "", "pkg/_private/deep/b.py": "é", "pkg/c.txt": "no", ".git/d.py": "no", ".hidden.py": "no", "with space/e%20.py": "e"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    os.symlink(tmp_path / "pkg", tmp_path / "again")
    assert read(spark, tmp_path, "*.py") == {"a.py": "x\r\ny", "pkg/__init__.py": "", "pkg/_private/deep/b.py": "é", "with space/e%20.py": "e", "bad.py": "��"}
    assert read(spark, tmp_path, "*.{txt,md}") == {"pkg/c.txt": "no"}
    with pytest.raises(Exception, match="no folder"):
        folder.read_folder(spark, str(tmp_path / "none"), "*").collect()


def test_a_wide_tree_is_divided_and_each_file_read_once(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"d{k}/e/f").mkdir(parents=True)
        (tmp_path / f"d{k}/e/f/x.ts").write_text(str(k))
        (tmp_path / f"d{k}/y.tsx").write_text(str(k))
    df = folder.read_folder(spark, f"file://{tmp_path}", "*.{ts,tsx}")
    rows = df.collect()
    assert len(rows) == 600 and len({r.path for r in rows}) == 600
    parts = folder.FolderReader(str(tmp_path), "*").partitions()
    assert len(parts) == folder.TASKS and any(deep for p in parts for _, deep in p.folders)


def test_an_empty_folder_gives_no_rows(spark, tmp_path):
    assert folder.read_folder(spark, str(tmp_path), "*").count() == 0
    assert folder.local_path("hdfs://x/y") is None and folder.alternatives("*.{a,b}{1,2}") == ["*.a1", "*.a2", "*.b1", "*.b2"]
