import shutil

import pytest
from pyspark.sql import functions as F

from linkweave.operators import increment
from linkweave.plans import python_graph
from linkweave.sources import python_source
from linkweave.streaming import project


def reach(entries, steps, most=None):
    out = set()
    for entry in entries:
        seen, level, depth = {entry}, [entry], 0
        out.add((entry, entry, 0))
        while level and (most is None or depth + 1 < most):
            depth += 1
            level = sorted({b for a, b in steps if a in level} - seen)
            seen.update(level)
            out |= {(entry, x, depth) for x in level}
    return out


OLD = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "f"), ("f", "g"), ("x", "x"), ("x", "y"), ("x", "y")]
CHANGES = {
    "nothing": (OLD, {"a", "d", "x"}),
    "a step comes": ([*OLD, ("f", "h"), ("h", "d")], {"a", "d", "x"}),
    "a step goes": ([s for s in OLD if s != ("b", "c")], {"a", "d", "x"}),
    "an entry comes": (OLD, {"a", "d", "x", "new", "f"}),
    "an entry goes": (OLD, {"d"}),
    "all goes": ([], set()),
}


@pytest.mark.parametrize("most", [None, 1, 3])
@pytest.mark.parametrize("change", list(CHANGES))
def test_kept_closures_equal_a_rebuild(spark, change, most):
    frame = lambda rows, columns: spark.createDataFrame(rows, columns)
    steps, entries = CHANGES[change]
    before, after = frame(OLD, "path string, resolved string"), frame(steps, "path string, resolved string")
    known = increment.closures(frame([("a",), ("d",), ("x",), ("x",)], "path string"), before, most)
    assert {tuple(r) for r in known.collect()} == reach(["a", "d", "x"], OLD, most)
    now = increment.update_closures(known, before, after, frame([(e,) for e in sorted(entries)], "path string"), most)
    rows = [tuple(r) for r in now.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == reach(entries, steps, most)


def test_only_touched_entries_are_made_anew(spark):
    before = spark.createDataFrame(OLD, "path string, resolved string")
    after = spark.createDataFrame([*OLD, ("f", "z")], "path string, resolved string")
    entries = spark.createDataFrame([("a",), ("d",), ("x",), ("new",)], "path string")
    known = increment.closures(entries.filter("path <> 'new'"), before)
    assert {r.path for r in increment.touched_entries(known, before, after, entries).collect()} == {"d", "new"}


def test_changes_of_files(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", None)], "path string, sha string")
    known = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("e", "1")], "path string, sha string")
    assert {tuple(r) for r in increment.file_changes(now, known).collect()} == {("b", "2", "edited"), ("d", None, "added"), ("e", None, "deleted")}
    assert increment.file_changes(now.limit(0), known.limit(0)).count() == 0


def rebuilt(spark, folder):
    files = spark.createDataFrame([(str(p.relative_to(folder)), p.read_text()) for p in sorted(folder.rglob("*.py"))], "path string, content string")
    facts = python_source.extract(files)
    whole = increment.closures(project.usual_entries(files), python_graph.steps_between(facts, files))
    return {tuple(r) for r in whole.collect()}, sorted(map(str, facts.collect()))


def test_versions_equal_a_rebuild_after_adds_edits_and_deletions(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    for path, text in {"one/main.py": "import store\nfrom deep import leaf\n", "one/store.py": "import tables\n", "one/tables.py": "", "one/deep/__init__.py": "", "one/deep/leaf.py": "", "two/app.py": "import other\n", "two/other.py": "def f(): pass\n"}.items():
        (src / path).parent.mkdir(parents=True, exist_ok=True)
        (src / path).write_text(text)

    def check(version):
        assert project.sync(spark, str(src), out) == version
        closures, facts = rebuilt(spark, src)
        got = [tuple(r) for r in project.current_closures(spark, out, version).collect()]
        assert set(got) == closures and len(got) == len(closures)
        assert sorted(map(str, project.current_facts(spark, out, version).select(*[c.split()[0] for c in python_source.FACTS.split(", ")]).collect())) == facts

    check(1)
    assert {r.path for r in project.current_closures(spark, out, 1).filter("entry = 'one/main.py'").collect()} == {"one/main.py", "one/store.py", "one/tables.py", "one/deep/__init__.py", "one/deep/leaf.py"}
    check(1)  # nothing changed: no new version
    (src / "one/store.py").write_text("import late\n")
    (src / "one/late.py").write_text("import main\n")
    check(2)
    versions = {r.entry: r.version for r in spark.read.parquet(f"{out}/state/version=2/entries").collect()}
    assert versions == {"one/main.py": 2, "two/app.py": 1}
    assert {r.path for r in spark.read.parquet(f"{out}/facts/version=2").select("path").distinct().collect()} <= {"one/store.py", "one/late.py"}
    (src / "two/other.py").unlink()
    (src / "two/server.py").write_text("import app\n")
    check(3)
    shutil.rmtree(src / "one")
    check(4)
    # a version that broke off before its commit is written over
    spark.range(1).select(F.lit("stale").alias("entry"), F.lit("x").alias("path"), F.lit(0).alias("depth")).write.parquet(f"{out}/closures/version=5")
    (src / "two/app.py").write_text("")
    check(5)


def test_a_stream_keeps_versions(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/main.py").write_text("import a\n")

    def run():
        project.follow(spark, str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "state"), availableNow=True).awaitTermination()
        version = project.last_version(spark, str(tmp_path / "out"))
        return version, {r.path for r in project.current_closures(spark, str(tmp_path / "out"), version).collect()}

    assert run() == (1, {"main.py"})
    (tmp_path / "src/a.py").write_text("x = 1\n")
    assert run() == (2, {"main.py", "a.py"})
    (tmp_path / "src/main.py").write_text("")
    (tmp_path / "src/b.py").write_text("")
    assert run() == (3, {"main.py"})
