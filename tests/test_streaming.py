from linkweave.sources import python_source
from linkweave.streaming import changes


def run(spark, tmp_path):
    query = changes.watch(spark, str(tmp_path / "src"), "*.py", python_source.extract, str(tmp_path / "out"), str(tmp_path / "state"), availableNow=True)
    query.awaitTermination()
    return {(r.path.rsplit("/", 1)[-1], r.name) for r in spark.read.parquet(str(tmp_path / "out/facts")).filter("fact = 'function'").collect()}


def test_only_new_and_changed_files_are_read(spark, tmp_path):
    (tmp_path / "src/deep").mkdir(parents=True)
    (tmp_path / "src/a.py").write_text("def one(): pass\n")
    (tmp_path / "src/deep/b.py").write_text("def two(): pass\n")
    (tmp_path / "src/c.txt").write_text("def no(): pass\n")
    assert run(spark, tmp_path) == {("a.py", "one"), ("b.py", "two")}
    (tmp_path / "src/d.py").write_text("def three(): pass\n")
    assert run(spark, tmp_path) == {("a.py", "one"), ("b.py", "two"), ("d.py", "three")}
    known = spark.read.parquet(str(tmp_path / "out/known"))
    assert known.count() == 3 and known.select("batch").distinct().count() == 2


def test_a_known_hash_is_no_change(spark):
    batch = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "new"), ("c", None)], "path string, content string")
    known = batch.selectExpr("path", "sha2(cast(if(path = 'b', 'old', content) as binary), 256) AS sha", "0L AS batch")
    assert {r.path for r in changes.changed_files(batch, known, 1).collect()} == {"b", "c"}
    assert {r.path for r in changes.changed_files(batch, known, 0).collect()} == {"a", "b", "c"}
