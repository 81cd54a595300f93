"""A project's facts and import closures, kept up with its folder by versions.

Below ``out`` a version writes only what it adds: facts of new and edited files (``facts/version=n``) and closures of the entry points that they touch
(``closures/version=n``).  Two small tables of each version (``state/version=n``) tell in which version a file's facts and an entry's closure stand, so
a deleted file is one that they name no more.  A version counts once its number is in ``commits``; one that broke off is written over."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkweave.operators import increment
from linkweave.plans import python_graph
from linkweave.session import materialize
from linkweave.sources import python_source, spec

_FILES, _ENTRIES, _STEPS, _CLOSURES = "path string, sha string, version int", "entry string, version int", "path string, resolved string", "entry string, path string, depth int, version int"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, empty if it isn't there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def last_version(spark: SparkSession, out: str) -> int:
    """The newest version that is whole; 0 if there is none."""
    return _read(spark, f"{out}/commits", "version int").agg(F.max("version")).first()[0] or 0


def current_facts(spark: SparkSession, out: str, version: int, files: DataFrame | None = None) -> DataFrame:
    files = _read(spark, f"{out}/state/version={version}/files", _FILES) if files is None else files
    every = _read(spark, f"{out}/facts", python_source.FACTS + ", version int")
    return every.join(files.select("path", "version"), ["path", "version"], "left_semi").drop("version")


def current_closures(spark: SparkSession, out: str, version: int) -> DataFrame:
    entries = _read(spark, f"{out}/state/version={version}/entries", _ENTRIES)
    return _read(spark, f"{out}/closures", _CLOSURES).join(entries, ["entry", "version"], "left_semi").drop("version")


def usual_entries(files: DataFrame) -> DataFrame:
    """Files with the name of an entry point, in any folder."""
    return files.filter(F.element_at(F.split("path", "/"), -1).isin(*python_graph.ENTRY_POINTS)).select("path")


def sync(spark: SparkSession, folder: str, out: str, entries: Callable[[DataFrame], DataFrame] = usual_entries, max_depth: int | None = None, pattern: str = "*.py") -> int:
    """Bring the tables below ``out`` up to the files below ``folder``; the version that holds them, a new one only if a file came, changed or went."""
    last = last_version(spark, out)
    number = last + 1
    known = _read(spark, f"{out}/state/version={last}/files", _FILES)
    before = _read(spark, f"{out}/state/version={last}/steps", _STEPS)
    plain = "/" + folder.split("://", 1)[-1].strip("/") + "/"
    listed = spec.read_sources(spark, folder, pattern).withColumn("path", F.substring_index("path", plain, -1))
    hashed = materialize(listed.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha")), "listed")
    changes = materialize(increment.file_changes(hashed, known), "changes")
    if changes.isEmpty():
        return last
    fresh = changes.filter("change <> 'deleted'").select("path")
    python_source.extract(listed.join(fresh, "path", "left_semi")).write.mode("overwrite").parquet(f"{out}/facts/version={number}")
    state = f"{out}/state/version={number}"
    same = known.join(changes.select("path"), "path", "left_anti")
    same.unionByName(changes.filter("change <> 'deleted'").select("path", "sha", F.lit(number).alias("version"))).write.mode("overwrite").parquet(f"{state}/files")
    files = _read(spark, f"{state}/files", _FILES)
    python_graph.steps_between(current_facts(spark, out, number, files), files).write.mode("overwrite").parquet(f"{state}/steps")
    after = _read(spark, f"{state}/steps", _STEPS)
    wanted = entries(files)
    again = materialize(increment.touched_entries(current_closures(spark, out, last), before, after, wanted), "touched")
    increment.closures(again, after, max_depth).write.mode("overwrite").parquet(f"{out}/closures/version={number}")
    kept = _read(spark, f"{out}/state/version={last}/entries", _ENTRIES).join(wanted.select(F.col("path").alias("entry")), "entry", "left_semi").join(again.select(F.col("path").alias("entry")), "entry", "left_anti")
    kept.unionByName(again.select(F.col("path").alias("entry"), F.lit(number).alias("version"))).write.mode("overwrite").parquet(f"{state}/entries")
    spark.range(1).select(F.lit(number).alias("version")).write.mode("append").parquet(f"{out}/commits")
    return number


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, pattern: str = "*.py", **trigger: object) -> StreamingQuery:
    """A stream that syncs whenever files arrive; edits and deletions since the last batch are taken in with it."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.writeStream.foreachBatch(lambda batch, number: sync(batch.sparkSession, folder, out, pattern=pattern)).option("checkpointLocation", checkpoint).trigger(**trigger).start()
