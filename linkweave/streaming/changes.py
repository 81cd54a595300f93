"""A stream of source files: only files whose content hash isn't known yet for their path are read for facts.

Every batch is compared with the table of known hashes by an anti join; its facts and hashes are then appended under the batch's number, so
a batch that is run again after a failure replaces what it had written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_KNOWN = "path string, sha string, batch long"


def changed_files(batch: DataFrame, known: DataFrame, number: int) -> DataFrame:
    """(path, content, sha) of a batch's files that are new or differ from the last hash known for their path, from batches before this one.

    A path that comes twice in a batch counts with its greatest hash once."""
    hashed = batch.select("path", "content", F.sha2(F.col("content").cast("binary"), 256).alias("sha")).dropDuplicates(["path", "sha"])
    last = known.filter(F.col("batch") < number).groupBy("path").agg(F.max_by("sha", "batch").alias("sha"))
    return hashed.join(last, ["path", "sha"], "left_anti")


def watch(spark: SparkSession, folder: str, pattern: str, extract: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Facts of new and changed files below ``folder`` go to ``out/facts``, their hashes to ``out/known``; ``extract`` makes facts of (path, content)."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))

    def each(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        try:
            known = session.read.schema(_KNOWN).parquet(f"{out}/known")
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            known = session.createDataFrame([], _KNOWN)
        new = changed_files(batch, known, number).persist()
        extract(new).write.mode("overwrite").parquet(f"{out}/facts/batch={number}")
        new.select("path", "sha").write.mode("overwrite").parquet(f"{out}/known/batch={number}")
        new.unpersist()

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()
