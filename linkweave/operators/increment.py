"""Import closures of many entry points, and their upkeep when files come, change or go.

A closure can only change where a step leaves one of its files that wasn't there before, or is there no more.  So the steps before and after are
compared, the closures that hold the start of such a step are worked out anew, and all others stay."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.session import materialize, table


def file_changes(files: DataFrame, known: DataFrame) -> DataFrame:
    """(path, sha, change) of the files that are new, edited or deleted against what is known; both have path and sha, a path once.

    A deleted file has no hash.  A hash that is null differs from every other."""
    now, before = files.select("path", "sha", F.lit(1).alias("now")), known.select("path", F.col("sha").alias("was"), F.lit(1).alias("before"))
    change = F.when(F.col("now").isNull(), "deleted").when(F.col("before").isNull(), "added").when(~F.col("sha").eqNullSafe(F.col("was")), "edited")
    return now.join(before, "path", "full").select("path", "sha", change.alias("change")).filter("change is not null")


def closures(entries: DataFrame, steps: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(entry, path, depth): every file that an entry point (path) reaches over steps (path, resolved), the entry with depth 0; all entries move together.

    ``max_depth`` bounds the files on a way."""
    links = materialize(steps.select("path", "resolved").distinct(), "links").hint("merge")  # a broadcast would bring the steps to the driver at each level
    frontier = materialize(entries.select(F.col("path").alias("entry"), "path", F.lit(0).alias("depth")).distinct(), "closure")
    seen, depth = frontier, 0
    while not frontier.isEmpty() and (max_depth is None or depth + 1 < max_depth):
        depth += 1
        new = frontier.join(links, "path").select("entry", F.col("resolved").alias("path")).distinct().join(seen.hint("merge"), ["entry", "path"], "left_anti")
        frontier = materialize(new.select("entry", "path", F.lit(depth).alias("depth")), "closure")
        seen = seen.unionByName(frontier)
    return seen


def touched_entries(known: DataFrame, before: DataFrame, after: DataFrame, entries: DataFrame) -> DataFrame:
    """Entry points (path) whose closure has to be made anew: they have none yet, or it holds a file that steps were added to or taken from."""
    old, new = before.select("path", "resolved").distinct(), after.select("path", "resolved").distinct()
    moved = old.join(new, ["path", "resolved"], "left_anti").unionByName(new.join(old, ["path", "resolved"], "left_anti")).select("path").distinct()
    hit = known.join(moved, "path", "left_semi").select(F.col("entry").alias("path")).distinct()
    wanted = entries.select("path").distinct()
    fresh = wanted.join(known.filter("depth = 0").select("path"), "path", "left_anti")
    return wanted.join(hit, "path", "left_semi").unionByName(fresh)


def update_closures(known: DataFrame, before: DataFrame, after: DataFrame, entries: DataFrame, max_depth: int | None = None) -> DataFrame:
    """The closures of ``entries`` over the steps ``after``, from those known over the steps ``before``; entries that are gone lose theirs."""
    again = materialize(touched_entries(known, before, after, entries), "touched")
    kept = known.join(entries.select(F.col("path").alias("entry")).distinct(), "entry", "left_semi").join(again.select(F.col("path").alias("entry")), "entry", "left_anti")
    return kept.unionByName(closures(again, after, max_depth))


#: A project of a module for each customer, as SQL that Spark and the oracle share: steps before and after files were deleted, edited and added.
_BEFORE = """SELECT 'm' || c_custkey AS path, 'm' || CAST(floor(c_custkey / 2) AS BIGINT) AS resolved FROM {customer} WHERE c_custkey % 3 <> 0
 UNION SELECT 'm' || c_custkey, 'm' || ((c_custkey * 7 + 3) % 97) FROM {customer} WHERE c_custkey % 4 = 0"""
_FILES = "SELECT 'm' || c_custkey AS path FROM {customer} WHERE c_custkey % 37 <> 5 UNION ALL SELECT 'n' || s_suppkey FROM {supplier}"
_AFTER = f"""SELECT s.path, s.resolved FROM (SELECT path, resolved FROM ({_BEFORE}) WHERE CAST(substr(path, 2) AS BIGINT) % 11 <> 3
 UNION SELECT 'm' || c_custkey, 'm' || (c_custkey + 1) FROM {{customer}} WHERE c_custkey % 11 = 3 UNION SELECT 'm' || c_custkey, 'n' || (c_custkey % 10) FROM {{customer}} WHERE c_custkey % 50 = 7
 UNION SELECT 'n' || s_suppkey, 'm' || (s_suppkey * 3) FROM {{supplier}}) s JOIN ({_FILES}) a ON a.path = s.path JOIN ({_FILES}) b ON b.path = s.resolved"""
_ENTRIES = "SELECT path FROM ({}) WHERE path LIKE 'n%' OR CAST(substr(path, 2) AS BIGINT) % 5 = 0"
_DEPTH = 8


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", sql))})


def update_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closures kept up over a change of the project."""
    before, after = materialize(_run(spark, sf_dir, _BEFORE), "steps"), materialize(_run(spark, sf_dir, _AFTER), "steps")
    first = materialize(closures(_run(spark, sf_dir, "SELECT 'm' || c_custkey AS path FROM {customer} WHERE c_custkey % 5 = 0"), before, _DEPTH), "closures")
    return update_closures(first, before, after, _run(spark, sf_dir, _ENTRIES.format(_FILES)), _DEPTH)


QUERIES = {"import_closures_after_changes": update_query}
ORACLE_SQL = {
    "import_closures_after_changes": re.sub(r"\{(\w+)\}", r"\1", f"WITH RECURSIVE s AS ({_AFTER}), r AS (SELECT path AS entry, path, 0 AS depth FROM ({_ENTRIES.format(_FILES)}) UNION SELECT entry, resolved, depth + 1 FROM r JOIN s ON s.path = r.path WHERE depth + 1 < {_DEPTH})")
    + " SELECT entry, path, min(depth) AS depth FROM r GROUP BY 1, 2"
}
