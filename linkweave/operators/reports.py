"""Report aggregations and their text forms."""

from __future__ import annotations

import datetime
import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions import names
from linkweave.operators import contracts, graph
from linkweave.operators.linking import first_by
from linkweave.plans.fixtures import ctes, grown, literal
from linkweave.session import table


def schemas_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct schemas in use by contracts, counted by type."""
    used = contracts.contracts_of(spark, sf_dir).select(F.explode(F.array("from_no", "to_no")).alias("schema_no")).distinct()
    return used.join(literal(spark, "schemas"), "schema_no").groupBy("schema_type").agg(F.count_distinct("name").alias("schemas"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


def distinct_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First use of each part name and size, in the order of order and line."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    used = lines.groupBy("l_partkey").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("first"))
    joined = used.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("p_name", "p_size").agg(F.min("first").alias("first")).select("p_name", "p_size", "first.l_orderkey", "first.l_linenumber")


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct messages with their first severity, in four groups."""
    low = F.lower("message")
    group = F.when(low.contains("type mismatch"), "types").when(low.contains("missing required field"), "fields").when(low.contains("schema validation"), "schemas").otherwise("other")
    return first_by(grown(spark, sf_dir, "recommendations"), "message", ["ord"]).select("message", "severity", group.alias("bucket"))


def path_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chain's path as text: bold names and kinds, joined by arrows, in the order of the path."""
    on = graph._walks(spark, sf_dir).select("start", F.posexplode("path").alias("pos", "node_id")).join(graph.star_nodes(spark, sf_dir).select("node_id", "name", "kind"), "node_id")
    one = F.struct("pos", F.format_string("**%s** (%s)", F.coalesce(F.nullif("name", F.lit("")), F.col("node_id").cast("string")), "kind").alias("t"))
    return on.groupBy("start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), " → ").alias("description"))


def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts by severity and by the status of the order they belong to, with totals of both."""
    c = contracts.severities(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chain_id"), "o_orderstatus"), "chain_id")
    return c.cube("severity", "o_orderstatus").agg(F.count("*").alias("contracts"), F.sum("n_mismatches").alias("mismatches"))


def endpoint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last page of each host and path: later rows replace earlier ones."""
    u = F.regexp_replace("url", r"[?#].*$", "")
    pages = table(spark, sf_dir, "pages").select("page_id", u.alias("address"))
    return pages.groupBy("address").agg(F.max("page_id").alias("page_id"), F.count("*").alias("pages"))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, line) of the drawing: nodes first, then edges; data flow is dashed."""
    node = nodes.select(F.lit(0).alias("part"), F.col("node_id").alias("k"), F.concat(F.lit('  n'), F.col("node_id").cast("string"), F.lit(' [label="'), names.dot_escape(F.concat_ws(" ", "kind", "name")), F.lit('"];')).alias("line"))
    style = F.when(F.col("kind") == "DataFlow", " [style=dashed, color=purple]").otherwise("")
    edge = edges.select(F.lit(1).alias("part"), F.col("edge_id").alias("k"), F.concat(F.lit("  n"), F.col("src").cast("string"), F.lit(" -> n"), F.col("dst").cast("string"), style, F.lit(";")).alias("line"))
    return node.unionByName(edge)


def dot_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawing of the whole graph: every node and every edge."""
    return dot_lines(graph.star_nodes(spark, sf_dir), graph.star_edges(spark, sf_dir)).select("part", "k", "line")


#: How kinds of schemas are called in reports (fixed values).
TYPE_LABELS = {"Pydantic": "Pydantic Model", "Zod": "Zod Schema", "TypeScript": "TypeScript Type", "OpenAPI": "OpenAPI Schema", "JsonSchema": "JSON Schema", "OrmModel": "ORM Model"}


def type_label(schema_type: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in TYPE_LABELS.items() for x in kv)), schema_type), schema_type)


def type_display(base_type: Column, optional: Column, schema: Column) -> Column:
    """string? (Name)"""
    return F.concat(F.lower(base_type), F.when(optional, "?").otherwise(""), F.when(schema.isNotNull(), F.concat(F.lit(" ("), schema, F.lit(")"))).otherwise(""))


def schema_block(name: Column, schema_type: Column, file: Column, line: Column, metadata: Column) -> Column:
    """What the readable report says of a schema: name, type, place, and what its metadata (map of texts) hold."""
    line_of = lambda label, value: F.concat(F.lit(f"- **{label}**: `"), value, F.lit("`\n"))
    key = lambda k: F.try_element_at(metadata, F.lit(k))
    place = F.concat_ws(":", file, line.cast("string"))
    stem = F.element_at(F.split(F.element_at(F.split(file, "/"), -1), r"\."), -1)
    sample = F.concat(
        F.lit("- **Recommendation**: Create a Pydantic model to replace `dict[str, Any]` or `any` type.\n  Example:\n  ```python\n  from pydantic import BaseModel\n  \n  class "), stem, F.lit("Model(BaseModel):\n      # Add fields here\n      pass\n  ```\n")
    )
    missing = F.concat(F.lit("- **Status**: ⚠️ **WARNING** - "), F.coalesce(key("reason"), F.lit("Schema validation missing")), F.lit("\n"), F.when(name == "Object", sample).otherwise(""))
    fields = F.filter(F.transform(F.split(key("fields"), ","), lambda x: F.trim(x)), lambda x: x != "")
    others = F.array_sort(F.filter(F.map_keys(metadata), lambda k: ~k.isin("json_schema", "fields", "missing_schema")))
    listed = F.concat(F.lit("- **Fields**:\n"), F.array_join(F.transform(fields, lambda x: F.concat(F.lit("  - `"), x, F.lit("`\n"))), ""))
    more = F.concat(F.lit("- **Additional Metadata**:\n"), F.array_join(F.transform(others, lambda k: F.concat(F.lit("  - `"), k, F.lit("`: `"), names.truncate(F.element_at(metadata, k), 100), F.lit("`\n"))), ""))
    known = F.concat(F.when(key("json_schema").isNotNull(), line_of("Schema Preview", names.truncate(key("json_schema"), 200))).otherwise(""), F.when(key("fields").isNotNull(), listed).otherwise(""), F.when(F.size(others) > 0, more).otherwise(""))
    status = F.when(key("missing_schema").isNotNull(), missing).when(F.size(metadata) == 0, "- **Status**: Schema definition not found\n").otherwise(known)
    plain = (name == "Object") & key("json_schema").isNull()
    note = F.concat(F.lit("- **Note**: This is a generic Object type without detailed schema definition.\n"), F.when(line > 0, F.concat(F.lit("  Consider defining a Pydantic model at `"), place, F.lit("` to provide type safety.\n"))).otherwise(""))
    generic = F.when((name == "Object") | (schema_type == "JsonSchema"), F.concat(F.when(key("base_type").isNotNull(), line_of("Base Type", key("base_type"))).otherwise(""), F.when(plain, note).otherwise(""))).otherwise("")
    return F.concat(line_of("Name", name), F.lit("- **Type**: "), type_label(schema_type), F.lit("\n"), line_of("Location", place), status, generic)


def junctions(links: DataFrame, found: DataFrame) -> DataFrame:
    """Contracts with the links on both sides, numbered from 1 in each chain; a contract whose link isn't there is an error."""
    end = lambda side, shift: links.select("chain_id", (F.col("pos") - shift).alias("pos"), F.coalesce(F.nullif("schema", F.lit("")), "id").alias(f"{side}_name"), F.col("file").alias(f"{side}_file"), F.col("line").alias(f"{side}_line"))
    joined = found.join(end("from", 0), ["chain_id", "pos"], "left").join(end("to", 1), ["chain_id", "pos"], "left")
    if not joined.filter("from_name is null or to_name is null").isEmpty():
        raise ValueError("a contract names a link that isn't there")
    return joined.withColumn("junction", F.col("pos") + 1)


def api_endpoints(links: DataFrame) -> DataFrame:
    """Number of chains that show a model or a schema whose name speaks of a route."""
    hit = links.filter((F.col("schema_type") == "Pydantic") | F.lower("schema").contains("route"))
    return hit.agg(F.count_distinct("chain_id").alias("endpoints"))


def chain_summary(links: DataFrame, found: DataFrame) -> DataFrame:
    """One row: chains, critical and warning contracts, chains with critical ones, with warnings only, valid ones and their share in percent, endpoints."""
    chains = links.select("chain_id").distinct()
    rank = F.when(F.col("severity") == "Critical", 2).when(F.col("severity") == "Warning", 1).otherwise(0)
    worst = chains.join(found.groupBy("chain_id").agg(F.max(rank).alias("worst")), "chain_id", "left").agg(
        F.count("*").alias("chains"), F.count_if(F.col("worst") == 2).alias("critical_chains"), F.count_if(F.col("worst") == 1).alias("warning_chains"), F.count_if(F.coalesce("worst", F.lit(0)) == 0).alias("valid")
    )
    of = found.agg(F.count_if(F.col("severity") == "Critical").alias("critical"), F.count_if(F.col("severity") == "Warning").alias("warnings"))
    one = lambda df: df.withColumn("one", F.lit(1))
    both = one(worst).join(one(of), "one").join(one(api_endpoints(links)), "one").drop("one")
    return both.withColumn("coverage", F.round(F.coalesce(F.try_divide(F.col("valid") * 100.0, "chains"), F.lit(0.0)), 1))


def chain_lines(links: DataFrame, found: DataFrame, mismatches: DataFrame) -> DataFrame:
    """(chain_id, name, text) of the readable report: a chain's path, then its junctions with what is wrong there."""
    one = F.struct("pos", F.format_string("**%s** (%s)", F.coalesce(F.nullif("schema", F.lit("")), "id"), type_label(F.col("schema_type"))).alias("t"))
    paths = links.groupBy("chain_id", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), " → ").alias("path"))
    said = mismatches.groupBy("chain_id", "pos").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("  - "), "level", F.lit(": "), "message"))), "\n").alias("said"))
    each = junctions(links, found).join(said, ["chain_id", "pos"], "left")
    line = F.concat_ws("\n", F.format_string("- junction %d: %s (%s:%d) → %s (%s:%d): %s", "junction", "from_name", "from_file", "from_line", "to_name", "to_file", "to_line", "severity"), "said")
    text = each.groupBy("chain_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("t")))), lambda x: x["t"]), "\n").alias("junctions"))
    return paths.join(text, "chain_id", "left").select("chain_id", "name", F.concat_ws("\n", "path", "junctions").alias("text"))


def write_report(path: str, kind: str, links: DataFrame, found: DataFrame, mismatches: DataFrame) -> None:
    """The report of checked chains as one local file: json or markdown.  Chains come to the driver one after the other, ordered by their names."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    summary = chain_summary(links, found).first().asDict()
    kinds = {r["schema_type"]: r["n"] for r in links.groupBy("schema_type").agg(F.count_distinct("schema", "file", "line").alias("n")).collect()}  # one row for each kind of schema
    with open(path, "w", encoding="utf-8") as f:
        if kind == "json":
            shown = links.groupBy("chain_id", "name").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "link_type", "schema", "schema_type", "file", "line", "transformation"))).alias("links"))
            wrong = mismatches.groupBy("chain_id", "pos").agg(F.array_sort(F.collect_list(F.struct("mismatch_type", "path", "level", "message"))).alias("mismatches"))
            each = found.drop("mismatches").join(wrong, ["chain_id", "pos"], "left").groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct("pos", "severity", "mismatches"))).alias("contracts"))
            now = datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds")
            f.write(json.dumps({"version": "1.0.0", "timestamp": now, "summary": summary | {"schemas": kinds}}, ensure_ascii=False)[:-1] + ', "chains": [')
            rows = shown.join(each, "chain_id", "left").orderBy("name", "chain_id").select(F.to_json(F.struct("chain_id", "name", "links", "contracts")).alias("j"))
            for k, r in enumerate(rows.toLocalIterator()):
                f.write((",\n" if k else "\n") + r["j"])
            f.write("\n]}\n")
            return
        f.write("# Data chain report\n\n")
        for label, key in (("Chains", "chains"), ("With critical contracts", "critical_chains"), ("With warnings", "warning_chains"), ("Valid", "valid"), ("Endpoints", "endpoints")):
            f.write(f"- {label}: {summary[key]}\n")
        f.write(f"- Coverage: {summary['coverage']:.1f}%\n\n## Schemas\n\n")
        f.writelines(f"- {TYPE_LABELS.get(k, k)}: {n}\n" for k, n in sorted(kinds.items()))
        f.write("\n## Chains\n\n")
        for k, r in enumerate(chain_lines(links, found, mismatches).orderBy("name", "chain_id").toLocalIterator(), 1):
            f.write(f"### {k}. {r['name']}\n\n{r['text']}\n\n")


def dot_file(output: str, name: str, several: bool) -> str:
    """Where an adapter's drawing goes: the output itself if it is a .dot file (with the adapter's name if there are several), else a file below it (beside it,
    if it is a report that is there already)."""
    if not output.endswith(".dot"):
        return os.path.join(os.path.dirname(output) if os.path.isfile(output) else output, f"{name}.dot")
    if not several:
        return output
    safe = re.sub("[^A-Za-z0-9]", "_", name)
    return os.path.join(os.path.dirname(output), f"{os.path.splitext(os.path.basename(output))[0]}-{safe}.dot")


def write_dot(path: str, name: str, nodes: DataFrame, edges: DataFrame) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"digraph {re.sub('[^A-Za-z0-9_]', '_', name)} {{\n")
        for r in dot_lines(nodes, edges).orderBy("part", "k", "line").select("line").toLocalIterator():
            f.write(r["line"] + "\n")
        f.write("}\n")


def write_markdown(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The readable report as one text file: statistics, schemas, then a line for each chain by id."""
    stats = contracts.coverage_query(spark, sf_dir).select(F.array(F.lit("# Report"), F.format_string("Chains: %d", "chains"), F.format_string("Critical: %d", "critical"), F.format_string("Warnings: %d", "warning"), F.format_string("Coverage: %.1f%%", "coverage")).alias("t")).select(F.posexplode("t").alias("k", "line")).withColumn("part", F.lit(0))
    kinds = schemas_by_type(spark, sf_dir).select(F.lit(1).alias("part"), F.lit(0).alias("k"), F.format_string("- %s: %s", "schema_type", "names").alias("line"))
    chains = contracts.chain_verdict_query(spark, sf_dir).select(F.lit(2).alias("part"), F.col("chain_id").alias("k"), F.format_string("- chain %d: %s", "chain_id", "severity").alias("line"))
    every = stats.select("part", F.col("k").cast("long").alias("k"), "line").unionByName(kinds.withColumn("k", F.col("k").cast("long"))).unionByName(chains)
    every.orderBy("part", "k", "line").select("line").write.mode("overwrite").text(path)


def write_json(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The machine-readable report: summary, version and time in one object."""
    contracts.summary_query(spark, sf_dir).select(F.lit("1.0.0").alias("version"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"), F.struct("*").alias("summary")).write.mode("overwrite").json(path)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A saved graph; an edge that names a missing node is an error."""
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id"))
    if not ends.join(nodes, "node_id", "left_anti").isEmpty():
        raise ValueError("Corrupted cache: an edge names a node that isn't there")
    return nodes, edges


def block_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = literal(spark, "shown_schemas").withColumn("metadata", F.from_json("metadata", "map<string,string>"))
    c = F.col
    return s.select("schema_no", schema_block(c("name"), c("schema_type"), c("file"), c("line"), c("metadata")).alias("block"), type_display(c("schema_type"), c("line") > 3, F.nullif("name", F.lit("User"))).alias("shown"))


QUERIES = {
    "schema_blocks": block_query,
    "schemas_distinct_by_type": schemas_by_type,
    "schemas_first_use": distinct_schemas,
    "recommendation_buckets": recommendations,
    "path_descriptions": path_descriptions,
    "verdict_cube": verdict_counts,
    "endpoint_index": endpoint_index,
    "dot_lines": dot_query,
}
_BLOCKS = {
    1: "- **Name**: `User`\n- **Type**: Pydantic Model\n- **Location**: `app/a.py:7`\n- **Schema Preview**: `{}`\n- **Fields**:\n  - `id:int`\n  - `name:str`\n- **Additional Metadata**:\n  - `a`: `1`\n  - `b`: `2`\n",
    2: "- **Name**: `Object`\n- **Type**: JSON Schema\n- **Location**: `app/main.py:9`\n- **Status**: ⚠️ **WARNING** - Schema validation missing\n- **Recommendation**: Create a Pydantic model to replace `dict[str, Any]` or `any` type.\n  Example:\n  ```python\n  from pydantic import BaseModel\n  \n  class pyModel(BaseModel):\n      # Add fields here\n      pass\n  ```\n- **Base Type**: `Object`\n- **Note**: This is a generic Object type without detailed schema definition.\n  Consider defining a Pydantic model at `app/main.py:9` to provide type safety.\n",
    3: "- **Name**: `load`\n- **Type**: JSON Schema\n- **Location**: `b.ts:0`\n- **Status**: Schema definition not found\n",
    4: "- **Name**: `Long`\n- **Type**: Zod Schema\n- **Location**: `z.ts:3`\n- **Additional Metadata**:\n  - `k`: `" + "é" * 50 + "...`\n",
}
ORACLE_SQL = {
    "schema_blocks": "SELECT * FROM (VALUES "
    + ", ".join(f"({k}, '{v}', '{d}')" for (k, v), d in zip(_BLOCKS.items(), ("pydantic?", "jsonschema? (Object)", "jsonschema (load)", "zod (Long)"), strict=True))
    + ") AS t(schema_no, block, shown)",
    "schemas_distinct_by_type": f"{contracts._BASE} SELECT schema_type, count(DISTINCT name) AS schemas, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM (SELECT from_no AS schema_no FROM c UNION SELECT to_no FROM c) JOIN schemas USING (schema_no) GROUP BY 1",
    "schemas_first_use": "SELECT p_name, p_size, l_orderkey, l_linenumber FROM (SELECT p_name, p_size, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY p_name, p_size ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE r = 1",
    "recommendation_buckets": ctes("recommendations") + " SELECT message, arg_min(severity, ord) AS severity, CASE WHEN contains(lower(message), 'type mismatch') THEN 'types' WHEN contains(lower(message), 'missing required field') THEN 'fields' WHEN contains(lower(message), 'schema validation') THEN 'schemas' ELSE 'other' END AS bucket FROM recommendations GROUP BY message",
    "path_descriptions": graph._walk_sql(graph._edge_sql() + ", " + graph._node_sql(), graph._ROUTES) + " SELECT start, string_agg('**' || name || '** (' || kind || ')', ' → ' ORDER BY pos) AS description FROM (SELECT start, unnest(path) AS node_id, generate_subscripts(path, 1) AS pos FROM p) JOIN n USING (node_id) GROUP BY 1",
    "verdict_cube": f"{contracts._SEVERITY} SELECT severity, o_orderstatus, count(*) AS contracts, CAST(sum(n_mismatches) AS BIGINT) AS mismatches FROM s JOIN orders ON o_orderkey = chain_id GROUP BY CUBE (severity, o_orderstatus)",
    "endpoint_index": "SELECT regexp_replace(url, '[?#].*$', '') AS address, max(page_id) AS page_id, count(*) AS pages FROM pages GROUP BY 1",
    "dot_lines": f"WITH {graph._edge_sql()}, {graph._node_sql()} SELECT 0 AS part, node_id AS k, '  n' || node_id || ' [label=\"' || replace(replace(kind || ' ' || name, '\\', '\\\\'), '\"', '\\\"') || '\"];' AS line FROM n UNION ALL SELECT 1, edge_id, '  n' || src || ' -> n' || dst || CASE WHEN kind = 'DataFlow' THEN ' [style=dashed, color=purple]' ELSE '' END || ';' FROM e",
}
