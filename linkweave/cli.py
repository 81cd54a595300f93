"""Commands: check a project's data chains, draw its graphs, write a configuration to begin with.

    python -m linkweave check -c project.toml -f markdown
    python -m linkweave visualize -c project.toml
    python -m linkweave init project.toml
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.operators import reports, schema_texts, zod_chains
from linkweave.plans import python_graph, typescript_graph
from linkweave.plans.python_graph import Graph
from linkweave.session import build_session, materialize
from linkweave.sources import project, spec

log = logging.getLogger("linkweave")

#: What ``init`` writes for each setting: its name, a value to begin with, and what it is for.
SETTINGS = (
    ("", (("project_name", "my-project", "heading of the report"), ("max_recursion_depth", 50, "how many imports deep a graph goes"), ("strict_imports", False, "stop at an import that can't be found"))),
    ("[adapters]", (("type", "fastapi", "fastapi, typescript or nestjs; one table for each side of the project"), ("app_path", "server/main.py", "module of the application object"))),
    ("[adapters]", (("type", "typescript", ""), ("src_paths", ["client/src"], "folders that are read whole"))),
    ("output", (("format", "markdown", "markdown or json"), ("path", "data-chains.md", "a folder beside it takes the drawings"))),
)


def template() -> str:
    """A configuration to begin with, from ``SETTINGS``."""
    lines = []
    for section, values in SETTINGS:
        lines += [f"[{section}]"] if section else []
        lines += [f"{name} = {json.dumps(value)}" + (f"  # {said}" if said else "") for name, value, said in values] + [""]
    return "\n".join(lines)


def set_up_logging(level: str | None = None, file: str | None = None, verbose: bool = False, console: bool = True) -> None:
    """Messages to the console, to a file or to both, from ``level`` (or LINKWEAVE_LOG, else info) on; ``verbose`` shows all."""
    level = "debug" if verbose else level or os.environ.get("LINKWEAVE_LOG", "info")
    file = file or os.environ.get("LINKWEAVE_LOG_FILE")
    handlers: list[logging.Handler] = [logging.StreamHandler()] if console else []
    if file:
        handlers.append(logging.FileHandler(file, encoding="utf-8"))
    for h in log.handlers[:]:
        log.removeHandler(h)
        h.close()
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(h)
    log.setLevel(getattr(logging, level.upper(), logging.INFO))


def init(path: str) -> None:
    """A configuration to begin with; an existing file stays as it is."""
    if os.path.exists(path):
        raise FileExistsError(f"there is a configuration already: {path}")
    with open(path, "w", encoding="utf-8") as f:
        f.write(template())
    log.info("wrote %s", path)


def _relative(files: DataFrame, root: str) -> DataFrame:
    """Paths below the root, with slashes."""
    return files.select(F.regexp_replace("path", f"^file:/*{os.path.abspath(root).strip('/')}/", "").alias("path"), "content")


def endpoints_of(spark: SparkSession, path: str | None) -> DataFrame:
    """(ord, path, method, operation_id, request, response) of a specification; no rows without one."""
    if not path:
        return spark.createDataFrame([], "ord long, path string, method string, operation_id string, request string, response string")
    found = spec.endpoints(spec.read_specs(spark, [path]))
    return found.withColumn("ord", F.xxhash64("path", "method")).select("ord", "path", "method", "operation_id", "request", "response")


def with_components(g: Graph, components: DataFrame) -> Graph:
    """The graph with the fields of a specification's components (name, schema as JSON text) whose names its own sources don't define, so that the rules can compare them."""
    none = F.lit(None).cast("string")
    parsed = schema_texts.parse(components.select(F.col("name").alias("schema_no"), F.lit("TypeScript").alias("schema_type"), F.col("schema").alias("json_schema"), none.alias("fields"), none.alias("required"), none.alias("type_text")))
    limits = parsed.constraints.groupBy("schema_no", "field").agg(F.to_json(F.collect_list(F.array("kind"))).alias("constraints"))
    rows = parsed.fields.join(limits, ["schema_no", "field"], "left").select(F.col("schema_no").alias("name"), "field", "type_name", "optional", F.coalesce("constraints", F.lit("[]")).alias("constraints"))
    own = g.fields.select("name").distinct()
    return dataclasses.replace(g, fields=materialize(g.fields.select(*rows.columns).unionByName(rows.join(own, "name", "left_anti")), "fields"))


def python_adapter(spark: SparkSession, config: spec.Config, adapter: dict) -> Graph:
    app = adapter["app_path"]
    root = project.python_root(app)
    files = materialize(_relative(spec.read_sources(spark, root, "*.py"), root), "sources")
    entry = os.path.relpath(app, root)
    g = python_graph.build(files, entry, os.path.dirname(entry), config.max_recursion_depth, config.strict_imports, python_graph.router_catalogue(spark, config.dynamic_routes))
    path = adapter.get("openapi_path") or config.openapi_path
    return python_graph.enrich(g, endpoints_of(spark, path)) if path else g


def frontend_adapter(spark: SparkSession, config: spec.Config, adapter: dict, controllers: bool) -> tuple[Graph, DataFrame]:
    paths = adapter["src_paths"]
    root = project.frontend_root(paths)
    files = None
    for p in paths:
        found = _relative(spec.read_sources(spark, p, "*.{ts,tsx}"), root)
        files = found if files is None else files.unionByName(found)
    files = materialize(files.dropDuplicates(["path"]), "sources")
    base, pairs = project.path_mappings(root)
    mappings = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "ord int, pattern string, target string")
    below = os.path.relpath(base, root)
    endpoints = endpoints_of(spark, adapter.get("openapi_path") or config.openapi_path)
    return typescript_graph.build(files, endpoints, mappings, "" if below == "." else below, controllers), files


def zod_parts(spark: SparkSession, g: Graph, files: DataFrame, endpoints: DataFrame, models: DataFrame, model_fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of the chains from Zod schemas over API routes to models, in the form of ``python_graph.chains``, and the mismatches of their fields.

    ``models``: node_id, name, file, line of the models of all back ends; ``model_fields``: node_id, field, field_type, optional."""
    facts = materialize(typescript_graph.typescript_source.extract(files), "facts")
    own = typescript_graph.schemas(facts).filter("schema_type = 'Zod'")
    shown = materialize(own.unionByName(models.withColumn("schema_type", F.lit("Pydantic"))), "zod-schemas")
    usages = typescript_graph.typescript_source.zod_usages(facts).select(F.xxhash64("path", "line", "schema").alias("usage_id"), F.col("schema").alias("schema_name"), F.col("path").alias("file"), "line")
    routes = g.nodes.filter("kind = 'Route'").select("node_id", F.col("route").alias("path"), "method", "file", "line")
    calls = routes.select(F.col("node_id").alias("call_id"), "file", "line")
    found = materialize(zod_chains.chains(shown, usages, calls, routes, endpoints).withColumn("chain_id", F.concat_ws("-", "chain_id", "zod_id")), "zod-chains")
    zod_fields = typescript_graph.typescript_source.zod_fields(facts).join(own.select(F.col("name").alias("schema"), "node_id"), "schema").select("node_id", "field", "field_type", "optional")
    wrong = zod_chains.chain_mismatches(found, zod_fields.unionByName(model_fields))
    route = python_graph.with_schemas(g.nodes, g.schema_type).select("node_id", "id", "schema", "schema_type", "missing", "file", "line")
    return zod_chains.chain_links(found, shown, route), zod_chains.mismatch_rows(found, wrong)


def models_of(graphs: list[Graph], spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Models of back ends as (node_id, name, file, line), and their fields as (node_id, field, field_type, optional)."""
    nodes = spark.createDataFrame([], "node_id long, name string, file string, line int")
    fields = spark.createDataFrame([], "node_id long, field string, field_type string, optional boolean")
    for g in graphs:
        own = g.nodes.filter("kind = 'Class'").join(g.fields.select("name").distinct(), "name").select("node_id", "name", "file", "line")
        nodes = nodes.unionByName(own)
        fields = fields.unionByName(g.fields.join(own, "name").select("node_id", "field", F.col("type_name").alias("field_type"), "optional"))
    return nodes, fields


def check(spark: SparkSession, config_path: str, kind: str | None = None) -> str:
    """Build the graphs of all adapters, find their chains, check their contracts and write the report; its path.

    Chains from Zod schemas end at the models of the project's back ends, whatever the order of the adapters."""
    config = spec.load_config(config_path)
    built = []
    for k, adapter in enumerate(config.adapters):
        log.info("adapter %d of %d: %s", k + 1, len(config.adapters), adapter["type"])
        built.append((python_adapter(spark, config, adapter), None) if adapter["type"] == "fastapi" else frontend_adapter(spark, config, adapter, adapter["type"] == "nestjs"))
    models, model_fields = models_of([g for (g, files) in built if files is None], spark)
    all_links = all_found = all_wrong = None
    for k, (adapter, (g, files)) in enumerate(zip(config.adapters, built, strict=True)):
        links = python_graph.chains(g).unionByName(python_graph.chains(g, forward=False))
        fields_wrong = None
        if adapter["type"] == "typescript":
            endpoints = endpoints_of(spark, adapter.get("openapi_path") or config.openapi_path)
            if not endpoints.isEmpty():
                more, fields_wrong = zod_parts(spark, g, files, endpoints, models, model_fields)
                links = links.unionByName(more)
        named = lambda df, k=k: df.withColumn("chain_id", F.concat(F.lit(f"{k}-"), "chain_id"))
        links = materialize(named(links), "links")
        contracts = materialize(python_graph.link_contracts(links), "contracts")
        described = adapter.get("openapi_path") or config.openapi_path
        wrong = python_graph.check(with_components(g, spec.schemas(spec.read_specs(spark, [described]))) if described else g, contracts)
        wrong = materialize(wrong if fields_wrong is None else wrong.unionByName(named(fields_wrong)), "mismatches")
        found = python_graph.report(contracts, wrong)
        all_links = links if all_links is None else all_links.unionByName(links)
        all_found = found if all_found is None else all_found.unionByName(found)
        all_wrong = wrong if all_wrong is None else all_wrong.unionByName(wrong)
    path = config.output["path"]
    reports.write_report(path, kind or config.output.get("format", "markdown"), all_links, materialize(all_found, "verdicts"), all_wrong)
    log.info("report: %s", path)
    return path


def visualize(spark: SparkSession, config_path: str) -> list[str]:
    """A drawing of each adapter's graph; the paths.  Controllers have none of their own."""
    config = spec.load_config(config_path)
    out = []
    for k, adapter in enumerate(config.adapters):
        if adapter["type"] == "fastapi":
            g = python_adapter(spark, config, adapter)
        elif adapter["type"] == "typescript":
            g, _ = frontend_adapter(spark, config, adapter, controllers=False)
        else:
            log.error("no drawing for adapters of type %s", adapter["type"])
            continue
        name = f"{adapter['type']}_{k}"
        path = reports.dot_file(config.output["path"], name, len(config.adapters) > 1)
        reports.write_dot(path, name, g.nodes, g.edges)
        out.append(path)
        log.info("drawing: %s", path)
    return out


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="linkweave", description=__doc__.splitlines()[0])
    parser.add_argument("--log-level")
    parser.add_argument("--log-file")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("check")
    one.add_argument("-c", "--config", default="linkweave.toml")
    one.add_argument("-f", "--format", choices=("markdown", "json"))
    one.add_argument("-v", "--verbose", action="store_true")
    two = commands.add_parser("visualize")
    two.add_argument("-c", "--config", default="linkweave.toml")
    three = commands.add_parser("init")
    three.add_argument("path", nargs="?", default="linkweave.toml")
    args = parser.parse_args(argv)
    set_up_logging(args.log_level, args.log_file, getattr(args, "verbose", False))
    try:
        if args.command == "init":
            init(args.path)
        else:
            spark = build_session("linkweave")
            check(spark, args.config, args.format) if args.command == "check" else visualize(spark, args.config)
    except (OSError, ValueError) as error:
        log.error("%s", error)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
