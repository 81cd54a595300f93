"""From TypeScript sources to a property graph: modules, definitions, calls, schemas, routes of API calls, routes of controllers.

The files (path, content) of a project become facts in one pass; what joins them are DataFrame operators. The graph has the columns of ``python_graph.Graph``,
so chains, contracts and checks are the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions import frontend as fe
from linkweave.functions import names
from linkweave.operators import frontend, linking, nest
from linkweave.plans.python_graph import Graph, node_id
from linkweave.session import materialize
from linkweave.sources import typescript_source

_PARAM = "array<struct<ord: int, name: string, type: string, model: string, is_model: boolean, missing: boolean, base: string>>"


def _type(text: Column) -> Column:
    """A type without its Promise, list marks and module."""
    bare = F.regexp_replace(F.trim(text), r"(?s)^Promise<(.*)>$", "$1")
    return F.trim(F.split_part(F.split_part(bare, F.lit("|"), F.lit(1)), F.lit("&"), F.lit(1)))


def _parameters(args: Column) -> Column:
    """The parameters of a definition with what their types say: a name of a type is that type, others have a base type."""

    def one(a: Column, k: Column) -> Column:
        kind = _type(F.regexp_extract(a, "(?s)^[^:]*:(.*)$", 1))
        base = F.when(kind == "", "Unknown").otherwise(fe.base_type(kind))
        model = names.last_part(F.regexp_replace(kind, "<.*$", ""))
        return F.struct(k.cast("int").alias("ord"), F.split_part(a, F.lit(":"), F.lit(1)).alias("name"), kind.alias("type"), model.alias("model"), (base == "Object").alias("is_model"), (kind == "any").alias("missing"), base.alias("base"))

    return F.transform(args, one).cast(_PARAM)


def definitions(facts: DataFrame) -> DataFrame:
    """Nodes of modules, functions (the first of a file and name), classes (the first of a name) and methods (the first of a class and name)."""
    named = facts.select("path", "ord", "fact", "name", "owner", "detail", "args", "line")
    functions = frontend.first_definitions(named.filter("fact = 'function' and owner = ''").withColumn("file", F.col("path")), ["file", "name"]).drop("file")
    classes = frontend.first_definitions(named.filter("fact = 'class'"), ["name"])
    methods = frontend.first_definitions(named.filter("fact = 'method'"), ["owner", "name"])
    kind = F.initcap("fact")
    own = functions.unionByName(classes).unionByName(methods)
    key = F.when(F.col("fact") == "method", F.concat_ws(".", "owner", "name")).otherwise(F.col("name"))
    of_class = classes.select(F.col("name").alias("owner"), node_id("Class", F.col("name")).alias("class_id"))
    result = _type(F.col("detail"))
    rows = own.join(of_class, "owner", "left").select(
        F.when(F.col("fact") == "class", node_id("Class", F.col("name"))).when(F.col("fact") == "method", node_id("Method", F.col("owner"), F.col("name"))).otherwise(node_id("Function", F.col("path"), F.col("name"))).alias("node_id"),
        kind.alias("kind"), "name", F.col("path").alias("file"), "line", F.when(F.col("fact") == "method", F.col("class_id")).alias("class_id"), names.function_key(F.col("path"), key).alias("key"),
        F.when(F.col("fact") != "class", _parameters(F.col("args"))).alias("params"),
        F.struct(F.when(fe.base_type(result) == "Object", names.last_part(F.regexp_replace(result, "<.*$", ""))).alias("model"), (fe.base_type(result) == "Object").alias("is_model"), F.lit(False).alias("missing")).alias("result"),
    )
    modules = facts.select("path").distinct().select(node_id("Module", F.col("path")).alias("node_id"), F.lit("Module").alias("kind"), F.col("path").alias("name"), F.col("path").alias("file"), F.lit(0).alias("line"))
    return rows.unionByName(modules, allowMissingColumns=True)


def schemas(facts: DataFrame) -> DataFrame:
    """Schema nodes (node_id, name, schema_type, file, line): Zod schemas and the types of a module."""
    found = facts.filter("fact in ('zod', 'schema')").select("path", "ord", "name", F.when(F.col("fact") == "zod", "Zod").otherwise("TypeScript").alias("schema_type"), "line")
    return found.select(node_id("Schema", F.col("path"), F.col("schema_type"), F.col("name"), F.col("ord")).alias("node_id"), "name", "schema_type", F.col("path").alias("file"), "line")


def schema_fields(facts: DataFrame) -> DataFrame:
    """(name, field, type_name, optional, constraints) of Zod schemas and types."""
    zod = typescript_source.zod_fields(facts).select(F.col("schema").alias("name"), "field", F.col("field_type").alias("type_name"), "optional")
    plain = typescript_source.type_fields(facts).select(F.col("schema").alias("name"), "field", F.regexp_replace("field_type", r"^.*\[\]$|^Array<.*$", "array").alias("type_name"), "optional")
    return zod.unionByName(plain).dropDuplicates(["name", "field"]).withColumn("constraints", F.lit("[]"))


def api_routes(facts: DataFrame, files: DataFrame, endpoints: DataFrame, imports: DataFrame) -> DataFrame:
    """Routes of the project's API calls with their handlers: calls of HTTP clients, data hooks and functions of generated clients."""
    functions = facts.filter("fact = 'function'").select(F.col("path").alias("file"), "name", "line")
    sdk = frontend.sdk_calls(functions.filter(fe.is_sdk_file(F.col("file"))), files.filter(fe.is_sdk_file(F.col("path"))).select(F.col("path").alias("file"), "content"), endpoints)
    calls = typescript_source.api_calls(facts, sdk)
    lines = facts.filter("fact = 'call'").select(F.col("path").alias("file"), "ord", "line")
    calls = calls.join(lines, ["file", "ord"]).select(F.concat_ws("|", "file", "ord").alias("call_id"), "file", "ord", "line", "method", F.regexp_replace("path", "^['\"`]+|['\"`]+$", "").alias("path"), "request", "response")
    types = frontend.service_types(frontend.service_files(files.select(F.col("path").alias("file")), files.select(F.col("path").alias("file")), files.select(F.lit(0).alias("ord"), F.lit("").alias("root")).limit(1)), _typed_functions(facts))
    return frontend.api_routes(calls, types, endpoints).join(calls.select("call_id", "ord"), "call_id")


def _typed_functions(facts: DataFrame) -> DataFrame:
    first = F.nullif(F.regexp_extract(F.get("args", 0), "(?s)^[^:]*:(.*)$", 1), F.lit(""))
    return facts.filter("fact = 'function'").select(F.col("path").alias("file"), "ord", "name", first.alias("request"), F.nullif(_type(F.col("detail")), F.lit("")).alias("response"))


def build(files: DataFrame, endpoints: DataFrame, mappings: DataFrame | None = None, root: str = "", controllers: bool = False) -> Graph:
    """The graph of a front-end project; with ``controllers`` also the routes of controller classes.

    ``endpoints``: ord, path, method, operation_id, request, response of the spec (no rows without one)."""
    facts = materialize(typescript_source.extract(files), "facts")
    defined = materialize(definitions(facts), "definitions")
    listing = files.select(F.col("path").alias("file"))
    asked = facts.filter("fact = 'import'").select(F.concat_ws("|", "path", "ord").alias("import_id"), F.col("path").alias("file"), F.col("name").alias("path"), "ord")
    imports = frontend.resolve_imports(asked.drop("ord"), listing, mappings, root).filter("resolved is not null").join(asked.select("import_id", "ord"), "import_id")
    none = F.lit(None).cast("string")
    edge = lambda df, src, dst, kind: df.select(src.alias("src"), dst.alias("dst"), F.col("ord").cast("long").alias("edge_id"), F.lit(kind).alias("kind"), none.alias("transformation"))
    import_edges = edge(imports, node_id("Module", F.col("file")), node_id("Module", F.col("resolved")), "Import")
    calls = facts.filter("fact = 'call'").select(F.concat_ws("|", "path", "ord").alias("call_id"), F.col("path").alias("file"), F.col("name").alias("callee"), "ord")
    functions = defined.filter("kind in ('Function', 'Method')").select("file", F.element_at(F.split("key", "::"), -1).alias("name"), "node_id")
    found = frontend.resolve_or_invent(calls, functions).join(calls, "call_id").withColumn("target", F.coalesce("node_id", node_id("Function", F.col("file"), F.col("callee"))))
    call_edges = edge(found, node_id("Module", F.col("file")), F.col("target"), "Call")
    virtual = found.filter("node_id is null").select(F.col("target").alias("node_id"), F.lit("Function").alias("kind"), F.col("callee").alias("name"), "file", F.lit(0).alias("line")).distinct()
    routes = materialize(api_routes(facts, files, endpoints, imports), "api-routes")
    handler = node_id("Function", F.col("file"), F.lit("api_handler"))
    route_nodes = routes.select(node_id("Route", F.col("file"), F.col("ord")).alias("node_id"), F.lit("Route").alias("kind"), F.col("path").alias("name"), "file", "line", "method", F.col("path").alias("route"), handler.alias("handler_id"), F.col("request_schema").alias("request"), F.col("response_schema").alias("response"), F.lit(False).alias("response_missing"))
    holders = routes.groupBy("file").agg(F.min_by(F.struct("parameter", "returns"), "ord").alias("t"))
    parameter = F.when(F.col("t.parameter").isNotNull(), _parameters(F.array(F.concat(F.lit("request:"), F.col("t.parameter")))))
    handlers = holders.select(handler.alias("node_id"), F.lit("Function").alias("kind"), F.lit("api_handler").alias("name"), "file", F.lit(0).alias("line"), parameter.alias("params"))
    route_edges = edge(routes, node_id("Route", F.col("file"), F.col("ord")), handler, "Call")
    shown = schemas(facts)
    nodes = defined.unionByName(virtual, allowMissingColumns=True).unionByName(route_nodes, allowMissingColumns=True).unionByName(handlers, allowMissingColumns=True)
    nodes = nodes.unionByName(shown.select("node_id", F.lit("Schema").alias("kind"), "name", "file", "line"), allowMissingColumns=True)
    edges = import_edges.unionByName(call_edges).unionByName(route_edges)
    if controllers:
        own = typescript_source.nest_routes(facts).join(nest.handler_types(facts), ["path", "handler"], "left").withColumns({"class": F.split_part("handler", F.lit("."), F.lit(1)), "own": F.element_at(F.split("handler", r"\."), -1)})
        method = node_id("Method", F.col("class"), F.col("own"))
        at = node_id("Route", F.col("path"), F.col("method"), F.col("route"), F.col("handler"))
        nodes = nodes.unionByName(own.select(at.alias("node_id"), F.lit("Route").alias("kind"), F.col("route").alias("name"), F.col("path").alias("file"), "line", "method", "route", method.alias("handler_id"), F.col("request"), F.col("response"), F.lit(False).alias("response_missing")), allowMissingColumns=True)
        edges = edges.unionByName(edge(own.withColumn("ord", F.col("line")), at, method, "Call"))
    return Graph(materialize(nodes.withColumn("response_missing", F.coalesce("response_missing", F.lit(False))).dropDuplicates(["node_id"]), "nodes"), materialize(edges, "graph-edges"), materialize(schema_fields(facts), "fields"), "TypeScript")


EXAMPLE = {
    "web/app.ts": """import { load } from './lib/load';
import { getItems } from './api/sdk.gen';
const Item = z.object({ id: z.number(), title: z.string() });
interface Card { id: string; note?: string }
function show(card: Card): void { render(card); }
show(load());
getItems();
axios.post('/cards', body);
""",
    "web/lib/load.ts": """export function load(): Promise<Card> { return fetch('/cards'); }
""",
    "web/api/sdk.gen.ts": """export function getItems(options: Options) {
  return (options?.client ?? client).get({ url: "/items/" })
}
""",
}


def example(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    files = spark.createDataFrame(list(EXAMPLE.items()), "path string, content string")
    endpoints = spark.sql("SELECT * FROM (VALUES (0, '/cards', 'post', 'add_card', 'CardIn', 'CardOut')) AS t(ord, path, method, operation_id, request, response)")
    return files, endpoints


_graphs: dict[str, Graph] = {}


def _graph(spark: SparkSession) -> Graph:
    """The example's graph, built once for an application."""
    at = spark.sparkContext.applicationId
    if at not in _graphs:
        _graphs[at] = build(*example(spark))
    return _graphs[at]


def node_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark).nodes.select("kind", "name", "file", "line", "method", "request", "response")


def edge_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark)
    short = lambda column, as_: g.nodes.select(F.col("node_id").alias(column), F.concat_ws(" ", "kind", "name").alias(as_))
    return g.edges.join(short("src", "source"), "src").join(short("dst", "target"), "dst").select("source", "target", "kind").distinct()


QUERIES = {"typescript_graph_nodes": node_query, "typescript_graph_edges": edge_query}
ORACLE_SQL = {
    "typescript_graph_nodes": "SELECT * FROM (VALUES ('Module', 'web/app.ts', 'web/app.ts', 0, NULL, NULL, NULL), ('Module', 'web/lib/load.ts', 'web/lib/load.ts', 0, NULL, NULL, NULL), ('Module', 'web/api/sdk.gen.ts', 'web/api/sdk.gen.ts', 0, NULL, NULL, NULL), ('Function', 'show', 'web/app.ts', 5, NULL, NULL, NULL), ('Function', 'load', 'web/lib/load.ts', 1, NULL, NULL, NULL), ('Function', 'getItems', 'web/api/sdk.gen.ts', 1, NULL, NULL, NULL), ('Schema', 'Item', 'web/app.ts', 3, NULL, NULL, NULL), ('Schema', 'Card', 'web/app.ts', 4, NULL, NULL, NULL),"
    " ('Function', 'render', 'web/app.ts', 0, NULL, NULL, NULL), ('Function', 'axios.post', 'web/app.ts', 0, NULL, NULL, NULL), ('Function', 'fetch', 'web/lib/load.ts', 0, NULL, NULL, NULL), ('Function', 'z.object', 'web/app.ts', 0, NULL, NULL, NULL), ('Function', 'z.number', 'web/app.ts', 0, NULL, NULL, NULL), ('Function', 'z.string', 'web/app.ts', 0, NULL, NULL, NULL),"
    " ('Route', '/cards', 'web/lib/load.ts', 1, 'GET', NULL, NULL), ('Route', '/items/', 'web/app.ts', 7, 'GET', NULL, NULL), ('Route', '/cards', 'web/app.ts', 8, 'POST', 'CardIn', 'CardOut'), ('Function', 'api_handler', 'web/app.ts', 0, NULL, NULL, NULL), ('Function', 'api_handler', 'web/lib/load.ts', 0, NULL, NULL, NULL)) AS t(kind, name, file, line, method, request, response)",
    "typescript_graph_edges": "SELECT * FROM (VALUES ('Module web/app.ts', 'Module web/lib/load.ts', 'Import'), ('Module web/app.ts', 'Module web/api/sdk.gen.ts', 'Import'), ('Module web/app.ts', 'Function show', 'Call'), ('Module web/app.ts', 'Function load', 'Call'), ('Module web/app.ts', 'Function getItems', 'Call'), ('Module web/app.ts', 'Function render', 'Call'), ('Module web/app.ts', 'Function axios.post', 'Call'), ('Module web/app.ts', 'Function z.object', 'Call'), ('Module web/app.ts', 'Function z.number', 'Call'), ('Module web/app.ts', 'Function z.string', 'Call'), ('Module web/lib/load.ts', 'Function fetch', 'Call'), ('Route /cards', 'Function api_handler', 'Call'), ('Route /items/', 'Function api_handler', 'Call')) AS t(source, target, kind)",
}
