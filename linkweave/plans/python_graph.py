"""From Python sources to a property graph, chains and contracts.

files (path, content) -> facts -> files that an entry point reaches -> nodes and edges -> chains from routes -> contracts between neighbours -> mismatches.
Paths are relative to one folder, with slashes.  Nodes have 64-bit ids from their kind, file and name, so they are made without a global order; an edge's
number is the place of its statement in its file, so the neighbours of a node are tried from its last statement to its first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions import annotations, names
from linkweave.operators import contracts, graph, linking
from linkweave.plans.fixtures import literal
from linkweave.session import materialize
from linkweave.sources import python_source

#: Files that an application begins with, the first that is there (fixed values).
ENTRY_POINTS = ("main.py", "app.py", "__main__.py", "server.py")
#: Numbers of edges that are made after all statements.
LATE = 1 << 40
_LINK = "chain_id string, pos int, node_id long, id string, link_type string, schema string, schema_type string, missing boolean, file string, line int"


def entry_point(files: DataFrame, folder: str = "") -> str | None:
    """The first usual entry point in a folder."""
    names_ = {x: k for k, x in enumerate(f"{folder}/{n}" if folder else n for n in ENTRY_POINTS)}
    found = [r.path for r in files.filter(F.col("path").isin(*names_)).select("path").distinct().collect()]
    return min(found, key=names_.__getitem__, default=None)


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def _below(folder: Column, module: Column) -> Column:
    return F.concat_ws("/", F.nullif(folder, F.lit("")), F.replace(module, F.lit("."), F.lit("/")))


def module_candidates(path: Column, module: Column, root: str) -> Column:
    """array of the paths without an ending that a module may stand at: below the folder ``app`` around the file, beside the file, below the root."""
    here = _folder(path)
    parts = F.split(here, "/")
    # the nearest folder ``app`` above the file's own, else the file's own
    above = F.regexp_extract(here, r"^((?:.*/)?app)/", 1)
    app = F.when(above != "", above).when(F.element_at(parts, -1) == "app", here)
    in_app = F.when(module.startswith("app."), _below(app, F.substring(module, 5, 1 << 20)))
    own = F.element_at(parts, -1)
    beside = F.when((own != "") & F.startswith(module, F.concat(own, F.lit("."))), F.substring(module, F.char_length(own) + 2, F.lit(1 << 20))).otherwise(module)
    return F.array(in_app, _below(here, beside), _below(F.lit(root), module))


def resolve_modules(imports: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """(path, ord, module, resolved) of imports (path, ord, module) whose module is a file of the project: a package's __init__ comes before a module of the name."""
    tried = imports.select("path", "ord", "module", F.posexplode(module_candidates(F.col("path"), F.col("module"), root)).alias("rank", "at")).filter("at is not null")
    tried = tried.select("path", "ord", "module", F.explode(F.array(F.struct((F.col("rank") * 2).alias("rank"), F.concat("at", F.lit("/__init__.py")).alias("resolved")), F.struct((F.col("rank") * 2 + 1).alias("rank"), F.concat("at", F.lit(".py")).alias("resolved")))).alias("c")).select("path", "ord", "module", "c.*")
    there = tried.join(files.select(F.col("path").alias("resolved")).distinct(), "resolved")
    return linking.first_by(there, ["path", "ord"], ["rank"]).select("path", "ord", "module", "resolved")


def imports_of(facts: DataFrame) -> DataFrame:
    """(path, ord, module, name): a row for each name of the imports among a module's own statements; leading dots don't count."""
    top = facts.filter("fact = 'import' and extra = 'top'").select("path", "ord", F.regexp_replace("name", r"^\.+", "").alias("module"), F.explode(F.split("detail", ",")).alias("name"))
    return top.filter("module <> ''")


def unresolved(imports: DataFrame, resolved: DataFrame, strict: bool = False) -> DataFrame:
    """Imports without a file of the project.  With ``strict`` there may be none."""
    gone = imports.select("path", "ord", "module").distinct().join(resolved.select("path", "ord"), ["path", "ord"], "left_anti")
    if strict and not gone.isEmpty():
        first = gone.orderBy("path", "ord").first()
        raise ValueError(f"unresolved import {first['module']} in {first['path']}")
    return gone


def _steps(wanted: DataFrame, found: DataFrame, files: DataFrame) -> DataFrame:
    """(path, resolved): the files of the imports, and of imported names that are submodules."""
    beside = found.join(wanted, ["path", "ord", "module"]).withColumn("sub", F.explode(F.array(F.concat_ws("/", _folder(F.col("resolved")), F.concat("name", F.lit(".py"))), F.concat_ws("/", _folder(F.col("resolved")), "name", F.lit("__init__.py")))))
    subs = beside.select("path", F.regexp_replace("sub", "^/", "").alias("resolved")).join(files.select(F.col("path").alias("resolved")).distinct(), "resolved", "left_semi")
    return found.select("path", "resolved").unionByName(subs.select("path", "resolved")).distinct()


def steps_between(facts: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """(path, resolved): which file of a project leads to which by its imports."""
    wanted = imports_of(facts)
    return _steps(wanted, resolve_modules(wanted.select("path", "ord", "module").distinct(), files, root), files)


def reached(facts: DataFrame, files: DataFrame, entry: str, root: str = "", max_depth: int | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Files that an entry point reaches by imports (path, depth), and the imports between files (path, ord, module, resolved).

    A name that is a submodule of what is imported is reached too.  ``max_depth`` bounds the files on a way."""
    wanted = imports_of(facts)
    found = materialize(resolve_modules(wanted.select("path", "ord", "module").distinct(), files, root), "imports")
    if strict:
        unresolved(wanted, found, strict=True)
    steps = materialize(_steps(wanted, found, files), "steps")
    frontier = materialize(files.filter(F.col("path") == entry).select("path", F.lit(0).alias("depth")).distinct(), "reached")
    seen, depth = frontier, 0
    while not frontier.isEmpty() and (max_depth is None or depth + 1 < max_depth):
        depth += 1
        new = frontier.join(steps, "path").select(F.col("resolved").alias("path")).distinct().join(seen, "path", "left_anti")
        frontier = materialize(new.select("path", F.lit(depth).alias("depth")), "reached")
        seen = seen.unionByName(frontier)
    return materialize(seen, "reached"), found


def node_id(kind: str, *parts: Column) -> Column:
    return F.xxhash64(F.lit(kind), *parts)


@dataclass
class Graph:
    #: node_id, kind, name, file, line, class_id, key, params, result; of routes method, route, handler_id, request, response, response_missing
    nodes: DataFrame
    #: src, dst, edge_id, kind, transformation
    edges: DataFrame
    #: name, field, type_name, optional, constraints of models
    fields: DataFrame
    #: the kind of schema that the names of types and models stand for
    schema_type: str = "Pydantic"


def _known_models(models: DataFrame) -> DataFrame:
    """(key, all): models by their name in lower case."""
    return models.groupBy(F.lower("name").alias("key")).agg(F.collect_set("name").alias("all"))


def _model_of(name: Column) -> Column:
    """The model that a type's name means: of that name, else of the name in any case."""
    return F.when(F.array_contains("all", name), name).otherwise(F.array_min("all"))


def resolved_types(texts: DataFrame, models: DataFrame, text: str = "text") -> DataFrame:
    """Adds type, model, is_model, missing and base of an annotation: Annotated and Optional are taken off; a type that tells no fields is missing,
    one that names a model is that model, others have a base type."""
    bare = F.regexp_replace(text, r"\s+", " ")
    inner = F.when(annotations.is_annotated(bare), annotations.annotated_inner(bare)).otherwise(bare)
    actual = names.last_part(F.when(annotations.head(inner) == "Optional", annotations.bracketed(inner)).otherwise(annotations.head(inner)))
    missing = annotations.missing_schema(F.col("type"))
    typed = texts.withColumns({"type": inner, "named": actual, "key": F.lower(actual)}).join(_known_models(models), "key", "left")
    return typed.withColumns({"model": _model_of(F.col("named")), "missing": missing, "base": annotations.annotation_base_type(F.col("type"))}).withColumn("is_model", F.col("model").isNotNull() & ~missing).drop("key", "all", "named")


def definitions(facts: DataFrame, models: DataFrame, modules: DataFrame) -> DataFrame:
    """Nodes of modules (path), functions, classes and methods; of a key that is defined twice the first.

    ``params`` has each parameter with its resolved type; a method's first one is left out, unless it is static.  ``result`` is the resolved type of what is returned."""
    params = resolved_types(facts.filter("fact = 'param'").select("path", "owner", "ord", "name", F.col("detail").alias("text")), models)
    lists = params.groupBy("path", "owner").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "type", "model", "is_model", "missing", "base"))).alias("params"))
    static = facts.filter("fact = 'decorator'").groupBy("path", "owner").agg(F.collect_list("name").alias("decorators")).select("path", "owner", annotations.has_decorator(F.col("decorators"), "staticmethod").alias("static"))
    returns = resolved_types(facts.filter("fact = 'returns'").select("path", "owner", F.col("detail").alias("text")), models).select("path", "owner", F.struct("model", "is_model", "missing").alias("result"))
    qualified = F.when(F.col("owner") == "", F.col("name")).otherwise(F.concat_ws(".", "owner", "name"))
    own = facts.filter("(fact = 'function' and owner = '') or fact in ('method', 'class')").select("path", "ord", "fact", "name", F.col("owner").alias("within"), qualified.alias("owner"), "line")
    own = linking.first_by(own, ["path", "fact", "owner"], ["ord"]).join(lists, ["path", "owner"], "left").join(returns, ["path", "owner"], "left").join(static, ["path", "owner"], "left")
    kept = F.when((F.col("fact") == "method") & ~F.coalesce("static", F.lit(False)), F.slice("params", 2, 1 << 20)).otherwise(F.col("params"))
    kind = F.initcap("fact")
    others = own.select(
        F.xxhash64(kind, F.col("path"), F.col("owner")).alias("node_id"), kind.alias("kind"), "name", F.col("path").alias("file"), "line", F.when(F.col("fact") == "method", node_id("Class", F.col("path"), F.col("within"))).alias("class_id"),
        names.function_key(F.col("path"), F.col("owner")).alias("key"), kept.alias("params"), "result",
    )
    files = modules.select(node_id("Module", F.col("path")).alias("node_id"), F.lit("Module").alias("kind"), F.col("path").alias("name"), F.col("path").alias("file"), F.lit(0).alias("line"))
    return others.unionByName(files, allowMissingColumns=True)


def build(files: DataFrame, entry: str, root: str = "", max_depth: int | None = None, strict: bool = False, catalogue: DataFrame | None = None) -> Graph:
    """The graph of an application: what its entry point reaches."""
    spark = files.sparkSession
    all_facts = materialize(python_source.extract(files), "facts")
    there, imports = reached(all_facts, files, entry, root, max_depth, strict)
    facts = materialize(all_facts.join(there.select("path"), "path", "left_semi"), "facts")
    models = materialize(python_source.models(facts), "models")
    fields = materialize(python_source.model_fields(facts), "model-fields")
    defined = materialize(definitions(facts, models, there), "definitions")
    functions = defined.filter("kind in ('Function', 'Method')").select("file", F.element_at(F.split("key", "::"), -1).alias("name"), "node_id")
    module = node_id("Module", F.col("path"))
    each_name = imports.join(imports_of(facts).select("path", "ord", "module", "name"), ["path", "ord", "module"])  # an edge for each imported name
    import_edges = each_name.join(there.select("path"), "path").join(there.select(F.col("path").alias("resolved")), "resolved").select(module.alias("src"), node_id("Module", F.col("resolved")).alias("dst"), F.col("ord").cast("long").alias("edge_id"), F.lit("Import").alias("kind"), F.lit(None).cast("string").alias("transformation"))
    # Calls: the caller by the definitions around it, the callee by its name.
    call_id = F.concat_ws("|", "path", "ord")
    calls = materialize(facts.filter("fact = 'call'").select(call_id.alias("call_id"), F.col("path").alias("file"), "ord", "owner", F.col("name").alias("callee"), annotations.transformation(F.col("name")).alias("t")), "calls")
    in_module = calls.filter("owner = ''").select("call_id", node_id("Module", F.col("file")).alias("src"))
    in_function = linking.resolve_by_name(calls.filter("owner <> ''").select("call_id", "file", F.col("owner").alias("callee")), functions, defined).withColumnRenamed("node_id", "src")
    callers = materialize(in_module.unionByName(in_function).join(calls.select("call_id", "ord", "t"), "call_id"), "callers")
    callees = linking.resolve_by_name(calls.filter("t is null").select("call_id", "file", "callee"), functions, defined)
    none = F.lit(None).cast("string")
    call_edges = callers.join(callees.withColumnRenamed("node_id", "dst"), "call_id").select("src", "dst", F.col("ord").cast("long").alias("edge_id"), F.lit("Call").alias("kind"), none.alias("transformation"))
    flow = callers.filter("t is not null").select("src", F.col("src").alias("dst"), F.col("ord").cast("long").alias("edge_id"), F.lit("DataFlow").alias("kind"), annotations.transformation_type(F.col("t.method")).alias("transformation"))
    routes, route_edges = routes_of(facts, defined, functions, models)
    late = orm_edges(facts, defined, fields)
    nodes = defined.withColumns({"method": none, "route": none, "handler_id": F.lit(None).cast("long"), "request": none, "response": none, "response_missing": F.lit(False)}).unionByName(routes, allowMissingColumns=True)
    edges = import_edges.unionByName(call_edges).unionByName(flow).unionByName(route_edges).unionByName(late)
    virtual = python_routers(facts, entry, catalogue if catalogue is not None else router_catalogue(spark))
    placed = virtual.select(node_id("Function", F.lit(entry), F.concat_ws(" ", "method", "route")).alias("handler_id"), node_id("Route", F.lit(entry), F.col("method"), F.col("route"), F.col("ord"), F.col("k")).alias("node_id"), "method", "route")
    holders = placed.select(F.col("handler_id").alias("node_id"), F.lit("Function").alias("kind"), F.concat_ws(" ", F.initcap("method"), "route").alias("name"), F.lit(entry).alias("file"), F.lit(0).alias("line")).distinct()
    nodes = nodes.unionByName(placed.select("node_id", F.lit("Route").alias("kind"), F.col("route").alias("name"), F.lit(entry).alias("file"), F.lit(0).alias("line"), "method", "route", "handler_id"), allowMissingColumns=True).unionByName(holders, allowMissingColumns=True)
    edges = edges.unionByName(placed.select(F.col("node_id").alias("src"), F.col("handler_id").alias("dst"), F.lit(0).cast("long").alias("edge_id"), F.lit("Call").alias("kind"), none.alias("transformation")))
    return Graph(materialize(nodes, "nodes"), materialize(edges, "graph-edges"), fields)


def routes_of(facts: DataFrame, defined: DataFrame, functions: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Route nodes and their edges to handlers.  The request is the first body parameter's model, the response that of response_model, else of the handler's result."""
    found = python_source.routes(facts).select(F.concat_ws("|", "path", "ord").alias("call_id"), F.col("path").alias("file"), "ord", "line", "method", "route", F.col("handler").alias("callee"), "response_model")
    handlers = linking.resolve_calls(found.select("call_id", "file", "callee"), functions)
    simple = linking.resolve_calls(found.join(handlers, "call_id", "left_anti").select("call_id", "file", names.last_part(F.col("callee")).alias("callee")), functions)
    with_handler = found.join(handlers.unionByName(simple).withColumnRenamed("node_id", "handler_id"), "call_id").join(defined.select(F.col("node_id").alias("handler_id"), "params", "result"), "handler_id")
    body = F.get(F.filter("params", lambda p: annotations.is_body_parameter(p["name"], p["model"], p["is_model"])), 0)["model"]
    rows = with_handler.withColumns({"request": body, "key": F.lower(annotations.base_model(F.col("response_model")))}).join(_known_models(models), "key", "left")
    named = F.when(F.array_contains("all", annotations.base_model(F.col("response_model"))), annotations.base_model(F.col("response_model")))
    returned = F.when(F.col("result.missing"), "Object").when(F.col("result.is_model"), F.col("result.model"))
    told = F.col("response_model").isNotNull()
    rows = rows.withColumns({"response": F.when(told, named).otherwise(returned), "response_missing": ~told & F.coalesce("result.missing", F.lit(False))})
    rows = rows.withColumn("node_id", node_id("Route", F.col("file"), F.col("method"), F.col("route"), F.col("ord")))
    nodes = rows.select("node_id", F.lit("Route").alias("kind"), F.col("route").alias("name"), "file", "line", "method", "route", "handler_id", "request", "response", "response_missing")
    edges = rows.select(F.col("node_id").alias("src"), F.col("handler_id").alias("dst"), F.col("ord").cast("long").alias("edge_id"), F.lit("Call").alias("kind"), F.lit(None).cast("string").alias("transformation"))
    return nodes, edges


def enrich(g: Graph, endpoints: DataFrame) -> Graph:
    """The graph with what a spec tells (path, method, operation_id, response): results of handlers whose route it has, and a route for each operation that no
    route stands for, with the function of the operation's name, or one in its place, as handler and no edge to it."""
    spec = endpoints.select("path", names.verb_of(F.col("method")).alias("method"), "operation_id", F.col("response").alias("told")).filter("method is not null")
    spec = linking.first_by(spec, ["path", "method"], ["operation_id", "told"])
    routes = g.nodes.filter("kind = 'Route'").select(F.col("route").alias("path"), "method", "handler_id")
    told = routes.join(spec.filter("told is not null"), ["path", "method"]).groupBy(F.col("handler_id").alias("node_id")).agg(F.min("told").alias("told"))
    result = F.when(F.col("told").isNotNull(), F.struct(F.col("told").alias("model"), F.lit(True).alias("is_model"), F.lit(False).alias("missing"))).otherwise(F.col("result"))
    nodes = g.nodes.join(told, "node_id", "left").withColumn("result", result).drop("told")
    gone = spec.filter("operation_id is not null").join(routes, ["path", "method"], "left_anti").withColumn("name", names.handler_of_operation(F.col("operation_id")))
    functions = g.nodes.filter("kind = 'Function'").groupBy("name").agg(F.min("node_id").alias("found"))
    virtual = gone.join(functions, "name", "left").withColumn("handler_id", F.coalesce("found", node_id("Function", F.lit("spec"), F.col("name"))))
    holders = virtual.filter("found is null").select(F.col("handler_id").alias("node_id"), F.lit("Function").alias("kind"), "name", F.lit("").alias("file"), F.lit(0).alias("line")).distinct()
    made = virtual.select(node_id("Route", F.lit("spec"), F.col("method"), F.col("path")).alias("node_id"), F.lit("Route").alias("kind"), F.col("path").alias("name"), F.lit("").alias("file"), F.lit(0).alias("line"), "method", F.col("path").alias("route"), "handler_id", F.lit(False).alias("response_missing"))
    nodes = nodes.unionByName(holders, allowMissingColumns=True).unionByName(made, allowMissingColumns=True)
    return Graph(materialize(nodes, "nodes"), g.edges, g.fields, g.schema_type)


def orm_edges(facts: DataFrame, defined: DataFrame, fields: DataFrame) -> DataFrame:
    """Data flow in both directions between a model that is made from attributes and the mapped class that fits it best."""
    made = python_source.from_attributes(facts)
    mapped = python_source.orm_fields(facts)
    orm_classes = facts.filter("fact = 'class' and owner = ''").select("name", F.split("detail", ",").alias("bases"))
    orm_names = orm_classes.filter(annotations.is_orm_class(F.col("bases"), F.array().cast("array<string>"))).select("name").unionByName(mapped.select("name")).distinct()
    side = lambda df, kind, flag: df.select(F.col("name").alias("model_id"), "name", F.lit(kind).alias("kind"), F.lit(flag).alias("from_attributes"))
    p = side(made, "Pydantic", True).join(fields.select("name", "field", F.col("type_name").alias("field_type"), "optional"), "name", "left")
    o = side(orm_names, "OrmModel", False).join(mapped.select("name", "field", F.col("type_name").alias("field_type"), F.col("nullable").alias("optional")), "name", "left")
    best = linking.link_models(p.unionByName(o.select(*p.columns)))
    classes = defined.filter("kind = 'Class'").groupBy("name").agg(F.min_by("node_id", "file").alias("node_id"))
    both = best.join(classes.select(F.col("name").alias("model_id"), F.col("node_id").alias("a")), "model_id").join(classes.select(F.col("name").alias("orm_id"), F.col("node_id").alias("b")), "orm_id")
    there = both.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(LATE).cast("long").alias("edge_id"), F.lit("DataFlow").alias("kind"), F.lit("FromAttributes").alias("transformation"))
    back = both.select(F.col("b").alias("src"), F.col("a").alias("dst"), F.lit(LATE + 1).cast("long").alias("edge_id"), F.lit("DataFlow").alias("kind"), F.lit("OrmToPydantic").alias("transformation"))
    return there.unionByName(back)


# Dynamic routes ---------------------------------------------------------------------------------------------------------------------------------

#: Constants of libraries that prefixes are made of (fixed values).
CONSTANTS = {"AUTH_URL_PATH": "/auth", "USERS_URL_PATH": "/users", "REGISTER_URL_PATH": "/register", "VERIFY_URL_PATH": "/verify", "RESET_PASSWORD_URL_PATH": "/reset-password"}
_PARTS = "array<array<string>>"


def text_values(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (path, ord, extra: JSON parts) with ``value``: variables are replaced by the first assignment of the name in the file, over any number of
    steps; those that go round or aren't texts by a known constant, else by their name in braces."""
    assigned = linking.first_by(facts.filter("fact = 'assign'"), ["path", "name"], ["ord"]).select("path", F.col("name").alias("variable"), F.from_json("extra", _PARTS).alias("known"))
    known = assigned.filter("known is not null")
    constant = F.element_at(F.create_map(*(F.lit(x) for kv in CONSTANTS.items() for x in kv)), F.col("text"))
    # One row for each part; ``trail`` is the place of the part, as a variable may become several.
    open_ = asked.filter("extra <> ''").select("path", "ord", F.posexplode(F.from_json("extra", _PARTS)).alias("k", "p")).select("path", "ord", F.array("k").alias("trail"), F.get("p", 0).alias("kind"), F.get("p", 1).alias("text"), F.array().cast("array<string>").alias("seen"))
    done = None
    while True:
        level = materialize(open_.join(known, (open_["path"] == known["path"]) & (F.col("kind") == "1") & (F.col("text") == F.col("variable")) & ~F.array_contains("seen", F.col("text")), "left").select(open_["path"], "ord", "trail", "kind", "text", "seen", "known"), "texts")
        plain = level.filter("known is null").select("path", "ord", "trail", F.when(F.col("kind") == "0", F.col("text")).otherwise(F.coalesce(constant, F.concat(F.lit("{"), "text", F.lit("}")))).alias("text"))
        done = plain if done is None else done.unionByName(plain)
        open_ = level.filter("known is not null").select("path", "ord", "trail", "text", "seen", F.posexplode("known").alias("k", "p")).select("path", "ord", F.array_append("trail", F.col("k")).alias("trail"), F.get("p", 0).alias("kind"), F.get("p", 1).alias("text"), F.array_append("seen", F.col("text")).alias("seen"))
        if open_.isEmpty():
            break
    joined = done.groupBy("path", "ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("trail", "text"))), lambda x: x["text"]), "").alias("value"))
    return asked.join(joined, ["path", "ord"], "left")


_CATALOGUE = "generator string, ord int, method string, path string, request_arg int, response_arg int, module string, source int"
_generators: dict[str, list[tuple]] = {}


def register_generator(generator: str, endpoints: list[tuple[str, str, int | None, int | None]], module: str = "") -> None:
    """A router generator of one's own: its endpoints as (method, path, place of the request argument, place of the response argument)."""
    _generators[generator] = [(generator, k, *e, module, 1) for k, e in enumerate(endpoints)]


def router_catalogue(spark: SparkSession, declared: dict | None = None) -> DataFrame:
    """The built-in router generators, registered ones and those that a configuration declares; the latter come before the others.

    A declared endpoint without a place for a schema takes argument 0 for the response and 1 for the request, if the declaration lists that schema."""
    rows = [r for mine in _generators.values() for r in mine]
    for g in (declared or {}).get("generators", []):
        schemas = g.get("schema_params", [])
        place = lambda e, key, at, listed=schemas: e.get(f"{key}_param", at if key in listed else None)
        rows += [(g["method"], k, e.get("method", "GET"), e["path"], place(e, "request_schema", 1), place(e, "response_schema", 0), g.get("module", ""), 0) for k, e in enumerate(g.get("endpoints", []))]
    built_in = literal(spark, "router_catalog").withColumns({"module": F.lit(""), "source": F.lit(2)})
    return built_in.unionByName(spark.createDataFrame(rows, _CATALOGUE)) if rows else built_in


def python_routers(facts: DataFrame, entry: str, catalogue: DataFrame) -> DataFrame:
    """(ord, k, method, route, request, response) of the routers that the entry file includes or makes by themselves.

    A router inside include_router has that call's prefix, one by itself the first prefix of the file.  ``catalogue``: as ``router_catalogue`` makes it; a
    generator is known by get_<generator>_router, or by its whole name, and by a part of what it is called on.  Verbs that aren't known count as GET."""
    here = facts.filter((F.col("path") == entry) & F.col("fact").isin("include_router", "plain_call"))
    valued = materialize(text_values(facts, here.select("path", "ord", "fact", "name", "detail", "extra")), "routers")
    first = valued.filter("fact = 'include_router' and extra <> ''").agg(F.min_by("value", "ord").alias("first"))
    method, base = names.last_part(F.col("name")), F.regexp_extract("name", r"^(.*)\.[^.]*$", 1)
    keys = F.array_distinct(F.array(method, F.coalesce(F.nullif(F.regexp_extract(method, "^get_(.*)_router$", 1), F.lit("")), method)))
    calls = valued.filter("name like '%.%'").withColumn("one", F.lit(1)).join(first.withColumn("one", F.lit(1)), "one").select("ord", base.alias("base"), F.explode(keys).alias("generator"), F.coalesce(F.when(F.col("fact") == "include_router", F.col("value")).otherwise(F.col("first")), F.lit("")).alias("prefix"), F.col("detail").alias("args"))
    verbs = catalogue.withColumn("method", F.coalesce(names.verb_of(F.col("method")), F.lit("GET"))).withColumnRenamed("ord", "k")
    fits = calls.join(verbs, "generator").filter(F.contains("base", "module"))
    best = fits.groupBy("ord").agg(F.min("source").alias("source"))
    args = F.split("args", ",")
    arg = lambda c: F.nullif(F.get(args, F.col(c)), F.lit(""))
    return fits.join(best, ["ord", "source"]).select("ord", "k", "method", F.concat("prefix", "path").alias("route"), arg("request_arg").alias("request"), arg("response_arg").alias("response"))


# Chains and contracts ----------------------------------------------------------------------------------------------------------------------------


def with_schemas(nodes: DataFrame, schema_type: str = "Pydantic", forward: bool = True) -> DataFrame:
    """Each node with what a link shows of it: id, schema, schema_type, missing, file, line; modules have none.

    A route shows its request before its response (the other way round against the edges), else what its handler shows; a function its first parameter that
    names a model or has the type of an object or array, else its own name."""
    param = F.get(F.filter("params", lambda p: p["is_model"] | p["missing"] | p["base"].isin("Object", "Array")), 0)
    schema = F.when(param["missing"], "Object").when(param["is_model"], param["model"]).when(param.isNotNull(), param["base"]).otherwise(F.col("name"))
    of = F.when(param["is_model"] & ~param["missing"], schema_type).otherwise("JsonSchema")
    own = nodes.select("node_id", "kind", "name", "file", "line", "class_id", "route", "handler_id", "request", "response", "response_missing", schema.alias("schema"), of.alias("of"), F.coalesce(param["missing"], F.lit(False)).alias("missing"))
    handler = own.filter("kind = 'Function'").select(F.col("node_id").alias("handler_id"), F.col("schema").alias("h_schema"), F.col("of").alias("h_of"), F.col("missing").alias("h_missing"))
    classes = own.filter("kind = 'Class'").select(F.col("node_id").alias("class_id"), F.col("file").alias("class_file"))
    j = own.join(handler, "handler_id", "left").join(classes, "class_id", "left")
    told = F.coalesce("request", "response") if forward else F.coalesce("response", "request")
    gone = (told == F.col("response")) & F.coalesce("response_missing", F.lit(False))
    route = F.col("kind") == "Route"
    label = F.when(route, F.concat(F.lit("route-"), F.replace("route", F.lit("/"), F.lit("-")))).otherwise(F.concat_ws("-", F.element_at(F.create_map(*(F.lit(x) for x in ("Function", "func", "Method", "method", "Class", "class", "Schema", "schema"))), F.col("kind")), "name"))
    return j.filter("kind <> 'Module'").select(
        "node_id", "kind", "name", label.alias("id"),
        F.when(route, F.coalesce(told, "h_schema", F.lit("RouteRequest"))).when(F.col("kind") == "Class", F.col("name")).otherwise(F.col("schema")).alias("schema"),
        F.when(route & gone, "JsonSchema").when(route & told.isNotNull(), F.lit(schema_type)).when(route, F.coalesce("h_of", F.lit("JsonSchema"))).when(F.col("kind") == "Class", "JsonSchema").otherwise(F.col("of")).alias("schema_type"),
        F.when(route & gone, F.lit(True)).when(route & told.isNull(), F.coalesce("h_missing", F.lit(False))).when(F.col("kind").isin("Function", "Method"), F.col("missing")).otherwise(F.lit(False)).alias("missing"),
        F.coalesce("class_file", "file").alias("file"), F.when(F.col("kind").isin("Class", "Method"), 0).otherwise(F.col("line")).alias("line"),
    )


def chains(g: Graph, forward: bool = True) -> DataFrame:
    """Links (chain_id, name, pos, node_id, id, link_type, schema, schema_type, missing, file, line, transformation) of the chains of all routes.

    A chain that comes to a module is left out.  A link carries the transformation of the first data flow between it and the link before it, along the chain's
    direction or else against it."""
    starts = g.nodes.filter("kind = 'Route'").select("node_id")
    edges = g.edges if forward else g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_id", "kind", "transformation")
    walks = graph.greedy_walk(starts, edges.select("src", "dst", "edge_id"))
    if not forward:
        walks = walks.select("start", F.reverse("path").alias("path"))
    shown = with_schemas(g.nodes, g.schema_type, forward)
    links = graph.links_of(g.nodes, walks).join(shown.drop("kind", "name"), "node_id", "left")
    broken = links.filter("id is null").select("start").distinct()
    links = links.join(broken, "start", "left_anti")
    flow = g.edges.filter("kind = 'DataFlow' and transformation is not null and src <> dst").groupBy("src", "dst").agg(F.min_by("transformation", "edge_id").alias("t"))
    pairs = graph.contracts_of_links(walks).join(flow.toDF("from_node", "to_node", "along"), ["from_node", "to_node"], "left").join(flow.toDF("to_node", "from_node", "against"), ["from_node", "to_node"], "left")
    first, second = ("along", "against") if forward else ("against", "along")
    moved = pairs.select("start", (F.col("pos") + 1).alias("pos"), F.coalesce(first, second).alias("transformation"))
    named = g.nodes.filter("kind = 'Route'").select(F.col("node_id").alias("start"), F.concat_ws(" ", "method", "route").alias("name"))
    return links.join(moved, ["start", "pos"], "left").join(named, "start").select(F.concat(F.lit("fwd-" if forward else "rev-"), F.col("start").cast("string")).alias("chain_id"), "name", "pos", "node_id", "id", "link_type", "schema", "schema_type", "missing", "file", "line", "transformation")


def link_contracts(links: DataFrame) -> DataFrame:
    """(chain_id, pos, from_schema, from_type, from_missing, to_schema, to_type, to_missing, transformation) between neighbours."""
    a = links.select("chain_id", "pos", F.col("schema").alias("from_schema"), F.col("schema_type").alias("from_type"), F.col("missing").alias("from_missing"))
    b = links.select("chain_id", (F.col("pos") - 1).alias("pos"), F.col("schema").alias("to_schema"), F.col("schema_type").alias("to_type"), F.col("missing").alias("to_missing"), "transformation")
    return a.join(b, ["chain_id", "pos"])


def check(g: Graph, found: DataFrame, more_rules: tuple = ()) -> DataFrame:
    """(chain_id, pos, mismatch_type, path, level, message): the rules on the contracts of chains, run once for each pair of schemas.

    Only models have fields; a pair with a side of another kind is checked for missing schemas alone.  ``more_rules``: functions of the pairs, the
    schemas and their fields that give rows of (from_no, to_no, mismatch_type, path, level, message)."""
    key = lambda side: F.concat_ws("|", f"{side}_type", f"{side}_schema", F.col(f"{side}_missing").cast("string"))
    keyed = found.withColumns({"from_no": key("from"), "to_no": key("to")})
    sides = keyed.select(F.col("from_no").alias("schema_no"), F.col("from_schema").alias("name"), F.col("from_type").alias("schema_type"), F.col("from_missing").alias("missing")).unionByName(keyed.select(F.col("to_no").alias("schema_no"), F.col("to_schema").alias("name"), F.col("to_type").alias("schema_type"), F.col("to_missing").alias("missing"))).distinct()
    text = g.fields.groupBy("name").agg(F.concat_ws(",", F.collect_list(F.concat_ws(":", "field", F.regexp_replace("type_name", "[,:]", ";"), F.when(F.col("optional"), "optional").otherwise("required")))).alias("fields"))
    schemas = materialize(sides.join(text, "name", "left").withColumn("fields", F.when(F.col("schema_type") == g.schema_type, F.coalesce("fields", F.lit(""))).otherwise("")), "schemas")
    bounds = g.fields.select("name", "field", F.explode(F.from_json("constraints", "array<array<string>>")).alias("c")).select("name", "field", F.get("c", 0).alias("kind"))
    limits = schemas.filter(F.col("schema_type") == g.schema_type).join(bounds, "name").select("schema_no", "field", "kind")
    pairs = materialize(keyed.select("from_no", "to_no").distinct(), "pairs")
    parsed = schemas.filter((F.col("schema_type") == g.schema_type) & (F.col("fields") != "")).select("schema_no")
    both = pairs.join(parsed.withColumnRenamed("schema_no", "from_no"), "from_no").join(parsed.withColumnRenamed("schema_no", "to_no"), "to_no")
    fields = contracts.parse_fields(schemas)
    rows = contracts.type_mismatch(both, fields).unionByName(contracts.missing_field(both, fields)).unionByName(contracts.unnormalized(both, fields, limits)).unionByName(contracts.missing_schema(pairs, schemas))
    for rule in (*contracts.more_rules(), *more_rules):
        rows = rows.unionByName(rule(pairs, schemas, fields))
    return keyed.select("chain_id", "pos", "from_no", "to_no").join(rows, ["from_no", "to_no"]).select("chain_id", "pos", "mismatch_type", "path", "level", "message")


def report(found: DataFrame, mismatches: DataFrame) -> DataFrame:
    """(chain_id, pos, severity, mismatches) of every contract."""
    worst = mismatches.groupBy("chain_id", "pos").agg(F.bool_or(F.col("mismatch_type") == "TypeMismatch").alias("types"), F.count("*").alias("n"))
    severity = F.when(F.col("types"), "Critical").when(F.col("n") > 0, "Warning").otherwise("Info")
    return found.select("chain_id", "pos").join(worst, ["chain_id", "pos"], "left").select("chain_id", "pos", severity.alias("severity"), F.coalesce("n", F.lit(0)).alias("mismatches"))


# Example ------------------------------------------------------------------------------------------------------------------------------------------

#: A small application: orders with a table, models in a package, a router that a library makes.
EXAMPLE = {
    "shop/main.py": """from fastapi import FastAPI, Depends
import logging
from .models import OrderIn, OrderOut
from shop.store import tables
from services import pricing

PREFIX = "/v1"
ACCOUNTS = f"{PREFIX}/accounts"
app = FastAPI()
log = logging.getLogger("shop")


def session():
    yield connect()


@app.post("/orders", response_model=OrderOut)
async def add_order(order: OrderIn, db: Session = Depends(session)) -> OrderOut:
    row = Order(order.title)
    check(order)
    return OrderOut.model_validate(row)


@app.get("/orders/{order_id}")
def get_order(order_id: int) -> Optional[orderout]:
    return find(order_id)


@app.get("/raw")
def raw(payload: dict[str, Any]):
    return pricing.total(payload)


class Admin:
    @router.delete("/orders/{order_id}")
    def drop(self, order_id: int):
        return find(order_id)


def check(order: OrderIn):
    return total(order.dict())


app.include_router(users.get_register_router(OrderOut, OrderIn), prefix=ACCOUNTS)
app.include_router(users.get_verify_router(OrderOut), prefix=f"{AUTH_URL_PATH}{WHO}")
users.get_reset_router()
""",
    "shop/models/__init__.py": """from pydantic import BaseModel, Field
from typing import Optional


class OrderBase(BaseModel):
    title: str = Field(min_length=1)
    note: Optional[str] = None


class OrderIn(OrderBase):
    amount: str


class OrderOut(OrderBase):
    id: int
    amount: float
    model_config = {"from_attributes": True}
""",
    "shop/store/tables.py": """from sqlalchemy.orm import Mapped, DeclarativeBase


class Order(Base):
    __tablename__: Mapped[str] = "orders"
    id: Mapped[int]
    title: Mapped[str]
    note: Mapped[Optional[str]]


def find(key: int):
    return Order.get(key)
""",
    "shop/store/__init__.py": "",
    "services/pricing.py": """def total(order: OrderOut) -> float:
    return order.amount
""",
    "services/unused.py": "def total(x): return 1\n",
}


def example(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EXAMPLE.items()), "path string, content string")


_graphs: dict[str, Graph] = {}


def _graph(spark: SparkSession) -> Graph:
    """The example's graph, built once for an application."""
    at = spark.sparkContext.applicationId
    if at not in _graphs:
        _graphs[at] = build(example(spark), "shop/main.py")
    return _graphs[at]


def _short(nodes: DataFrame, column: str, as_: str) -> DataFrame:
    return nodes.select(F.col("node_id").alias(column), F.concat_ws(" ", "kind", F.coalesce("method", F.lit("")), "name").alias(as_))


def node_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark)
    return g.nodes.select("kind", "name", "file", "line", "method", "request", "response")


def edge_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark)
    return g.edges.join(_short(g.nodes, "src", "source"), "src").join(_short(g.nodes, "dst", "target"), "dst").select("source", "target", "kind", "transformation").distinct()


def chain_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions of the chains of all routes, as texts."""
    g = _graph(spark)
    links = chains(g).unionByName(chains(g, forward=False))
    one = F.struct("pos", F.concat_ws(" ", "link_type", "id", "schema", "schema_type").alias("t"))
    return links.groupBy("chain_id", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), " > ").alias("path")).select(F.substring("chain_id", 1, 3).alias("direction"), "name", "path")


def check_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark)
    links = materialize(chains(g), "links")
    rows = check(g, link_contracts(links))
    return rows.join(links.select("chain_id", "name").distinct(), "chain_id").select("name", "pos", "mismatch_type", "path", "level", "message")


def report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark)
    links = materialize(chains(g), "links")
    found = materialize(link_contracts(links), "contracts")
    return report(found, check(g, found)).join(links.select("chain_id", "name").distinct(), "chain_id").select("name", "pos", "severity", "mismatches")


def enrich_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The example's routes with a spec that has one of them, one of a known handler and one of none."""
    endpoints = spark.sql("SELECT * FROM (VALUES ('/orders', 'post', 'add', 'OrderOut'), ('/found', 'get', 'main:find', NULL), ('/new', 'put', 'put_new', 'New'), ('/t', 'trace', 't', NULL), ('/silent', 'get', NULL, 'X')) AS t(path, method, operation_id, response)")
    g = enrich(_graph(spark), endpoints)
    handlers = g.nodes.select(F.col("node_id").alias("handler_id"), F.col("name").alias("handler"), F.col("file").alias("handler_file"), "result.model")
    return g.nodes.filter("kind = 'Route' and (file = '' or route = '/orders')").drop("result").join(handlers, "handler_id").select("method", "route", "handler", "handler_file", "model")


def reach_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = example(spark)
    return reached(python_source.extract(files), files, "shop/main.py")[0]


def field_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return python_source.model_fields(python_source.extract(example(spark))).select("name", "field", "type_name", "inner_type", "optional")


def mapped_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return python_source.orm_fields(python_source.extract(example(spark)))


def router_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return python_routers(python_source.extract(example(spark)), "shop/main.py", router_catalogue(spark)).select("method", "route", "request", "response")


QUERIES = {
    "python_reached_files": reach_query,
    "python_model_fields": field_query,
    "python_mapped_fields": mapped_query,
    "python_dynamic_routes": router_query,
    "python_graph_nodes": node_query,
    "python_graph_edges": edge_query,
    "python_chains": chain_query,
    "python_mismatches": check_query,
    "python_contract_report": report_query,
    "python_spec_routes": enrich_query,
}
_MAIN, _MODELS, _TABLES = "shop/main.py", "shop/models/__init__.py", "shop/store/tables.py"
_MADE = ("/register", "/auth{WHO}/forgot-password", "/auth{WHO}/reset-password", "/auth{WHO}/request-verify-token", "/auth{WHO}/verify")


def _values(rows: list[tuple], columns: str) -> str:
    """Expected rows, worked out by hand from how the analysed tool behaves."""
    shown = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows) + f") AS t({columns})"


_SOURCES = {
    "POST /orders": ["route--orders OrderIn Pydantic", "func-add_order OrderIn Pydantic", "func-check OrderIn Pydantic"],
    "GET /orders/{order_id}": ["route--orders-{order_id} OrderOut Pydantic", "func-get_order get_order JsonSchema", "func-find find JsonSchema"],
    "GET /raw": ["route--raw Object JsonSchema", "func-raw Object JsonSchema"],
    "DELETE /orders/{order_id}": ["route--orders-{order_id} RouteRequest JsonSchema", "method-drop drop JsonSchema", "func-find find JsonSchema"],
} | {f"POST {r}": [f"route-{r.replace('/', '-')} Post {r} JsonSchema", f"func-Post {r} Post {r} JsonSchema"] for r in _MADE}


def _chain(links: list[str]) -> str:
    kinds = ["Source", *["Transformer"] * (len(links) - 2), "Sink"]
    return " > ".join(f"{k} {x}" for k, x in zip(kinds, links, strict=True))


ORACLE_SQL = {
    "python_reached_files": _values([(_MAIN, 0), (_MODELS, 1), ("shop/store/__init__.py", 1), (_TABLES, 1)], "path, depth"),
    "python_model_fields": _values([(m, f, t, None, o) for m, fields in (("OrderBase", ""), ("OrderIn", "amount:str"), ("OrderOut", "id:int amount:float")) for f, t, o in (("title", "str", False), ("note", "str", True), *((*x.split(":"), False) for x in fields.split()))], "name, field, type_name, inner_type, optional"),
    "python_mapped_fields": _values([("Order", "id", "int", False), ("Order", "title", "str", False), ("Order", "note", "str", True)], "name, field, type_name, nullable"),
    "python_dynamic_routes": _values([("POST", r, "OrderIn" if k == 0 else None, "OrderOut" if k in (0, 4) else None) for k, r in enumerate(_MADE)], "method, route, request, response"),
    "python_graph_nodes": _values(
        [("Module", f, f, 0, None, None, None) for f in (_MAIN, _MODELS, _TABLES, "shop/store/__init__.py")]
        + [("Class", n, f, k, None, None, None) for n, f, k in (("Admin", _MAIN, 34), ("Order", _TABLES, 4), ("OrderBase", _MODELS, 5), ("OrderIn", _MODELS, 10), ("OrderOut", _MODELS, 14))]
        + [("Function", n, f, k, None, None, None) for n, f, k in (("session", _MAIN, 13), ("add_order", _MAIN, 18), ("get_order", _MAIN, 25), ("raw", _MAIN, 30), ("check", _MAIN, 40), ("find", _TABLES, 11), *((f"Post {r}", _MAIN, 0) for r in _MADE))]
        + [("Method", "drop", _MAIN, 36, None, None, None)]
        + [("Route", "/orders", _MAIN, 17, "POST", "OrderIn", "OrderOut"), ("Route", "/orders/{order_id}", _MAIN, 24, "GET", None, "OrderOut"), ("Route", "/raw", _MAIN, 29, "GET", None, None), ("Route", "/orders/{order_id}", _MAIN, 35, "DELETE", None, None)]
        + [("Route", r, _MAIN, 0, "POST", None, None) for r in _MADE],
        "kind, name, file, line, method, request, response",
    ),
    "python_graph_edges": _values(
        [(f"Module  {_MAIN}", f"Module  {f}", "Import", None) for f in (_MODELS, "shop/store/__init__.py")]
        + [(f"Function  {a}", f"{b}", "Call", None) for a, b in (("add_order", "Class  Order"), ("add_order", "Function  check"), ("get_order", "Function  find"))]
        + [("Function  add_order", "Function  add_order", "DataFlow", "ValidateData"), ("Function  check", "Function  check", "DataFlow", "ToDict"), ("Method  drop", "Function  find", "Call", None)]
        + [("Class  Order", "Class  OrderOut", "DataFlow", "OrmToPydantic"), ("Class  OrderOut", "Class  Order", "DataFlow", "FromAttributes")]
        + [(f"Route {a}", f"{b}", "Call", None) for a, b in (("POST /orders", "Function  add_order"), ("GET /orders/{order_id}", "Function  get_order"), ("GET /raw", "Function  raw"), ("DELETE /orders/{order_id}", "Method  drop"), *((f"POST {r}", f"Function  Post {r}") for r in _MADE))],
        "source, target, kind, transformation",
    ),
    "python_chains": _values([("fwd", n, _chain(x)) for n, x in _SOURCES.items()] + [("rev", n, "Source " + x[0].replace("OrderIn", "OrderOut")) for n, x in _SOURCES.items()], "direction, name, path"),
    "python_spec_routes": _values([("POST", "/orders", "add_order", _MAIN, "OrderOut"), ("GET", "/found", "find", _TABLES, None), ("PUT", "/new", "put_new", "", None)], "method, route, handler, handler_file, model"),
    "python_mismatches": _values([("GET /raw", 0, "MissingSchema", "", level, f"{side} schema 'Object' is missing validation schema (dict[str, Any] or any)") for side, level in (("Source", "Critical"), ("Target", "High"))], "name, pos, mismatch_type, path, level, message"),
    "python_contract_report": _values([(n, k, "Warning" if n == "GET /raw" else "Info", 2 if n == "GET /raw" else 0) for n, x in _SOURCES.items() for k in range(len(x) - 1)], "name, pos, severity, mismatches"),
}
