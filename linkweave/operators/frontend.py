"""Front-end projects: imports to files, calls to functions, generated clients, service files, routes of API calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkweave.functions import frontend, names
from linkweave.operators.linking import first_by
from linkweave.plans.fixtures import ctes, grown, literal, rows_added
from linkweave.session import materialize, table

#: Deepest chain of re-exports that is followed (fixed value).
MAX_REEXPORTS = 10
#: Verbs that a client's body is searched for, the first that fits a line counts (fixed value).
CLIENT_VERBS = ("get", "post", "put", "delete", "patch")
#: Functions of a service file that are looked for, in this order (fixed value).
SERVICE_FUNCTIONS = ("api_handler", "handler", "service", "fetchData")


def mapped_imports(imports: DataFrame, mappings: DataFrame, root: str) -> DataFrame:
    """(import_id, target) by the first path mapping (ord, pattern, target) that an import falls under.

    An import meets mappings by its own prefixes, so this is an equi join."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/*")))
    keyed = imports.select("import_id", "path", F.explode(F.array_append(F.when(F.size(parts) > 1, prefixes).otherwise(F.array().cast("array<string>")), F.col("path"))).alias("pattern"))
    found = first_by(keyed.join(mappings, "pattern"), "import_id", ["ord"])
    return found.select("import_id", frontend.apply_mapping(F.col("path"), F.col("pattern"), F.col("target"), F.lit(root)).alias("target"))


def resolve_imports(imports: DataFrame, files: DataFrame, mappings: DataFrame | None = None, root: str = "") -> DataFrame:
    """(import_id, file, path, resolved): the file of each import, null for modules from outside and for files that aren't there.

    Relative imports go from the importing file's folder; others by path mappings, if there are any.  Of the files that a target may be the first
    in the order of endings counts."""
    relative = imports.filter(F.col("path").startswith(".")).select("import_id", frontend.relative_target(F.col("file"), F.col("path")).alias("target"))
    targets = relative
    if mappings is not None:
        targets = targets.unionByName(mapped_imports(imports.filter(~F.col("path").startswith(".")), mappings, root))
    return imports.join(first_files(targets, files, ["import_id"]), "import_id", "left").select("import_id", "file", "path", "resolved")


def first_files(targets: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """(key, resolved): of the files that the key's ``target`` may be, the first in the order of endings that is there.

    Targets meet files by their forms without an ending, so a target is sent out twice or three times and not once for each ending."""
    there = files.select(frontend.without_ending(F.col("file")).alias("form"), F.col("file").alias("resolved"))
    forms = targets.withColumn("forms", frontend.candidate_forms(F.col("target"))).select(*targets.columns, F.explode_outer("forms").alias("form"))  # outer, as Spark would filter by the size of the forms, which works them out again
    met = forms.join(there, "form")
    rank = F.array_position(frontend.candidates(F.col("target")), F.col("resolved"))
    found = met.groupBy(*key).agg(F.min(F.when(rank > 0, F.struct(rank.alias("rank"), "resolved"))).alias("found"))
    return found.filter("found is not null").select(*key, "found.resolved")


def resolve_or_invent(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(call_id, node_id, virtual_name): the callee in the call's file, else the least of that name anywhere, else a virtual function of the call's file."""
    keyed = functions.select(F.element_at(F.split("name", "::"), -1).alias("callee"), F.col("file").alias("there"), "node_id")
    own = keyed.groupBy("callee", F.col("there").alias("file")).agg(F.min("node_id").alias("own"))
    anywhere = keyed.groupBy("callee").agg(F.min("node_id").alias("any"))
    found = calls.join(own, ["callee", "file"], "left").join(anywhere, "callee", "left").withColumn("node_id", F.coalesce("own", "any"))
    return found.select("call_id", "node_id", F.when(F.col("node_id").isNull(), names.function_key(F.col("file"), F.col("callee"))).alias("virtual_name"))


def first_definitions(definitions: DataFrame, key: list[str]) -> DataFrame:
    """The first definition of each key: later ones are taken for the same node (functions by file and name, classes by name, methods by class and name)."""
    return first_by(definitions, key, ["ord"])


def last_definition(definitions: DataFrame) -> DataFrame:
    """The function that a name in a file means: the last of that name."""
    return first_by(definitions, ["file", "name"], [F.desc("ord")])


def sdk_bodies(functions: DataFrame, sources: DataFrame) -> DataFrame:
    """(file, name, method, path): from each function's line on, the verb and address at the first line where both have been met.

    ``functions``: file, name, line; ``sources``: file, content.  The lines of a file are ordered once; each knows the last verb and address up to it and the
    next line with either, so functions are looked up and never compared with all lines."""
    lines = sources.select("file", F.posexplode(F.split("content", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    low = F.lower("text")
    verb = F.coalesce(*(F.when(low.rlike(rf"client\.{v}|\?\.{v}|\?\? client\)\.{v}"), v.upper()) for v in CLIENT_VERBS))
    after = F.expr("substring(text, instr(lower(text), 'url:') + 4)")
    double, single = F.regexp_extract(after, r"^[^\"]*\"([^\"]*)\"", 1), F.regexp_extract(after, r"^[^']*'([^']*)'", 1)
    url = F.when(low.contains("url:"), F.when(after.contains('"'), F.when(after.rlike(r"\"[^\"]*\""), double)).when(after.rlike("'[^']*'"), single))
    lines = lines.select("file", "line", verb.alias("verb"), url.alias("url"))
    before = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = Window.partitionBy("file").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = lambda c: F.last(F.when(F.col(c).isNotNull(), F.col("line")), ignorenulls=True).over(behind)
    lines = lines.select("file", "line", F.last("verb", ignorenulls=True).over(before).alias("method"), F.last("url", ignorenulls=True).over(before).alias("path"), place("verb").alias("v"), place("url").alias("u"))
    starts = functions.join(lines.select("file", "line", "v", "u"), ["file", "line"]).filter("v is not null and u is not null").select("file", "name", F.greatest("v", "u").alias("line"))
    return starts.join(lines.select("file", "line", "method", "path"), ["file", "line"]).select("file", "name", "method", "path")


def sdk_calls(functions: DataFrame, sources: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(name, method, path) of the functions of generated clients: by the spec's operation of that name, else by the function's body."""
    spec = first_by(endpoints.filter(F.col("operation_id").isNotNull() & names.verb_of(F.col("method")).isNotNull()), "operation_id", [F.desc("ord")])
    spec = spec.select(F.col("operation_id").alias("name"), F.upper("method").alias("spec_method"), F.col("path").alias("spec_path"))
    bodies = sdk_bodies(functions, sources)
    found = functions.select("file", "name").join(bodies, ["file", "name"], "left").join(spec, "name", "left")
    out = found.select("name", "file", F.coalesce("spec_method", "method").alias("method"), F.coalesce("spec_path", "path").alias("path"))
    return first_by(out.filter("method is not null"), "name", ["file"]).select("name", "method", "path")


def reexport_steps(starts: DataFrame, exports: DataFrame, files: DataFrame, most: int) -> DataFrame:
    """(folder, at, to, client): where the re-exports of a file lead to for starts of a folder, for all files within reach; ``client``: not gone through.

    A path depends on the start by its folder only, so it is resolved once for each folder and not once for each start and level."""
    frontier = materialize(starts.select(frontend.folder(F.col("file")).alias("folder"), F.col("file").alias("at")).distinct(), "reexport-places")
    seen, steps = frontier, None
    exports = exports.filter(F.col("path").startswith(".")).select(F.col("file").alias("at"), "path")
    for level in range(most):
        asked = frontier.join(exports if level else exports.hint("merge"), "at")  # later levels are mostly few files, that are sent to the exports and files
        asked = materialize(asked.select("folder", "at", frontend.target_from(F.col("folder"), F.col("path")).alias("target")), "reexport-targets")
        to = first_files(asked, files if level else files.hint("merge"), ["folder", "at", "target"]).select("folder", "at", F.col("resolved").alias("to"), frontend.is_sdk_file(F.col("resolved")).alias("client"))
        to = materialize(to, "reexport-steps")
        steps = to if steps is None else steps.unionByName(to)
        frontier = materialize(to.filter("not client").select("folder", F.col("to").alias("at")).distinct().join(seen.hint("merge"), ["folder", "at"], "left_anti"), "reexport-places")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return steps


def reexported(starts: DataFrame, exports: DataFrame, files: DataFrame, functions: DataFrame, most: int = MAX_REEXPORTS) -> DataFrame:
    """(file, name, source): functions of client files that reach ``file`` through ``export * from``, over at most ``most`` steps.

    ``starts``: file; ``exports``: file, path; ``functions``: file, name.  As the analysed tool does, every path on the way is taken from the folder of
    the file that began; a file is gone through once for each.  Starts walk over steps that are resolved before; clients get their functions
    at the end.  No side of the walk's joins is brought to the driver, however small the project."""
    steps = reexport_steps(starts, exports, files, most)
    frontier = materialize(starts.select("file", F.col("file").alias("at"), F.lit(False).alias("client")).distinct(), "reexports")
    seen = frontier
    for _ in range(most):
        walked = frontier.withColumn("folder", frontend.folder(F.col("file"))).drop("client").join(steps.hint("merge"), ["folder", "at"])
        new = walked.select("file", F.col("to").alias("at"), "client").distinct().join(seen.hint("merge"), ["file", "at", "client"], "left_anti")
        new = materialize(new, "reexports")
        seen, frontier = seen.unionByName(new), new.filter("not client")
        if frontier.isEmpty():
            break
    own = functions.filter(frontend.is_sdk_file(F.col("file"))).select(F.col("file").alias("source"), "name").distinct()
    return seen.filter("client").select("file", F.col("at").alias("source")).join(own.hint("merge"), "source").select("file", "name", "source")


def service_files(queries: DataFrame, files: DataFrame, roots: DataFrame) -> DataFrame:
    """(file, service): for xQueries.ts the file xService.ts(x), in the source roots by order, then beside it."""
    stem = F.regexp_replace(frontend.file_name(F.col("file")), r"\.[^.]*$", "")
    asked = queries.select("file", stem.alias("stem")).filter(F.col("stem").endswith("Queries")).select("file", F.replace("stem", F.lit("Queries"), F.lit("Service")).alias("service"))
    ending = F.explode(F.array(*(F.struct(F.lit(k).alias("e"), F.lit(x).alias("ending")) for k, x in enumerate((".ts", ".tsx"))))).alias("x")
    here = asked.select("file", "service", F.lit(1 << 30).alias("ord"), frontend.folder(F.col("file")).alias("folder"))
    below = roots.agg(F.collect_list(F.struct("ord", F.col("root").alias("folder"))).alias("r"))  # one row: the project's source roots
    rooted = asked.withColumn("one", F.lit(1)).join(below.withColumn("one", F.lit(1)), "one").select("file", "service", F.inline("r"))
    tried = rooted.unionByName(here).select("file", "ord", "folder", "service", ending).select("file", "ord", "x.e", F.concat_ws("/", F.nullif("folder", F.lit("")), F.concat("service", "x.ending")).alias("service"))
    there = tried.join(files.select(F.col("file").alias("service")).distinct(), "service")
    return first_by(there, "file", ["ord", "e"]).select("file", "service")


def service_types(services: DataFrame, functions: DataFrame) -> DataFrame:
    """(file, request, response): types of the service's function of a usual name, else of its first function that has types.

    ``functions``: file, ord, name, request (type of the first parameter), response."""
    rank = F.when(F.col("name") == SERVICE_FUNCTIONS[0], 0).otherwise(1)
    typed = functions.filter("request is not null or response is not null").select(F.col("file").alias("service"), "ord", rank.alias("rank"), "request", "response")
    return first_by(services.join(typed, "service"), "file", ["rank", "ord"]).select("file", "request", "response")


def api_routes(calls: DataFrame, types: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Routes and handlers of API calls: a handler for each file, with the types of its service, else of the call; schemas by the spec's endpoint.

    ``calls``: call_id, file, line, method, path, request, response; ``types``: file, request, response of services; ``endpoints``: path, method, request, response."""
    s = types.select("file", F.col("request").alias("s_request"), F.col("response").alias("s_response"), F.lit(True).alias("served"))
    e = first_by(endpoints.withColumn("method", F.upper("method")), ["path", "method"], [F.desc("ord")]).select("path", "method", F.col("request").alias("request_schema"), F.col("response").alias("response_schema"))
    joined = calls.join(s, "file", "left").join(e, ["path", "method"], "left")
    pick = lambda c: F.when(F.col("served"), F.col(f"s_{c}")).otherwise(F.col(c))
    handler = names.function_key(F.col("file"), F.lit("api_handler"))
    request, response = pick("request"), pick("response")
    return joined.select("call_id", "path", "method", "file", "line", handler.alias("handler"), F.when(response.isNotNull(), request).alias("parameter"), response.alias("returns"), "request_schema", "response_schema")


def sdk_imports(calls: DataFrame, imported: DataFrame) -> DataFrame:
    """Calls of functions that come from client files."""
    return calls.join(imported.select(F.col("name").alias("callee")).distinct(), "callee", "left_semi")


def mapping_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = grown(spark, sf_dir, "ts_files").select("file")
    return resolve_imports(grown(spark, sf_dir, "ts_imports"), files, literal(spark, "ts_mappings"), "web").select("import_id", "resolved")


def reexport_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the application and every page of queries gets from clients through re-exports."""
    files = grown(spark, sf_dir, "ts_files")
    starts = files.filter("file = 'web/src/app.ts' or file like '%/c%Queries.ts'").select("file")
    return reexported(starts, grown(spark, sf_dir, "ts_exports"), files, grown(spark, sf_dir, "ts_functions"))


def service_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = grown(spark, sf_dir, "ts_files")
    return service_files(files, files, literal(spark, "ts_roots"))


def service_type_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service_types(service_query(spark, sf_dir), grown(spark, sf_dir, "ts_functions"))


def file_kind_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of front-end files, on paths that are made from parts: folder, stem and ending by the part's number."""
    n = F.col("p_partkey")
    part = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))
    path = F.concat_ws("/", part(_FOLDERS, n), F.concat(part(_STEMS, F.floor(n / len(_FOLDERS))), part(_ENDINGS, F.floor(n / (len(_FOLDERS) * len(_STEMS))))))
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path"), frontend.is_sdk_file(path).alias("sdk"), frontend.is_generated_types(path).alias("generated"))


_FOLDERS, _STEMS, _ENDINGS = ("src", "src/sdk", "web/api-client", "src/Generated/x", "lib/sdkx", "openapi-client"), ("item", "sdk", "types", "user-client", "user_client", "SDK"), (".ts", ".gen.ts", ".tsx", ".sdk.ts", ".gen.tsx", ".js")

QUERIES = {
    "typescript_imports": mapping_query,
    "typescript_callees": lambda s, d: resolve_or_invent(grown(s, d, "python_calls"), grown(s, d, "functions")),
    "typescript_definitions": lambda s, d: first_definitions(grown(s, d, "ts_functions"), ["file", "name"]).select("file", "name", "ord"),
    "typescript_function_by_name": lambda s, d: last_definition(grown(s, d, "ts_functions")).select("file", "name", "ord"),
    "sdk_function_bodies": lambda s, d: sdk_bodies(grown(s, d, "sdk_functions"), grown(s, d, "sdk_sources")),
    "sdk_functions": lambda s, d: sdk_calls(grown(s, d, "sdk_functions"), grown(s, d, "sdk_sources"), grown(s, d, "sdk_endpoints")),
    "sdk_reexports": reexport_query,
    "service_files": service_query,
    "service_types": service_type_query,
    "api_call_routes": lambda s, d: api_routes(grown(s, d, "route_calls"), service_type_query(s, d), grown(s, d, "sdk_endpoints")),
    "frontend_file_kinds": file_kind_query,
}

#: services of pages, and the types of their functions
_SERVICES = """, q AS (SELECT file, regexp_extract(file, '([^/]*)Queries\\.ts$', 1) AS stem FROM ts_files WHERE file LIKE '%Queries.ts'),
 v AS (SELECT q.file, arg_min(f.file, k) AS service FROM q CROSS JOIN (VALUES (0, 'web/src/', '.ts'), (1, 'web/src/', '.tsx'), (2, 'web/src/lib/', '.ts'), (3, 'web/src/lib/', '.tsx')) AS r(k, folder, ending)
 JOIN ts_files f ON f.file = folder || stem || 'Service' || ending GROUP BY q.file)"""
_TYPES = """, t AS (SELECT file, x.request AS request, x.response AS response FROM (SELECT v.file, arg_min({'request': f.request, 'response': f.response}, CASE WHEN name = 'api_handler' THEN 0 ELSE 1000 END + ord) AS x
 FROM v JOIN ts_functions f ON f.file = v.service WHERE f.request IS NOT NULL OR f.response IS NOT NULL GROUP BY v.file))"""
_SPEC = "(SELECT operation_id, arg_max(upper(method), ord) AS method, arg_max(path, ord) AS path FROM sdk_endpoints WHERE operation_id IS NOT NULL AND method <> 'trace' GROUP BY 1)"
_BODY = "CASE WHEN name LIKE 'call%' THEN CASE WHEN CAST(name[5:] AS BIGINT) % 2 = 0 THEN 'GET' ELSE 'POST' END WHEN name LIKE 'spread%' THEN 'DELETE' END AS method, CASE WHEN name LIKE 'call%' THEN '/s/' || name[5:] WHEN name LIKE 'spread%' THEN '/d/' || name[7:] END AS path"
_PICK = lambda values, n: f"[{', '.join(repr(v) for v in values)}][CAST({n} % {len(values)} AS INT) + 1]"
ORACLE_SQL = {
    "typescript_imports": ctes("ts_imports", "ts_files") + " SELECT * FROM (VALUES (1, 'web/src/api/sdk.gen.ts'), (2, 'web/src/api/index.ts'), (3, 'web/src/app.ts'), (4, NULL), (5, 'web/src/api/client.gen.ts'), (6, 'web/src/lib/x.tsx'), (7, 'web/src/shared/types.ts'), (8, NULL), (9, 'web/src/lib/index.gen.ts')) AS t(import_id, resolved) UNION ALL SELECT import_id, coalesce(a.file, b.file) FROM (SELECT import_id, CASE WHEN path LIKE './%' THEN 'web/src/lib/' || path[3:] WHEN path LIKE '../%' THEN 'web/src/' || path[4:] WHEN path LIKE '@/%' THEN 'web/src/' || path[3:] END AS target FROM ts_imports WHERE import_id >= 100) i LEFT JOIN ts_files a ON a.file = target || '.ts' LEFT JOIN ts_files b ON b.file = target || '.tsx'",
    "typescript_callees": ctes("python_calls", "functions")
    + ", k AS (SELECT string_split(name, '::')[-1] AS callee, file, node_id FROM functions) SELECT c.call_id, coalesce(o.node_id, a.node_id) AS node_id, CASE WHEN coalesce(o.node_id, a.node_id) IS NULL THEN c.file || '::' || c.callee END AS virtual_name FROM python_calls c LEFT JOIN (SELECT callee, file, min(node_id) AS node_id FROM k GROUP BY 1, 2) o ON o.callee = c.callee AND o.file = c.file LEFT JOIN (SELECT callee, min(node_id) AS node_id FROM k GROUP BY 1) a ON a.callee = c.callee",
    "typescript_definitions": ctes("ts_functions") + " SELECT file, name, min(ord) AS ord FROM ts_functions GROUP BY 1, 2",
    "typescript_function_by_name": ctes("ts_functions") + " SELECT file, name, max(ord) AS ord FROM ts_functions GROUP BY 1, 2",
    "sdk_function_bodies": f"SELECT * FROM (VALUES ('web/src/api/sdk.gen.ts', 'getItems', 'GET', '/items/'), ('web/src/api/sdk.gen.ts', 'addItem', 'POST', '/items/new'), ('web/src/api/sdk.gen.ts', 'dropItem', 'DELETE', '/items/{{id}}')) AS t(file, name, method, path) UNION ALL SELECT file, name, {_BODY} FROM {rows_added('sdk_functions')} WHERE name NOT LIKE 'lost%'",
    "sdk_functions": ctes("sdk_endpoints") + f" SELECT * FROM (VALUES ('getItems', 'GET', '/items/'), ('addItem', 'PUT', '/by-spec/'), ('dropItem', 'DELETE', '/items/{{id}}')) AS t(name, method, path) UNION ALL SELECT * FROM (SELECT f.name, coalesce(s.method, f.method) AS method, coalesce(s.path, f.path) AS path FROM (SELECT name, {_BODY} FROM {rows_added('sdk_functions')}) f LEFT JOIN {_SPEC} s ON s.operation_id = f.name) WHERE method IS NOT NULL",
    "sdk_reexports": "SELECT * FROM (VALUES ('web/src/app.ts', 'getItems', 'web/src/api/sdk.gen.ts'), ('web/src/app.ts', 'addItem', 'web/src/api/sdk.gen.ts')) AS t(file, name, source) UNION ALL SELECT 'web/src/lib/c' || n.c_custkey || 'Queries.ts', 'call' || m.c_custkey, 'web/src/api/c' || m.c_custkey || '.gen.ts' FROM customer n JOIN customer m ON m.c_custkey BETWEEN n.c_custkey AND CAST(ceil(n.c_custkey / 4.0) * 4 AS BIGINT)",
    "service_files": ctes("ts_files") + _SERVICES + " SELECT * FROM v",
    "service_types": ctes("ts_files", "ts_functions") + _SERVICES + _TYPES + " SELECT * FROM t",
    "api_call_routes": ctes("ts_files", "ts_functions", "route_calls", "sdk_endpoints") + _SERVICES + _TYPES + " SELECT c.call_id, c.path, c.method, c.file, c.line, c.file || '::api_handler' AS handler, CASE WHEN CASE WHEN t.file IS NULL THEN c.response ELSE t.response END IS NOT NULL THEN CASE WHEN t.file IS NULL THEN c.request ELSE t.request END END AS parameter, CASE WHEN t.file IS NULL THEN c.response ELSE t.response END AS returns, e.x.request AS request_schema, e.x.response AS response_schema FROM route_calls c LEFT JOIN t ON t.file = c.file LEFT JOIN (SELECT path, upper(method) AS method, arg_max({'request': request, 'response': response}, ord) AS x FROM sdk_endpoints GROUP BY 1, 2) e ON e.path = c.path AND e.method = c.method",
    "frontend_file_kinds": f"WITH p AS (SELECT p_partkey, {_PICK(_FOLDERS, 'p_partkey')} AS f, {_PICK(_STEMS, f'(p_partkey // {len(_FOLDERS)})')} AS s, {_PICK(_ENDINGS, f'(p_partkey // {len(_FOLDERS) * len(_STEMS)})')} AS e FROM part)"
    " SELECT p_partkey, f || '/' || s || e AS path, f IN ('src/sdk', 'web/api-client', 'openapi-client') OR e IN ('.gen.ts', '.gen.tsx', '.sdk.ts') OR (s IN ('sdk', 'SDK')) OR (s IN ('user-client', 'user_client') AND e IN ('.ts', '.tsx')) AS sdk, e IN ('.gen.ts', '.gen.tsx') OR f IN ('src/sdk', 'src/Generated/x') AS generated FROM p",
}
