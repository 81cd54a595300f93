"""Sources: API specifications, project configuration, file listings."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkweave.functions import names
from linkweave.plans.fixtures import per_supplier, per_supplier_sql
from linkweave.session import materialize
from linkweave.sources.folder import local_path, read_folder

try:
    import yaml
except ImportError:  # an optional library; only YAML specifications need it
    yaml = None

#: Where a specification is looked for (fixed values, in order of preference).
SPEC_FOLDERS = ("", "backend", "fastapi_backend", "api", "app")
SPEC_NAMES = ("openapi.json", "openapi.yaml", "openapi.yml", "swagger.json")
SPEC_MARKS = ('"openapi"', "openapi:", '"swagger"', "swagger:")

_CONTENT = "map<string, struct<schema: map<string, string>>>"
OPERATION = f"struct<operationId: string, requestBody: struct<content: {_CONTENT}>, responses: map<string, struct<content: {_CONTENT}>>>"
#: Where components are (fixed value), and the verbs of the plain reader.
COMPONENTS = "#/components/schemas/"
PLAIN_VERBS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")

#: A small specification to try the reader on.
EXAMPLE = """{"openapi": "3.0.0", "paths": {"/items/": {"get": {"operationId": "list_items", "responses": {"200": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/ItemRead"}}}}}},
"post": {"operationId": "create_item", "requestBody": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/ItemCreate"}}}}, "responses": {"201": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/ItemRead"}}}}, "422": {}}}},
"/items/{item_id}": {"get": {"responses": {"200": {"content": {"application/json": {"schema": {"type": "object"}}}}}}, "summary": "no operation"}},
"components": {"schemas": {"ItemRead": {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}, "title": {"type": "string"}}}, "ItemCreate": {"properties": {"title": {"type": "string"}}}}}}"""


def component_name(ref: Column) -> Column:
    """Name of the component that a reference points to; null for other places."""
    return F.when(ref.startswith(COMPONENTS), F.regexp_replace(ref, f"^(?:{COMPONENTS})+", ""))


def schema_name(schema: Column) -> Column:
    """Name of a schema given as a map of texts: of the component it refers to, else its title."""
    ref = F.try_element_at(schema, F.lit("$ref"))
    return F.when(ref.isNotNull(), component_name(ref)).otherwise(F.try_element_at(schema, F.lit("title")))


def _operations(specs: DataFrame) -> DataFrame:
    items = specs.select(F.explode(F.from_json(F.get_json_object("spec", "$.paths"), "map<string, string>")).alias("path", "item"))
    return items.select("path", F.explode(F.from_json("item", "map<string, string>")).alias("method", "operation"))


def endpoints(specs: DataFrame) -> DataFrame:
    """(path, method, operation_id, request, response, code) of every operation of the JSON in column ``spec``.

    Keys of a path item that name no verb are left out.  Of the responses with a code 2xx, 200 comes first, then 201, then the others in order; only the
    best one is looked at, and without a named schema neither it nor its code is told."""
    operations = _operations(specs).filter(names.verb_of(F.col("method")).isNotNull())
    o = operations.select("path", F.upper("method").alias("method"), F.from_json("operation", OPERATION).alias("o"))
    first = lambda content: schema_name(F.get(F.map_values(content), 0)["schema"])
    rank = lambda c: F.when(c == "200", 1).when(c == "201", 2).otherwise(3)
    codes = F.array_sort(F.transform(F.filter(F.map_keys("o.responses"), lambda c: c.startswith("2")), lambda c: F.struct(rank(c).alias("r"), c.alias("c"))))
    found = o.select("path", "method", F.col("o.operationId").alias("operation_id"), first(F.col("o.requestBody.content")).alias("request"), F.get(codes, 0)["c"].alias("best"), "o")
    response = first(F.try_element_at("o.responses", F.col("best"))["content"])
    return found.select("path", "method", "operation_id", "request", response.alias("response"), F.when(response.isNotNull(), F.col("best")).alias("code"))


def plain_endpoints(specs: DataFrame) -> DataFrame:
    """The plain reading: eight verbs, references as they are written, JSON bodies and code 200 only."""
    operations = _operations(specs).filter(F.lower("method").isin(*PLAIN_VERBS) & F.col("operation").startswith("{"))
    o = operations.select("path", F.upper("method").alias("method"), F.from_json("operation", OPERATION).alias("o"))
    ref = lambda content: F.try_element_at(F.try_element_at(content, F.lit("application/json"))["schema"], F.lit("$ref"))
    return o.select("path", "method", F.col("o.operationId").alias("operation_id"), ref(F.col("o.requestBody.content")).alias("request"), ref(F.try_element_at("o.responses", F.lit("200"))["content"]).alias("response"))


def schemas(specs: DataFrame) -> DataFrame:
    """(name, schema) of the components, each schema as JSON text."""
    return specs.select(F.explode(F.from_json(F.get_json_object("spec", "$.components.schemas"), "map<string, string>")).alias("name", "schema"))


def _ref(schema: Column) -> Column:
    return F.get_json_object(schema, "$['$ref']")


def resolved_schemas(components: DataFrame) -> DataFrame:
    """(name, schema) with references followed to the schema that is written out; those that go round, outwards or nowhere are left out.

    All chains take a step together; a component that is on a chain already ends it."""
    known = components.select(F.col("name").alias("at"), "schema")
    going = components.select("name", F.col("name").alias("at"), F.array("name").alias("seen"))
    done = None
    while True:
        step = materialize(going.join(known, "at").select("name", "seen", "schema", _ref(F.col("schema")).alias("ref")), "references")
        ended = step.filter("ref is null").select("name", "schema")
        done = ended if done is None else done.unionByName(ended)
        target = component_name(F.col("ref"))
        going = step.filter("ref is not null").select("name", target.alias("at"), "seen").filter(F.col("at").isNotNull() & ~F.array_contains("seen", F.col("at")))
        going = going.withColumn("seen", F.array_append("seen", F.col("at")))
        if going.isEmpty():
            return done


def properties(components: DataFrame) -> DataFrame:
    """(name, ord, field, type_name): properties of object schemas, items of arrays, both together for parts of allOf; references are followed.

    A property's type is the component or title that its schema names, else unknown (array for items); types inside properties aren't opened.
    A reference to what is being opened already gives nothing."""
    known = components.select(F.col("name").alias("at"), F.col("schema").alias("target"))
    open_ = components.select("name", F.array().cast("array<int>").alias("ord"), "schema", F.array().cast("array<string>").alias("seen"))
    done = None
    while True:
        level = materialize(open_.withColumns({"ref": _ref(F.col("schema")), "parts": F.from_json(F.get_json_object("schema", "$.allOf"), "array<string>"), "kind": F.get_json_object("schema", "$.type")}), "properties")
        plain = level.filter("ref is null and parts is null")
        fields = F.from_json(F.get_json_object("schema", "$.properties"), "map<string, map<string, string>>")
        own = plain.filter("kind is null or kind <> 'array'").select("name", "ord", F.posexplode(F.map_entries(fields)).alias("k", "e")).select("name", F.array_append("ord", F.col("k")).alias("ord"), F.col("e.key").alias("field"), F.coalesce(schema_name(F.col("e.value")), F.lit("unknown")).alias("type_name"))
        item = F.from_json(F.get_json_object("schema", "$.items"), "map<string, string>")
        items = plain.filter("kind = 'array' and get_json_object(schema, '$.items') is not null").select("name", F.array_append("ord", F.lit(0)).alias("ord"), F.lit("items").alias("field"), F.coalesce(schema_name(item), F.lit("array")).alias("type_name"))
        done = own.unionByName(items) if done is None else done.unionByName(own).unionByName(items)
        parts = level.filter("parts is not null").select("name", "ord", "seen", F.posexplode("parts").alias("k", "schema")).select("name", F.array_append("ord", F.col("k")).alias("ord"), "schema", "seen")
        refs = level.filter("ref is not null").withColumn("at", component_name(F.col("ref"))).filter(~F.array_contains("seen", F.col("at"))).join(known, "at")
        open_ = parts.unionByName(refs.select("name", "ord", F.col("target").alias("schema"), F.array_append("seen", F.col("at")).alias("seen")))
        if open_.isEmpty():
            return done.withColumn("ord", F.array_join(F.transform("ord", lambda x: x.cast("string")), "."))


def by_operation_id(found: DataFrame, asked: DataFrame) -> DataFrame:
    """Endpoints of the operation ids in ``asked``."""
    return found.join(asked, "operation_id", "left_semi")


def by_path_and_method(found: DataFrame, asked: DataFrame) -> DataFrame:
    """Endpoints of the paths and verbs (in any case) in ``asked``."""
    return found.join(asked.select("path", F.upper("method").alias("method")), ["path", "method"], "left_semi")


def by_name(components: DataFrame, asked: DataFrame) -> DataFrame:
    return components.join(asked, "name", "left_semi")


#: What front-end names add to a component's name (fixed values).
ADDED = ("Props", "State", "Component", "Schema", "Model", "Request", "Response")
TAKEN = ("Props", "State", "Component", "Type", "Interface")


def link_frontend_types(types: DataFrame, components: DataFrame) -> DataFrame:
    """(name, component): the component of each front-end type: of its name, of its name in any case, else of a usual variant of it, the first that is there."""
    bare = F.col("name")
    for pattern in ("^I+", "(?:Type)+$", "(?:Interface)+$"):
        bare = F.regexp_replace(bare, pattern, "")
    variants = [F.col("name"), *(F.concat(bare, F.lit(x)) for x in ADDED), *(F.regexp_replace("name", f"(?:{x})+$", "") for x in TAKEN)]
    tried = types.select("name", F.posexplode(F.array(*variants)).alias("rank", "variant"))
    named = components.select(F.col("name").alias("component"))
    found = tried.join(named, F.lower("variant") == F.lower("component"))
    w = Window.partitionBy("name").orderBy("rank", F.desc(F.col("variant") == F.col("component")), "component")
    return found.withColumn("r", F.row_number().over(w)).filter("r = 1").select("name", "component")


def _inside(name: str, asked: DataFrame, names_: DataFrame) -> DataFrame:
    """(component, name): the least of ``names_`` that equals a component in any case, holds it or lies in it.

    Names are short, so each is exploded to its parts, and holding becomes equality: no pairs of all names are made."""
    pieces = lambda c: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.char_length(c)), lambda i: F.transform(F.sequence(F.lit(1), F.char_length(c) - i + 1), lambda n: F.substring(c, i, n)))))
    a, b = asked.select(F.col("name").alias("component")), names_.select(F.col("name").alias("other")).filter("other <> ''")
    equal = a.join(b, F.lower("component") == F.lower("other")).select("component", "other")
    lies = a.withColumn("other", F.explode(pieces(F.col("component")))).join(b, "other").select("component", "other")
    holds = b.withColumn("component", F.explode(pieces(F.col("other")))).join(a, "component").select("component", "other")
    return equal.unionByName(lies).unionByName(holds).groupBy("component").agg(F.min("other").alias(name))


def three_way_links(components: DataFrame, frontend: DataFrame, models: DataFrame) -> DataFrame:
    """(component, frontend_type, model) of the components that have a front-end type or a model of a like name."""
    a, b = _inside("frontend_type", components, frontend), _inside("model", components, models)
    return a.join(b, "component", "full_outer")


def components(specs: DataFrame) -> DataFrame:
    """(name, field, type_name, required) of the object schemas of a specification."""
    found = specs.select(F.explode(F.from_json(F.get_json_object("spec", "$.components.schemas"), "map<string, struct<required: array<string>, properties: map<string, struct<type: string>>>>")).alias("name", "s"))
    return found.select("name", F.col("s.required").alias("r"), F.explode("s.properties").alias("field", "p")).select("name", "field", F.col("p.type").alias("type_name"), F.coalesce(F.array_contains("r", F.col("field")), F.lit(False)).alias("required"))


def as_json(path: str, text: str | None) -> str | None:
    """A specification as JSON: its kind by the extension, else by the first characters; null if it can't be read.

    YAML mappings may have keys of any kind; they become text, such as the status code 200."""
    head = (text or "").lstrip()
    by_name = os.path.splitext(path)[1].lower()
    if by_name == ".json" or by_name not in (".yaml", ".yml") and head.startswith("{"):
        return text
    if yaml is None:
        raise RuntimeError("YAML specifications need the library yaml")
    try:
        return json.dumps(yaml.safe_load(head), default=str)
    except (yaml.YAMLError, ValueError, TypeError, RecursionError):
        return None


def read_specs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, spec) of JSON and YAML files, each read whole; ``spec`` is JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, text = batch.column("path").to_pylist(), batch.column("spec").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(map(as_json, path, text), pa.string())], names=["path", "spec"])

    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("spec")).mapInArrow(run, "path string, spec string")


def find_spec(folder: str) -> str | None:
    """The first file of the usual folders and names that looks like a specification."""
    for path in (os.path.join(folder, sub, name) for sub in SPEC_FOLDERS for name in SPEC_NAMES):
        if os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                text = f.read()
            if any(mark in text for mark in SPEC_MARKS):
                return path
    return None


def read_sources(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, content) of source files below a folder, by a pattern such as ``*.{ts,tsx}``.

    In a file system that all share the tasks list and open them.  In other stores it is Spark's listing, which leaves out empty files and names that begin with
    an underscore, such as __init__.py; those names are found and opened by the driver, through Hadoop's file system."""
    if local_path(path) is not None:
        return read_folder(spark, path, pattern)
    listed = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    jvm, at = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    wanted, rows, found = jvm.org.apache.hadoop.fs.GlobFilter(pattern), [], system.listFiles(at, True)
    while found.hasNext():
        file = found.next().getPath()
        if file.getName().startswith("_") and wanted.accept(file):
            stream = system.open(file)
            rows.append((file.toString(), jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            stream.close()
    return listed.unionByName(spark.createDataFrame(rows, "path string, content string")) if rows else listed


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content hash isn't the one that is known for their path."""
    hashed = files.withColumn("sha", F.sha2(F.col("content").cast("binary"), 256))
    return hashed.join(known.select("path", "sha"), ["path", "sha"], "left_anti")


@dataclass
class Config:
    project_name: str
    adapters: list[dict]
    output: dict
    entry_point: str | None = None
    openapi_path: str | None = None
    max_recursion_depth: int | None = None
    strict_imports: bool = False
    rules: dict = field(default_factory=dict)
    dynamic_routes: dict = field(default_factory=dict)


class ConfigError(ValueError):
    pass


def load_config(path: str) -> Config:
    """Read and check a project's TOML file; paths become absolute against its folder.

    A specification found beside the file fills the paths that aren't given, an adapter's also where a global one is."""
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    base = os.path.dirname(os.path.abspath(path))
    fix = lambda p: os.path.join(base, p) if p and not os.path.isabs(p) else p
    known = set(Config.__dataclass_fields__)
    config = Config(**{"project_name": "", "adapters": [], "output": {}} | {k: v for k, v in raw.items() if k in known})
    if not config.project_name.strip():
        raise ConfigError("project_name is empty")
    if not config.adapters:
        raise ConfigError("there is no adapter")
    for adapter in config.adapters:
        kind = adapter.get("type")
        where = {"fastapi": "app_path", "typescript": "src_paths", "nestjs": "src_paths"}.get(kind)
        if where is None:
            raise ConfigError(f"unknown adapter: {kind}")
        given = adapter.get(where) or []
        adapter[where] = fix(given) if isinstance(given, str) else [fix(p) for p in given]
        for p in [adapter[where]] if isinstance(adapter[where], str) else adapter[where]:
            if not (os.path.isfile(p) if kind == "fastapi" else os.path.isdir(p) if kind == "typescript" else os.path.exists(p)):
                raise ConfigError(f"{kind}: no such path: {p}")
    if config.output.get("format", "markdown") not in ("markdown", "json"):
        raise ConfigError(f"unknown format: {config.output['format']}")
    config.output["path"] = fix(config.output.get("path") or "report.md")
    config.openapi_path = fix(config.openapi_path)
    if config.openapi_path and not os.path.isfile(config.openapi_path):
        raise ConfigError(f"no such specification: {config.openapi_path}")
    found = find_spec(base)
    config.openapi_path = config.openapi_path or found
    for adapter in config.adapters:
        adapter["openapi_path"] = fix(adapter.get("openapi_path")) or found
    return config


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The example's specification, and one of a team for each supplier."""
    return per_supplier(spark, sf_dir, {"openapi.json": EXAMPLE}, "Item", "/items").select(F.col("content").alias("spec"))


#: A specification with references of all kinds.
REFERENCES = """{"paths": {"/a": {"get": {"operationId": "get_a", "responses": {"404": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/Error"}}}}, "204": {}, "202": {"content": {"text/html": {"schema": {"title": "Late"}}}}}},
"put": {"operationId": "put_a", "requestBody": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/Base"}}}}, "responses": {"default": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/Error"}}}}, "200": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/#/components/schemas/Item"}}}}}}, "trace": {"responses": {}}, "parameters": []},
"/b": {"post": {"operationId": "post_b", "requestBody": {"content": {"text/plain": {"schema": {"$ref": "#/components/schemas/Item"}}}}, "responses": {"201": {"content": {"application/json": {"schema": {"$ref": "other.json#/Item"}}}}, "200": {"content": {"application/json": {"schema": {"title": "Inline", "type": "object"}}}}}}}},
"components": {"schemas": {"Base": {"type": "object", "properties": {"id": {"type": "integer", "title": "Id"}, "owner": {"$ref": "#/components/schemas/Owner"}, "note": {"type": "string"}}},
"Item": {"allOf": [{"$ref": "#/components/schemas/Base"}, {"type": "object", "properties": {"price": {"type": "number"}}}, {"$ref": "#/components/schemas/Item"}, {"$ref": "#/components/schemas/Alias"}]},
"Alias": {"$ref": "#/components/schemas/Link"}, "Link": {"$ref": "#/components/schemas/Owner"}, "Owner": {"type": "object", "title": "The owner", "properties": {"name": {"type": "string", "title": "Name"}}},
"Round": {"$ref": "#/components/schemas/Trip"}, "Trip": {"$ref": "#/components/schemas/Round"}, "Away": {"$ref": "https://x.test/s.json"}, "Lost": {"$ref": "#/components/schemas/Nothing"},
"Items": {"type": "array", "items": {"$ref": "#/components/schemas/Item"}}, "Words": {"type": "array", "items": {"type": "string"}}, "Pick": {"oneOf": [{"$ref": "#/components/schemas/Base"}]}, "Error": {"type": "string"}}}}"""


def _references(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(REFERENCES).alias("spec"))


def _asked(spark: SparkSession, query: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM (VALUES {query}")


QUERIES = {
    "spec_endpoints": lambda spark, sf_dir: endpoints(_examples(spark, sf_dir)),
    "spec_components": lambda spark, sf_dir: components(_examples(spark, sf_dir)),
    "spec_success_responses": lambda spark, sf_dir: endpoints(_references(spark)),
    "spec_plain_endpoints": lambda spark, sf_dir: plain_endpoints(_references(spark)),
    "spec_resolved_schemas": lambda spark, sf_dir: resolved_schemas(schemas(_references(spark))).select("name", F.coalesce(F.get_json_object("schema", "$.type"), F.lit("")).alias("kind")),
    "spec_properties": lambda spark, sf_dir: properties(schemas(_references(spark))).select("name", "field", "type_name").distinct(),
    "spec_by_operation": lambda spark, sf_dir: by_operation_id(endpoints(_references(spark)), _asked(spark, "('put_a'), ('nothing')) AS t(operation_id)")).select("path", "method"),
    "spec_by_path": lambda spark, sf_dir: by_path_and_method(endpoints(_references(spark)), _asked(spark, "('/b', 'Post'), ('/b', 'get'), ('/c', 'post')) AS t(path, method)")).select("operation_id"),
    "spec_by_name": lambda spark, sf_dir: by_name(resolved_schemas(schemas(_references(spark))), _asked(spark, "('Alias'), ('Round')) AS t(name)")).select("name"),
    "frontend_type_links": lambda spark, sf_dir: link_frontend_types(_asked(spark, _TYPES), schemas(_references(spark))),
    "three_way_links": lambda spark, sf_dir: three_way_links(schemas(_references(spark)), _asked(spark, _TYPES), _asked(spark, "('ItemRead'), ('base'), ('OwnerModel'), ('Own')) AS t(name)")),
}
_TYPES = "('IBase'), ('ITEM'), ('ownerProps'), ('Words'), ('RoundType'), ('Erro'), ('IAwayInterface')) AS t(name)"

ORACLE_SQL = {
    "spec_endpoints": per_supplier_sql("SELECT * FROM (VALUES ('/items/', 'GET', 'list_items', NULL, 'ItemRead', '200'), ('/items/', 'POST', 'create_item', 'ItemCreate', 'ItemRead', '201'), ('/items/{item_id}', 'GET', NULL, NULL, NULL, NULL)) AS t(path, method, operation_id, request, response, code)", ('Item', '/items'), ('path', 'request', 'response'), ()),
    "spec_components": per_supplier_sql(f"WITH s AS (SELECT CAST('{EXAMPLE}' AS JSON) AS j), k AS (SELECT name, json_extract(j, '$.components.schemas.' || name) AS c FROM (SELECT j, unnest(json_keys(j, '$.components.schemas')) AS name FROM s)), p AS (SELECT name, c, unnest(json_keys(c, '$.properties')) AS field FROM k) SELECT name, field, json_extract_string(c, '$.properties.' || field || '.type') AS type_name, coalesce(list_contains(CAST(json_extract(c, '$.required') AS VARCHAR[]), field), false) AS required FROM p", ('Item', '/items'), ('name',), ()),
    "spec_success_responses": "SELECT * FROM (VALUES ('/a', 'GET', 'get_a', NULL, 'Late', '202'), ('/a', 'PUT', 'put_a', 'Base', 'Item', '200'), ('/b', 'POST', 'post_b', 'Item', 'Inline', '200')) AS t(path, method, operation_id, request, response, code)",
    "spec_plain_endpoints": "SELECT * FROM (VALUES ('/a', 'GET', 'get_a', NULL, NULL), ('/a', 'PUT', 'put_a', '#/components/schemas/Base', '#/components/schemas/#/components/schemas/Item'), ('/a', 'TRACE', NULL, NULL, NULL), ('/b', 'POST', 'post_b', NULL, NULL)) AS t(path, method, operation_id, request, response)",
    "spec_resolved_schemas": "SELECT * FROM (VALUES ('Base', 'object'), ('Item', ''), ('Alias', 'object'), ('Link', 'object'), ('Owner', 'object'), ('Items', 'array'), ('Words', 'array'), ('Pick', ''), ('Error', 'string')) AS t(name, kind)",
    "spec_properties": "SELECT * FROM (VALUES ('Base', 'id', 'Id'), ('Base', 'owner', 'Owner'), ('Base', 'note', 'unknown'), ('Item', 'id', 'Id'), ('Item', 'owner', 'Owner'), ('Item', 'note', 'unknown'), ('Item', 'price', 'unknown'), ('Item', 'name', 'Name'), ('Alias', 'name', 'Name'), ('Link', 'name', 'Name'), ('Owner', 'name', 'Name'), ('Items', 'items', 'Item'), ('Words', 'items', 'array')) AS t(name, field, type_name)",
    "spec_by_operation": "SELECT '/a' AS path, 'PUT' AS method",
    "spec_by_path": "SELECT 'post_b' AS operation_id",
    "spec_by_name": "SELECT 'Alias' AS name",
    "frontend_type_links": "SELECT * FROM (VALUES ('ITEM', 'Item'), ('ownerProps', 'Owner'), ('Words', 'Words'), ('RoundType', 'Round')) AS t(name, component)",
    "three_way_links": f"WITH c AS (SELECT unnest(['Base', 'Item', 'Alias', 'Link', 'Owner', 'Round', 'Trip', 'Away', 'Lost', 'Items', 'Words', 'Pick', 'Error']) AS name), f AS (SELECT * FROM (VALUES {_TYPES}), m AS (SELECT * FROM (VALUES ('ItemRead'), ('base'), ('OwnerModel'), ('Own')) AS t(name)), l AS (SELECT c.name AS component, (SELECT min(f.name) FROM f WHERE lower(f.name) = lower(c.name) OR contains(f.name, c.name) OR contains(c.name, f.name)) AS frontend_type, (SELECT min(m.name) FROM m WHERE lower(m.name) = lower(c.name) OR contains(m.name, c.name) OR contains(c.name, m.name)) AS model FROM c) SELECT * FROM l WHERE frontend_type IS NOT NULL OR model IS NOT NULL",
}
