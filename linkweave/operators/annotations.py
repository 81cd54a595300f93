"""Queries over type annotations and decorators: the functions of ``functions.annotations`` on catalogues and on texts made from table rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions import annotations as ann
from linkweave.functions import frontend, names
from linkweave.plans.fixtures import ctes, grown, literal, rows_added
from linkweave.session import table

#: How the wrapped annotations of ``wrapped_types`` are written; {} stands for the model.
WRAPPERS = ("{}", "list[{}]", "Optional[{}]", "dict[str, {}]", "Union[None, {}]", "Page[List[{}]]", "Optional[dict[str, list[{}]]]", " Annotated[{}] ")


def wrapped_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model inside each part's annotation; the annotation is made from the part's brand and a wrapper by its number."""
    model = F.concat(F.lit("schemas."), F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""))
    text = F.element_at(F.array(*(F.replace(F.lit(w), F.lit("{}"), model) for w in WRAPPERS)), (F.col("p_partkey") % len(WRAPPERS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("annotation"), ann.innermost(text).alias("inner"), ann.base_model(text).alias("model"))


def annotation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("annotation")
    u, g, c = ann.optional_or_union(t), ann.with_generics(t), ann.column_type(t)
    return grown(spark, sf_dir, "annotations").select(
        "annotation", u["optional"].alias("optional"), u["base"].alias("base"), g["optional"].alias("generic_optional"), g["base"].alias("generic_base"), g["inner"].alias("generic_inner"),
        F.when(ann.is_annotated(t), ann.annotated_inner(t)).alias("annotated_inner"), ann.annotated_kind(t).alias("annotated_kind"), ann.missing_schema(t).alias("missing"), ann.annotation_base_type(t).alias("base_type"),
    )


def column_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ann.column_type(F.col("annotation"))
    return grown(spark, sf_dir, "column_annotations").select("annotation", c["type_name"].alias("type_name"), c["nullable"].alias("nullable"))


def call_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transformations among calls, routes among decorators."""
    t = ann.transformation(F.col("name"))
    return grown(spark, sf_dir, "called_names").select("name", t["method"].alias("method"), t["model"].alias("model"), ann.transformation_type(t["method"]).alias("transformation"), ann.is_route_decorator(F.col("name")).alias("route"))


def parameter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = grown(spark, sf_dir, "handler_parameters").withColumn("decorators", F.split("decorators", ","))
    return p.select("name", "annotation", ann.is_body_parameter(F.col("name"), F.col("annotation"), F.col("is_model")).alias("body"), ann.has_decorator(F.col("decorators"), "staticmethod").alias("static"))


def orm_class_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grown(spark, sf_dir, "class_bases").select("name", ann.is_orm_class(F.split("bases", ","), F.split("annotations", ";")).alias("orm"))


def frontend_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return grown(spark, sf_dir, "frontend_texts").select("text", frontend.inner_type(t).alias("inner"), frontend.base_type(t).alias("base_type"), frontend.trpc_path(t).alias("trpc"), frontend.url_of_argument(t).alias("url"))


def mapping_test_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tests of path mappings on every import and pattern of the catalogue."""
    every = literal(spark, "ts_mappings").agg(F.collect_list(F.struct("ord", "pattern")).alias("m")).withColumn("one", F.lit(1))  # one row: the project's mappings
    both = grown(spark, sf_dir, "ts_imports").withColumn("one", F.lit(1)).join(every, "one").select("import_id", "path", F.inline("m"))
    return both.select("import_id", "ord", frontend.matches_mapping(F.col("path"), F.col("pattern")).alias("matches"), frontend.is_mapping_prefix(F.col("path"), F.col("pattern")).alias("prefix"))


def locations(texts: DataFrame, key: str, text: str, offset: str) -> DataFrame:
    """(key, line, column), both from 1, of a byte offset in each text; offsets behind the end count as the last line's end.

    The bytes before the offset are cut out, so their line breaks give the line and what follows the last one the column."""
    raw = F.encode(F.col(text), "UTF-8")
    behind = F.col(offset) > F.octet_length(text)
    before = F.hex(F.substring(raw, F.lit(1), F.when(behind, F.octet_length(text)).otherwise(F.col(offset)).cast("int")))
    # hexadecimal bytes, each with a mark behind it, so that a break is found at whole bytes only
    lines = F.split(F.regexp_replace(before, "(..)", "$1,"), "0A,")
    width = (F.char_length(F.element_at(lines, -1)) / 3).cast("int")
    return texts.select(key, F.size(lines).alias("line"), F.when(behind, F.greatest(width, F.lit(1))).otherwise(width + 1).alias("column"))


def location_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the middle of each page's source stands."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html", F.expr("cast(octet_length(html) div 2 + page_id % 3 * 100000000 as long)").alias("at"))
    return locations(pages, "page_id", "html", "at")


def key_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of suppliers as functions of their nation's file, and the path that is read from them again."""
    path = F.concat(F.lit("app/"), F.col("s_nationkey").cast("string"), F.lit(".py"))
    key = names.function_key(path, F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", key.alias("key"), names.key_path(key).alias("path"))


QUERIES = {
    "wrapped_types": wrapped_query,
    "annotation_analysis": annotation_query,
    "column_types": column_query,
    "transformation_calls": call_query,
    "body_parameters": parameter_query,
    "orm_classes": orm_class_query,
    "frontend_texts": frontend_text_query,
    "path_mapping_tests": mapping_test_query,
    "byte_locations": location_query,
    "function_keys": key_query,
}

_WRAPPED = "CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN replace('{w}', '{{}}', m)" for k, w in enumerate(WRAPPERS)) + " END"
ORACLE_SQL = {
    "wrapped_types": f"SELECT p_partkey, {_WRAPPED} AS annotation, m AS \"inner\", substr(m, 9) AS model FROM (SELECT p_partkey, 'schemas.' || regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS m FROM part)",
    "annotation_analysis": """SELECT * FROM (VALUES
 ('str', false, 'str', false, 'str', NULL, NULL, NULL, false, 'String'),
 ('Optional[str]', true, 'str', true, 'str', NULL, NULL, NULL, false, 'String'),
 ('Union[str, None]', true, 'str', false, 'Union', 'str, None', NULL, NULL, false, 'Unknown'),
 ('Union[int, str, None]', true, 'Union[int, str]', false, 'Union', 'int, str, None', NULL, NULL, false, 'Unknown'),
 ('Union[str]', false, 'Union[str]', false, 'Union', 'str', NULL, NULL, false, 'Unknown'),
 ('int | str | None', true, 'Union[int, str]', true, 'Union[int, str]', NULL, NULL, NULL, false, 'Unknown'),
 ('list[int] | None', true, 'list[int]', true, 'list[int]', NULL, NULL, NULL, false, 'Array'),
 ('dict[str, list[int]]', false, 'dict[str, list[int]]', false, 'object', 'list[int]', NULL, NULL, true, 'Object'),
 ('List[dict[str, Any]]', false, 'List[dict[str, Any]]', false, 'array', 'dict[str, Any]', NULL, NULL, true, 'Array'),
 ('dict', false, 'dict', false, 'dict', NULL, NULL, NULL, true, 'Object'),
 ('Any', false, 'Any', false, 'Any', NULL, NULL, NULL, true, 'Unknown'),
 ('Page[Item]', false, 'Page[Item]', false, 'Page', 'Item', NULL, NULL, false, 'Unknown'),
 ('Annotated[List[int], fastapi.Query(max_length=3)]', false, 'Annotated[List[int], fastapi.Query(max_length=3)]', false, 'Annotated', 'List[int], fastapi.Query(max_length=3)', 'List[int]', 'Query', false, 'Unknown'),
 ('t.Annotated[Item, Body]', false, 't.Annotated[Item, Body]', false, 't.Annotated', 'Item, Body', 'Item', 'Body', false, 'Unknown'),
 ('float', false, 'float', false, 'float', NULL, NULL, NULL, false, 'Number'),
 ('tuple[int, str]', false, 'tuple[int, str]', false, 'tuple', 'int, str', NULL, NULL, false, 'Array')
) AS t(annotation, optional, base, generic_optional, generic_base, generic_inner, annotated_inner, annotated_kind, missing, base_type)
 UNION ALL SELECT a, k < 2, CASE k WHEN 0 THEN m WHEN 1 THEN 'list[' || m || ']' ELSE a END, k < 2, CASE k WHEN 0 THEN m WHEN 1 THEN 'list[' || m || ']' WHEN 2 THEN 'Page' ELSE 'Annotated' END, CASE k WHEN 2 THEN m WHEN 3 THEN m || ', Body' END,
  CASE WHEN k = 3 THEN m END, CASE WHEN k = 3 THEN 'Body' END, false, CASE k WHEN 1 THEN 'Array' ELSE 'Unknown' END
 FROM (SELECT annotation AS a, regexp_extract(annotation, 'M[0-9]+') AS m, CASE WHEN annotation LIKE 'Opt%' THEN 0 WHEN annotation LIKE 'list%' THEN 1 WHEN annotation LIKE 'Page%' THEN 2 ELSE 3 END AS k FROM """ + rows_added("annotations") + ")",
    "column_types": "SELECT * FROM (VALUES ('Mapped[int]', 'int', false), ('Mapped[Optional[str]]', 'str', true), ('orm.Mapped[list[Item]]', 'list[Item]', false), ('Column(Integer, primary_key=True)', 'Integer', false), ('Column(String(20), nullable=True)', 'String(20)', true), ('Integer', 'Integer', false), ('VarString', 'String', false), ('BOOLEAN', 'Boolean', false), ('Float', 'Float', false), ('Blob', 'Unknown', false), ('Point', 'Integer', false)) AS t(annotation, type_name, nullable) UNION ALL SELECT annotation, CASE WHEN annotation LIKE 'Column%' THEN 'String(' || regexp_extract(annotation, '[0-9]+') || ')' WHEN annotation LIKE 'orm%' THEN 'list[' || regexp_extract(annotation, 'M[0-9]+') || ']' ELSE regexp_extract(annotation, 'M[0-9]+') END, annotation NOT LIKE 'orm%' FROM " + rows_added("column_annotations"),
    "transformation_calls": "SELECT * FROM (VALUES ('Item.model_validate', 'model_validate', 'Item', 'ValidateData', false), ('schemas.Item.model_validate', 'model_validate', 'schemas.Item', 'ValidateData', false), ('schemas.Item.parse_obj', NULL, NULL, NULL, false), ('item.model_dump_json', 'model_dump_json', 'item', 'ToJson', false), ('a.b.c.json', 'json', 'a.b.c', 'ToJson', false), ('Item.from_orm', 'from_orm', 'Item', 'FromOrm', false), ('dict', NULL, NULL, NULL, false), ('app.get', NULL, NULL, NULL, true), ('router.anything', NULL, NULL, NULL, true), ('x.route', NULL, NULL, NULL, true), ('api.v1.post', NULL, NULL, NULL, true), ('api.fetch', NULL, NULL, NULL, false), ('rt.head', NULL, NULL, NULL, true), ('art.get', NULL, NULL, NULL, false), ('cached', NULL, NULL, NULL, false)) AS t(name, method, model, transformation, route) UNION ALL SELECT name, CASE WHEN name LIKE 's%' THEN 'model_validate' WHEN name LIKE 'm%' THEN 'model_dump_json' END, CASE WHEN name LIKE 's%' OR name LIKE 'm%' THEN regexp_replace(name, '[.][^.]*$', '') END, CASE WHEN name LIKE 's%' THEN 'ValidateData' WHEN name LIKE 'm%' THEN 'ToJson' END, name LIKE 'router.%' FROM " + rows_added("called_names"),
    "body_parameters": "SELECT * FROM (VALUES ('item', 'Item', true, false), ('item', 'Annotated[Item, Query()]', false, false), ('db', 'Item', false, false), ('user_in', 'Item', false, true), ('the_session', 'Item', false, false), ('x', 'Annotated[dict, Body(embed=True)]', true, true), ('n', 'int', false, false), ('users', 'Item', true, false)) AS t(name, annotation, body, static) UNION ALL SELECT name, annotation, is_model AND annotation NOT LIKE 'Annotated%', decorators = 'x,staticmethod' FROM " + rows_added("handler_parameters"),
    "orm_classes": "SELECT * FROM (VALUES ('A', true), ('B', true), ('C', false), ('D', true), ('E', false), ('F', true), ('G', false)) AS t(name, orm) UNION ALL SELECT name, bases IN ('Base', 'Mixin,db.Model') FROM " + rows_added("class_bases"),
    "frontend_texts": "SELECT * FROM (VALUES ('Promise<Page<Item>>', 'Page<Item>', 'Object', '/trpc/Promise<Page<Item>>', 'Promise<Page<Item>>'), ('string', 'string', 'String', '/trpc/string', 'string'), ('Item[]', 'Item[]', 'Array', '/trpc/Item[]', 'Item[]'), ('any', 'any', 'Any', '/trpc/any', 'any'), ('null', 'null', 'Unknown', '/trpc/null', 'null'), ('trpc.users.get.useQuery', 'trpc.users.get.useQuery', 'Object', '/trpc/users.get', 'trpc.users.get.useQuery'), ('api.add.useMutation', 'api.add.useMutation', 'Object', '/trpc/add', 'api.add.useMutation'), ('other.x.useQuery', 'other.x.useQuery', 'Object', '/trpc/other.x', 'other.x.useQuery'), ('{ url: \"/a\", b: 1 }', '{ url: \"/a\", b: 1 }', 'Unknown', '/trpc/{ url: \"/a\", b: 1 }', '/a'), ('{ url: ''/s'' }', '{ url: ''/s'' }', 'Unknown', '/trpc/{ url: ''/s'' }', '/s')) AS t(text, \"inner\", base_type, trpc, url) UNION ALL SELECT text, CASE WHEN text LIKE 'Promise%' THEN 'Page<' || regexp_extract(text, 'M[0-9]+') || '>' ELSE text END, CASE WHEN text LIKE '%[]' THEN 'Array' WHEN text LIKE '{%' THEN 'Unknown' ELSE 'Object' END, '/trpc/' || CASE WHEN text LIKE 'trpc.%' THEN text[6:-10] ELSE text END, CASE WHEN text LIKE '{%' THEN regexp_extract(text, '/[0-9]+') ELSE text END FROM " + rows_added("frontend_texts"),
    "path_mapping_tests": ctes("ts_imports", "ts_mappings") + " SELECT import_id, ord, CASE WHEN pattern LIKE '%/*' THEN starts_with(path, left(pattern, len(pattern) - 1)) ELSE path = pattern END AS matches, CASE WHEN pattern LIKE '%/*' THEN starts_with(path, left(pattern, len(pattern) - 2)) ELSE path = pattern END AS prefix FROM ts_imports CROSS JOIN ts_mappings",
    "byte_locations": "WITH p AS (SELECT page_id, html, strlen(html) // 2 + page_id % 3 * 100000000 AS pos, encode(html) AS raw FROM pages), b AS (SELECT page_id, pos > strlen(html) AS behind, hex(CASE WHEN pos > strlen(html) THEN raw ELSE array_slice(raw, 1, pos) END) AS h FROM p), l AS (SELECT page_id, behind, string_split(regexp_replace(h, '(..)', '\\1,', 'g'), '0A,') AS lines FROM b) SELECT page_id, CAST(len(lines) AS INT) AS line, CAST(CASE WHEN behind THEN greatest(1, len(lines[-1]) // 3) ELSE len(lines[-1]) // 3 + 1 END AS INT) AS \"column\" FROM l",
    "function_keys": "SELECT s_suppkey, 'app/' || s_nationkey || '.py::' || s_name AS key, 'app/' || s_nationkey || '.py' AS path FROM supplier",
}
