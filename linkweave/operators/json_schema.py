"""JSON Schema texts as rows: schemas, fields, constraints, nested objects and items.

Levels are opened together: one pass for each depth of nesting over all schemas, until no object is left to open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions import types
from linkweave.session import materialize, spread_out, table

_NUMBERS = "struct<minimum: double, maximum: double, minLength: long, maxLength: long>"
_OF_FIELD = ("Min", "Max", "MinLength", "MaxLength", "Pattern")


def _string(schema: Column, key: str) -> Column:
    """A text value of a key; null where it is no text."""
    found = F.get_json_object(schema, f"$.{key}")
    return F.when(~found.startswith("[") & ~found.startswith("{"), found)


def constraints(schema: Column, whole: bool) -> Column:
    """array of (kind, value): bounds, lengths and pattern; of a whole schema also formats and text enumerations."""
    n = F.from_json(schema, _NUMBERS)
    one = lambda kind, value: F.when(value.isNotNull(), F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value")))
    found = [one("Min", n["minimum"]), one("Max", n["maximum"]), one("MinLength", n["minLength"]), one("MaxLength", n["maxLength"]), one("Pattern", _string(schema, "pattern"))]
    if whole:
        form = _string(schema, "format")
        words = F.filter(F.from_json(F.get_json_object(schema, "$.enum"), "array<string>"), lambda x: x.isNotNull())
        found += [one("Email", F.when(form == "email", F.lit(""))), one("Url", F.when(form == "uri", F.lit(""))), one("Enum", F.when(F.size(words) > 0, F.array_join(words, "|")))]
    return F.array_compact(F.array(*found))


def parse(schemas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (schema_no, text): the schemas (schema_no, path, schema_type, required, constraints), and their fields
    (schema_no, path, field, type_name, base_type, optional, required, constraints).

    ``path`` leads from the whole schema to a nested one: .field for objects, [] for items.  A schema without a type is an object, a field without one is
    of any type; fields are optional as such, ``required`` tells what the schema says.  Texts that aren't JSON objects give no rows."""
    level = schemas.select("schema_no", F.lit("").alias("path"), "text").filter(F.from_json("text", "map<string, string>").isNotNull() & F.ltrim("text").startswith("{"))
    all_schemas = all_fields = None
    while True:
        level = materialize(level, "json-schema")
        if level.isEmpty() and all_schemas is not None:
            return all_schemas, all_fields
        text = F.col("text")
        kind = F.coalesce(_string(text, "type"), F.lit("object"))
        required = F.coalesce(F.from_json(F.get_json_object(text, "$.required"), "array<string>"), F.array().cast("array<string>"))
        found = level.select("schema_no", "path", kind.alias("schema_type"), required.alias("required"), constraints(text, whole=True).alias("constraints"))
        own = level.select("schema_no", "path", required.alias("r"), F.explode(F.from_json(F.get_json_object(text, "$.properties"), "map<string, string>")).alias("field", "schema"))
        of = F.coalesce(_string(F.col("schema"), "type"), F.lit("any"))
        fields = own.select("schema_no", "path", "field", of.alias("type_name"), types.base_type(of).alias("base_type"), F.lit(True).alias("optional"), F.array_contains("r", F.col("field")).alias("required"), constraints(F.col("schema"), whole=False).alias("constraints"))
        all_schemas = found if all_schemas is None else all_schemas.unionByName(found)
        all_fields = fields if all_fields is None else all_fields.unionByName(fields)
        objects = own.filter(of == "object").select("schema_no", F.concat("path", F.lit("."), "field").alias("path"), F.col("schema").alias("text"))
        items = level.select("schema_no", F.concat("path", F.lit("[]")).alias("path"), F.get_json_object(text, "$.items").alias("text")).filter(F.col("text").startswith("{"))
        level = objects.unionByName(items)


def constraint_of_field(kind: Column, value: Column) -> Column:
    """A constraint of a model's field as one of a schema: (kind, value); lengths and bounds alike are Min and Max."""
    named = F.when(kind.isin("MinLength", "MinValue"), "Min").when(kind.isin("MaxLength", "MaxValue"), "Max").when(kind.isin("Email", "Url", "Pattern", "Enum"), kind)
    return F.when(named.isNotNull(), F.struct(named.alias("kind"), F.when(named.isin("Email", "Url"), F.lit(None).cast("string")).otherwise(value).alias("value")))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema for each part: bounds by its size, lengths by its name."""
    text = F.format_string(
        '{"type": "object", "required": ["id", "gone"], "properties": {"id": {"type": "integer", "minimum": %d, "maximum": 1e3}, "name": {"type": "string", "maxLength": %d, "pattern": "^x"}, "box": {"type": "object", "required": ["w"], "properties": {"w": {"type": "number"}, "in": {"type": "object"}}}, '
        '"tags": {"type": "array", "items": {"type": "string"}}, "odd": {"type": ["string", "null"], "minimum": "5"}}, "items": {"type": "string", "format": "email", "minLength": 2, "enum": ["a", "b", 3]}}',
        F.col("p_size"),
        F.char_length("p_name"),
    )
    parts = spread_out(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name"))
    return parts.select(F.col("p_partkey").alias("schema_no"), F.when(F.col("p_partkey") % 10 == 3, "no schema").when(F.col("p_partkey") % 10 == 4, "{}").otherwise(text).alias("text"))


def _shown(column: str) -> Column:
    return F.array_join(F.transform(column, lambda c: F.concat(c["kind"], F.lit("="), c["value"])), ";")


def field_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(_texts(spark, sf_dir))[1].withColumn("constraints", _shown("constraints"))


def schema_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(_texts(spark, sf_dir))[0].select("schema_no", "path", "schema_type", F.array_join("required", ",").alias("required"), _shown("constraints").alias("constraints"))


def constraint_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql("SELECT * FROM (VALUES ('MinLength', '3'), ('MaxLength', '9'), ('MinValue', '1.5'), ('MaxValue', '2'), ('Pattern', '^a'), ('Email', ''), ('Url', ''), ('Enum', 'a|b'), ('Other', '1')) AS t(kind, value)")
    c = constraint_of_field(F.col("kind"), F.col("value"))
    return rows.select("kind", c["kind"].alias("named"), c["value"].alias("value"))


QUERIES = {"json_schema_fields": field_query, "json_schema_levels": schema_query, "field_constraints": constraint_query}

_WHOLE = "FROM part WHERE p_partkey % 10 NOT IN (3, 4)"
_FIELDS = (
    ("''", "id", "integer", "Integer", "true", "'Min=' || p_size || '.0;Max=1000.0'"),
    ("''", "name", "string", "String", "false", "'MaxLength=' || len(p_name) || ';Pattern=^x'"),
    ("''", "box", "object", "Object", "false", "''"),
    ("''", "tags", "array", "Array", "false", "''"),
    ("''", "odd", "any", "Unknown", "false", "''"),
    ("'.box'", "w", "number", "Number", "true", "''"),
    ("'.box'", "in", "object", "Object", "false", "''"),
)
ORACLE_SQL = {
    "json_schema_fields": " UNION ALL ".join(f"SELECT p_partkey AS schema_no, {p} AS path, '{f}' AS field, '{t}' AS type_name, '{b}' AS base_type, true AS optional, {r} AS required, {c} AS constraints {_WHOLE}" for p, f, t, b, r, c in _FIELDS),
    "json_schema_levels": f"SELECT p_partkey AS schema_no, '' AS path, 'object' AS schema_type, 'id,gone' AS required, '' AS constraints {_WHOLE} UNION ALL SELECT p_partkey, '', 'object', '', '' FROM part WHERE p_partkey % 10 = 4 UNION ALL SELECT p_partkey, '.box', 'object', 'w', '' {_WHOLE} UNION ALL SELECT p_partkey, '.box.in', 'object', '', '' {_WHOLE} UNION ALL SELECT p_partkey, '[]', 'string', '', 'MinLength=2;Email=;Enum=a|b|3' {_WHOLE}",
    "field_constraints": "SELECT * FROM (VALUES ('MinLength', 'Min', '3'), ('MaxLength', 'Max', '9'), ('MinValue', 'Min', '1.5'), ('MaxValue', 'Max', '2'), ('Pattern', 'Pattern', '^a'), ('Email', 'Email', NULL), ('Url', 'Url', NULL), ('Enum', 'Enum', 'a|b'), ('Other', NULL, NULL)) AS t(kind, named, value)",
}
