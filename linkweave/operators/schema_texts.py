"""Schemas of all kinds as their sources show them, read with Spark's VARIANT: JSON Schema texts, lists of fields as JSON, and field texts.

A schema's JSON Schema comes first, then its fields: a JSON list of models' or columns' fields, else ``name:type`` texts.  What a kind of schema makes of them:

* Pydantic and Zod: fields are optional unless ``required`` names them; in a field text a type goes on to the next comma.  (The analysed tool takes Zod's list, which has
  no constraints, for a field text; here it is read as the list that it is.)
* TypeScript: ``name:type:optional`` says itself whether a field is optional; an alias of a plain type has no fields.
* ORM models: a JSON list only; what can't be null is required.  A JSON Schema is not looked at.
* OpenAPI and JSON Schema: only the ``required`` list counts; without a JSON Schema they can't be read.

A schema whose JSON Schema is no JSON can't be read: the rules that look at fields leave its pairs out.  Of fields with the same name the last counts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions import types
from linkweave.operators import contracts
from linkweave.operators.linking import first_by
from linkweave.plans.fixtures import ctes, grown
from linkweave.session import table


class Parsed(NamedTuple):
    #: schema_no of the schemas that can be read
    readable: DataFrame
    #: schema_no, field, type_name, base_type, optional
    fields: DataFrame
    #: schema_no, field: names that a schema says it needs, with or without a field
    required: DataFrame
    #: schema_no, field, kind
    constraints: DataFrame


def _text(value: str, path: str) -> str:
    """A value of a VARIANT if it is text."""
    return f"CASE WHEN schema_of_variant(try_variant_get({value}, '{path}', 'variant')) = 'STRING' THEN try_variant_get({value}, '{path}', 'string') END"


def _is(value: str, path: str, kind: str) -> str:
    return f"coalesce(schema_of_variant(try_variant_get({value}, '{path}', 'variant')) {kind}, false)"


def parse(schemas: DataFrame) -> Parsed:
    """Of (schema_no, schema_type, json_schema, fields, required, type_text)."""
    spark = schemas.sparkSession
    s = spark.sql(
        f"""SELECT *, CASE WHEN json IS NULL AND schema_type IN ('Pydantic', 'Zod', 'OrmModel') AND json_schema_used IS NULL THEN try_parse_json(fields) END AS listed
        FROM (SELECT *, try_parse_json(json_schema_used) AS json FROM (SELECT *, CASE WHEN schema_type <> 'OrmModel' THEN json_schema END AS json_schema_used FROM {{schemas}}))""",
        schemas=schemas,
    )
    each = " AND ".join(_is("x", p, k) for p, k in (("$.name", "= 'STRING'"), ("$.type_name", "= 'STRING'")))
    flag, can_be_null, limited = _is("x", "$.optional", "= 'BOOLEAN'"), _is("x", "$.nullable", "= 'BOOLEAN'"), _is("x", "$.constraints", "LIKE 'ARRAY%'")
    shape = f"CASE schema_type WHEN 'OrmModel' THEN {can_be_null} WHEN 'Zod' THEN {flag} ELSE {flag} AND {limited} END"
    s = s.withColumn("items", F.expr("try_variant_get(listed, '$', 'array<variant>')")).withColumn("is_list", F.expr(f"coalesce(forall(items, x -> {each} AND {shape}), false)"))
    known = F.col("schema_type").isin("OpenAPI", "JsonSchema")
    readable = s.filter(F.col("json").isNotNull() | (F.col("json_schema_used").isNull() & ~known)).select("schema_no")

    shown = s.filter("json IS NOT NULL")
    props = spark.sql(f"SELECT schema_no, schema_type, p.key AS field, coalesce({_text('p.value', '$.type')}, 'any') AS type_name, {_text('p.value', '$.pattern')} AS pattern, CAST(p.pos AS BIGINT) AS pos FROM {{s}} AS s, LATERAL variant_explode(try_variant_get(s.json, '$.properties', 'variant')) AS p WHERE p.key IS NOT NULL", s=shown)
    needs = spark.sql(f"SELECT schema_no, {_text('r.value', '$')} AS field FROM {{s}} AS s, LATERAL variant_explode(try_variant_get(s.json, '$.required', 'variant')) AS r WHERE r.key IS NULL", s=shown).filter("field IS NOT NULL").distinct()

    own = s.filter("json_schema_used IS NULL")
    listed = spark.sql("SELECT schema_no, schema_type, CAST(f.pos AS BIGINT) AS pos, f.value AS v FROM {s} AS s, LATERAL variant_explode(s.listed) AS f WHERE s.is_list", s=own)
    listed = listed.selectExpr("schema_no", "schema_type", "pos", "v", "try_variant_get(v, '$.name', 'string') AS field", "try_variant_get(v, '$.type_name', 'string') AS type_name", "try_variant_get(v, '$.nullable', 'boolean') AS nullable")
    text = own.filter("schema_type IN ('Pydantic', 'Zod') AND NOT is_list OR schema_type = 'TypeScript' AND type_text IS NULL").select("schema_no", "schema_type", F.posexplode(F.split("fields", ",")).alias("pos", "entry"))
    typed = F.col("schema_type") == "TypeScript"
    parts = F.split("entry", ":")
    first = F.instr("entry", ":")
    text = text.filter(first > 0).select(
        "schema_no", "schema_type", F.col("pos").cast("long").alias("pos"), F.trim(F.get(parts, 0)).alias("field"),
        F.trim(F.when(typed, F.get(parts, 1)).otherwise(F.expr("substr(entry, instr(entry, ':') + 1)"))).alias("type_name"), (typed & F.coalesce(F.trim(F.get(parts, 2)) == "optional", F.lit(False))).alias("says"),
    ).filter("field <> '' AND type_name <> ''")

    named = own.filter("schema_type IN ('Pydantic', 'Zod')").select("schema_no", F.explode(F.split("required", ",")).alias("field")).select("schema_no", F.trim("field").alias("field")).filter("field <> ''").distinct()
    base = F.col("type_name")
    none = F.lit(None).cast("boolean")
    rows = props.select("schema_no", "schema_type", "field", "type_name", types.base_type(base).alias("base_type"), none.alias("told"), "pos").unionByName(
        listed.select("schema_no", "schema_type", "field", "type_name", F.when(F.col("schema_type") == "OrmModel", types.orm_base_type(base)).otherwise(types.pydantic_base_type(base)).alias("base_type"), F.when(F.col("schema_type") == "OrmModel", F.col("nullable")).alias("told"), "pos")
    ).unionByName(text.select("schema_no", "schema_type", "field", "type_name", types.base_type(base).alias("base_type"), F.when(typed, F.col("says")).alias("told"), "pos"))
    rows = first_by(rows, ["schema_no", "field"], [F.desc("pos")])
    asked = needs.unionByName(named)
    optional = F.when(known, F.lit(True)).otherwise(F.coalesce("told", F.col("asked").isNull()))
    fields = rows.join(asked.withColumn("asked", F.lit(True)), ["schema_no", "field"], "left").select("schema_no", "field", "type_name", "base_type", optional.alias("optional"))
    limit = spark.sql("SELECT schema_no, field, e.value AS c FROM (SELECT schema_no, field, try_variant_get(v, '$.constraints', 'variant') AS cs FROM {l} WHERE schema_type = 'Pydantic') AS l, LATERAL variant_explode(l.cs) AS e", l=listed)
    words = limit.filter("schema_of_variant(c) = 'STRING'").selectExpr("schema_no", "field", "try_variant_get(c, '$', 'string') AS kind")
    limits = words.unionByName(spark.sql("SELECT schema_no, field, k.key AS kind FROM {l} AS l, LATERAL variant_explode(l.c) AS k WHERE k.key IS NOT NULL", l=limit))
    limits = limits.unionByName(props.filter("pattern IS NOT NULL").select("schema_no", "field", F.lit("Pattern").alias("kind")))
    return Parsed(readable, fields, asked, limits)


def mismatches(pairs: DataFrame, parsed: Parsed) -> DataFrame:
    """The rules that look at fields, on pairs (from_no, to_no) of which both sides can be read."""
    both = pairs.join(parsed.readable.withColumnRenamed("schema_no", "from_no"), "from_no").join(parsed.readable.withColumnRenamed("schema_no", "to_no"), "to_no")
    return contracts.type_mismatch(both, parsed.fields).unionByName(contracts.missing_field(both, parsed.fields, parsed.required)).unionByName(contracts.unnormalized(both, parsed.fields, parsed.constraints))


def pairs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part a line item names against the schemas of the supplier's neighbours: pairs of schemas of all kinds."""
    lines = table(spark, sf_dir, "lineitem")
    made = lines.select(F.col("l_partkey").alias("from_no"), (F.col("l_partkey") + F.col("l_suppkey") % 5).alias("to_no")).distinct()
    few = grown(spark, sf_dir, "schema_texts").filter("schema_no < 0").select("schema_no")
    return made.unionByName(few.select(F.col("schema_no").alias("from_no"), (F.col("schema_no") - 1).cast("long").alias("to_no"))).unionByName(few.select(F.col("schema_no").alias("from_no"), F.lit(-10).cast("long").alias("to_no")))


def field_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(grown(spark, sf_dir, "schema_texts")).fields


def mismatch_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From texts to mismatches."""
    return mismatches(pairs_query(spark, sf_dir), parse(grown(spark, sf_dir, "schema_texts"))).select("from_no", "to_no", "mismatch_type", "path", "level", "message")


QUERIES = {"schema_text_fields": field_query, "schema_text_mismatches": mismatch_query}

_BASE = "coalesce((SELECT base_type FROM base_types b WHERE b.word = lower(type_name)), 'Unknown')"
_INNER = "trim(regexp_extract(lower(type_name), '^[^\\[]*\\[(.*)\\]', 1))"
_PYDANTIC = f"CASE WHEN (starts_with(lower(type_name), 'optional[') OR starts_with(lower(type_name), 'union[')) THEN CASE WHEN contains(lower(type_name), 'array') OR contains(lower(type_name), 'list') THEN 'Array' ELSE coalesce((SELECT base_type FROM base_types b WHERE b.word = {_INNER}), 'Unknown') END ELSE {_BASE} END"
_ORM = "coalesce((SELECT base_type FROM orm_base_types b WHERE b.word = lower(type_name)), 'Unknown')"
_PARSED = (
    ctes("schema_texts", "base_types", "orm_base_types")
    + f""", u AS (SELECT *, CASE WHEN schema_type <> 'OrmModel' THEN json_schema END AS jt FROM schema_texts), s AS (SELECT *, CASE WHEN json_valid(jt) THEN CAST(jt AS JSON) END AS j, CASE WHEN jt IS NULL AND schema_type IN ('Pydantic', 'Zod', 'OrmModel') AND json_valid(fields) AND json_type(fields) = 'ARRAY' THEN CAST(fields AS JSON) END AS l FROM u),
 lx AS (SELECT schema_no, schema_type, unnest(CAST(l AS JSON[])) AS x, generate_subscripts(CAST(l AS JSON[]), 1) AS pos FROM s WHERE l IS NOT NULL),
 bad AS (SELECT DISTINCT schema_no FROM lx WHERE NOT (coalesce(json_type(x, '$.name') = 'VARCHAR', false) AND coalesce(json_type(x, '$.type_name') = 'VARCHAR', false) AND CASE schema_type WHEN 'OrmModel' THEN coalesce(json_type(x, '$.nullable') = 'BOOLEAN', false) WHEN 'Zod' THEN coalesce(json_type(x, '$.optional') = 'BOOLEAN', false) ELSE coalesce(json_type(x, '$.optional') = 'BOOLEAN', false) AND coalesce(json_type(x, '$.constraints') = 'ARRAY', false) END)),
 good AS (SELECT schema_no FROM s WHERE l IS NOT NULL AND schema_no NOT IN (SELECT schema_no FROM bad)),
 readable AS (SELECT schema_no FROM s WHERE j IS NOT NULL OR (jt IS NULL AND schema_type NOT IN ('OpenAPI', 'JsonSchema'))),
 pk AS (SELECT schema_no, schema_type, json_extract(j, '$.properties') AS p, unnest(json_keys(j, '$.properties')) AS field FROM s WHERE json_type(j, '$.properties') = 'OBJECT'),
 props AS (SELECT schema_no, schema_type, field, CASE WHEN json_type(x, '$.type') = 'VARCHAR' THEN json_extract_string(x, '$.type') ELSE 'any' END AS type_name, json_type(x, '$.pattern') = 'VARCHAR' AS pattern FROM (SELECT *, json_extract(p, '$."' || field || '"') AS x FROM pk)),
 needs AS (SELECT DISTINCT schema_no, json_extract_string(x, '$') AS field FROM (SELECT schema_no, unnest(CAST(json_extract(j, '$.required') AS JSON[])) AS x FROM s WHERE json_type(j, '$.required') = 'ARRAY') WHERE json_type(x) = 'VARCHAR'
   UNION SELECT schema_no, trim(n) FROM (SELECT schema_no, unnest(string_split(required, ',')) AS n FROM s WHERE jt IS NULL AND schema_type IN ('Pydantic', 'Zod')) WHERE trim(n) <> ''),
 listed AS (SELECT lx.*, json_extract_string(x, '$.name') AS field, json_extract_string(x, '$.type_name') AS type_name, CAST(json_extract(x, '$.nullable') AS BOOLEAN) AS nullable FROM lx JOIN good USING (schema_no)),
 te AS (SELECT schema_no, schema_type, unnest(string_split(fields, ',')) AS e, generate_subscripts(string_split(fields, ','), 1) AS pos FROM s WHERE jt IS NULL AND (schema_type IN ('Pydantic', 'Zod') AND schema_no NOT IN (SELECT schema_no FROM good) OR schema_type = 'TypeScript' AND type_text IS NULL)),
 texts AS (SELECT * FROM (SELECT schema_no, schema_type, pos, trim(split_part(e, ':', 1)) AS field, trim(CASE WHEN schema_type = 'TypeScript' THEN split_part(e, ':', 2) ELSE substr(e, instr(e, ':') + 1) END) AS type_name, schema_type = 'TypeScript' AND trim(split_part(e, ':', 3)) = 'optional' AS says FROM te WHERE contains(e, ':')) WHERE field <> '' AND type_name <> ''),
 rows AS (SELECT schema_no, schema_type, field, type_name, {_BASE} AS base_type, CAST(NULL AS BOOLEAN) AS told, 0 AS pos FROM props UNION ALL SELECT schema_no, schema_type, field, type_name, CASE WHEN schema_type = 'OrmModel' THEN {_ORM} ELSE {_PYDANTIC} END, CASE WHEN schema_type = 'OrmModel' THEN nullable END, pos FROM listed
   UNION ALL SELECT schema_no, schema_type, field, type_name, {_BASE}, CASE WHEN schema_type = 'TypeScript' THEN says END, pos FROM texts),
 f AS (SELECT r.schema_no, r.field, type_name, base_type, CASE WHEN schema_type IN ('OpenAPI', 'JsonSchema') THEN true ELSE coalesce(told, n.field IS NULL) END AS optional FROM (SELECT *, row_number() OVER (PARTITION BY schema_no, field ORDER BY pos DESC) AS k FROM rows) r LEFT JOIN needs n ON n.schema_no = r.schema_no AND n.field = r.field WHERE k = 1),
 k AS (SELECT schema_no, field, CASE WHEN json_type(c) = 'VARCHAR' THEN json_extract_string(c, '$') ELSE json_keys(c)[1] END AS kind FROM (SELECT schema_no, field, unnest(CAST(json_extract(x, '$.constraints') AS JSON[])) AS c FROM listed WHERE schema_type = 'Pydantic') UNION ALL SELECT schema_no, field, 'Pattern' FROM props WHERE pattern)"""
)
ORACLE_SQL = {
    "schema_text_fields": f"{_PARSED} SELECT * FROM f",
    "schema_text_mismatches": f"""{_PARSED}, d AS (SELECT DISTINCT l_partkey AS from_no, l_partkey + l_suppkey % 5 AS to_no FROM lineitem UNION ALL SELECT schema_no, schema_no - 1 FROM schema_texts WHERE schema_no < 0 UNION ALL SELECT schema_no, -10 FROM schema_texts WHERE schema_no < 0),
 c AS (SELECT * FROM d WHERE from_no IN (SELECT schema_no FROM readable) AND to_no IN (SELECT schema_no FROM readable))
 SELECT from_no, to_no, 'TypeMismatch' AS mismatch_type, a.field AS path, 'High' AS level, 'Type mismatch for field ''' || a.field || ''': expected ' || a.base_type || ', got ' || b.base_type AS message FROM c JOIN f a ON a.schema_no = from_no JOIN f b ON b.schema_no = to_no AND a.field = b.field WHERE a.base_type <> b.base_type
 UNION ALL SELECT from_no, to_no, 'MissingField', n.field, 'High', 'Missing required field ''' || n.field || ''' in source schema' FROM c JOIN (SELECT schema_no, field FROM f WHERE NOT optional UNION SELECT * FROM needs) n ON n.schema_no = to_no WHERE NOT EXISTS (SELECT 1 FROM f a WHERE a.schema_no = from_no AND a.field = n.field)
 UNION ALL SELECT from_no, to_no, 'UnnormalizedData', b.field, 'Medium', 'Field ''' || b.field || ''' may require normalization (' || CASE kind WHEN 'Email' THEN 'email format expected' ELSE 'pattern validation expected' END || ')' FROM c JOIN f a ON a.schema_no = from_no AND a.base_type = 'String' JOIN f b ON b.schema_no = to_no AND b.field = a.field JOIN (SELECT DISTINCT * FROM k WHERE kind IN ('Email', 'Pattern')) k ON k.schema_no = to_no AND k.field = b.field WHERE NOT EXISTS (SELECT 1 FROM k h WHERE h.schema_no = from_no AND h.field = a.field AND h.kind = k.kind)""",
}
