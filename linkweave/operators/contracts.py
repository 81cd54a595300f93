"""Schemas, contract rules and severities.

Rules look at pairs of schemas.  Contracts are many and schemas few, so the rules run once for each distinct pair, on a table that is as
large as the catalogue's pairs, and contracts are then joined with its rows; nothing is parsed per contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions import types
from linkweave.plans.fixtures import ctes, literal
from linkweave.session import table

SEVERITIES = ("Info", "Warning", "Critical")


def parse_fields(schemas: DataFrame) -> DataFrame:
    """(schema_no, field, type_name, base_type, optional) from text name:type:optional|required, joined by commas.

    Entries without a name or a type are left out; an entry without a third part is required."""
    parts = F.split(F.trim(F.col("entry")), ":")
    entry = schemas.select("schema_no", "schema_type", F.explode(F.split("fields", ",")).alias("entry")).select("schema_no", "schema_type", parts.alias("p"))
    named = entry.select("schema_no", "schema_type", F.trim(F.get("p", 0)).alias("field"), F.trim(F.get("p", 1)).alias("type_name"), F.coalesce(F.trim(F.get("p", 2)) == "optional", F.lit(False)).alias("optional"))
    base = F.when(F.col("schema_type") == "Pydantic", types.pydantic_base_type(F.col("type_name"))).when(F.col("schema_type") == "OrmModel", types.orm_base_type(F.col("type_name"))).otherwise(types.base_type(F.col("type_name")))
    return named.filter((F.col("field") != "") & (F.coalesce("type_name", F.lit("")) != "")).select("schema_no", "field", "type_name", base.alias("base_type"), "optional")


def pairs_of(contracts: DataFrame) -> DataFrame:
    return contracts.select("from_no", "to_no").distinct()


def type_mismatch(pairs: DataFrame, fields: DataFrame) -> DataFrame:
    """Same field on both sides, different base types."""
    a = fields.select(F.col("schema_no").alias("from_no"), "field", F.col("base_type").alias("a"))
    b = fields.select(F.col("schema_no").alias("to_no"), "field", F.col("base_type").alias("b"))
    found = pairs.join(a, "from_no").join(b, ["to_no", "field"]).filter(F.col("a") != F.col("b"))
    message = F.format_string("Type mismatch for field '%s': expected %s, got %s", "field", "a", "b")
    return found.select("from_no", "to_no", F.lit("TypeMismatch").alias("mismatch_type"), F.col("field").alias("path"), F.lit("High").alias("level"), message.alias("message"))


def missing_field(pairs: DataFrame, fields: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """Field that the target needs and the source lacks; ``required`` (schema_no, field) names more of them than ``fields``."""
    needed = fields.filter(~F.col("optional")).select(F.col("schema_no").alias("to_no"), "field")
    if required is not None:
        needed = needed.unionByName(required.select(F.col("schema_no").alias("to_no"), "field")).distinct()
    there = fields.select(F.col("schema_no").alias("from_no"), "field")
    found = pairs.join(needed, "to_no").join(there, ["from_no", "field"], "left_anti")
    message = F.format_string("Missing required field '%s' in source schema", "field")
    return found.select("from_no", "to_no", F.lit("MissingField").alias("mismatch_type"), F.col("field").alias("path"), F.lit("High").alias("level"), message.alias("message"))


def unnormalized(pairs: DataFrame, fields: DataFrame, constraints: DataFrame) -> DataFrame:
    """Text that the target wants as an email or by a pattern, and the source doesn't."""
    kinds = constraints.filter(F.col("kind").isin("Email", "Pattern"))
    wanted = kinds.select(F.col("schema_no").alias("to_no"), "field", "kind").distinct()
    had = kinds.select(F.col("schema_no").alias("from_no"), "field", "kind")
    text = fields.filter(F.col("base_type") == "String").select(F.col("schema_no").alias("from_no"), "field")
    target = fields.select(F.col("schema_no").alias("to_no"), "field")
    found = pairs.join(wanted, "to_no").join(target, ["to_no", "field"]).join(text, ["from_no", "field"]).join(had, ["from_no", "field", "kind"], "left_anti")
    says = F.when(F.col("kind") == "Email", "email format expected").otherwise("pattern validation expected")
    message = F.format_string("Field '%s' may require normalization (%s)", F.col("field"), says)
    return found.select("from_no", "to_no", F.lit("UnnormalizedData").alias("mismatch_type"), F.col("field").alias("path"), F.lit("Medium").alias("level"), message.alias("message"))


def missing_schema(pairs: DataFrame, schemas: DataFrame) -> DataFrame:
    """A side without a real schema: Critical for the source, High for the target."""
    gone = schemas.filter("missing").select("schema_no", "name")
    out = []
    for side, word, level in (("from_no", "Source", "Critical"), ("to_no", "Target", "High")):
        message = F.format_string(f"{word} schema '%s' is missing validation schema (dict[str, Any] or any)", "name")
        found = pairs.join(gone.withColumnRenamed("schema_no", side), side)
        out.append(found.select("from_no", "to_no", F.lit("MissingSchema").alias("mismatch_type"), F.lit("").alias("path"), F.lit(level).alias("level"), message.alias("message")))
    return out[0].unionByName(out[1])


def run_rules(contracts: DataFrame, schemas: DataFrame, constraints: DataFrame) -> DataFrame:
    """Mismatches of every distinct pair of schemas, by all rules."""
    pairs, fields = pairs_of(contracts), parse_fields(schemas)
    rules = [type_mismatch(pairs, fields), missing_field(pairs, fields), unnormalized(pairs, fields, constraints), missing_schema(pairs, schemas), *(rule(pairs, schemas, fields) for rule in more_rules())]
    out = rules[0]
    for rule in rules[1:]:
        out = out.unionByName(rule)
    return out


_more_rules: dict[str, Callable[[DataFrame, DataFrame, DataFrame], DataFrame]] = {}


def add_rule(name: str, rule: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> None:
    """Register a rule: of pairs (from_no, to_no), schemas and fields it gives rows (from_no, to_no, mismatch_type, path, level, message)."""
    _more_rules[name] = rule


def remove_rule(name: str) -> None:
    _more_rules.pop(name, None)


def more_rules() -> tuple[Callable[[DataFrame, DataFrame, DataFrame], DataFrame], ...]:
    """The registered rules, in the order of their names."""
    return tuple(_more_rules[k] for k in sorted(_more_rules))


def severity_of_pairs(contracts: DataFrame, mismatches: DataFrame) -> DataFrame:
    """A type mismatch is Critical, any other mismatch a Warning, none Info."""
    worst = mismatches.groupBy("from_no", "to_no").agg(F.bool_or(F.col("mismatch_type") == "TypeMismatch").alias("types"), F.count("*").alias("n"))
    severity = F.when(F.col("types"), "Critical").when(F.col("n") > 0, "Warning").otherwise("Info")
    return pairs_of(contracts).join(worst, ["from_no", "to_no"], "left").select("from_no", "to_no", severity.alias("severity"), F.coalesce("n", F.lit(0)).alias("n_mismatches"))


def transformation_problems(contracts: DataFrame, schemas: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Transformations between schemas of other types than they expect: one row for each, reasons joined."""
    kind = schemas.select("schema_no", "schema_type")
    found = contracts.join(catalogue, "transformation").join(kind.select(F.col("schema_no").alias("from_no"), F.col("schema_type").alias("a")), "from_no").join(kind.select(F.col("schema_no").alias("to_no"), F.col("schema_type").alias("b")), "to_no")
    reason = lambda side, want, got: F.when(F.col(want) != F.col(got), F.format_string(f"{side}_schema type mismatch: expected %s, got %s", want, got))
    reasons = F.concat_ws("; ", reason("from", "expects_from", "a"), reason("to", "expects_to", "b"))
    return found.withColumn("reasons", reasons).filter(F.col("reasons") != "")


def contracts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item read as a contract between two schemas of the catalogue."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("contract_id"),
        F.col("l_orderkey").alias("chain_id"),
        F.expr("cast(l_partkey % 7 as int)").alias("from_no"),
        F.expr("cast(l_suppkey % 7 as int)").alias("to_no"),
        F.expr("element_at(array('FromDict','FromOrm','ToDict','PydanticToOrm','ValidateJson'), cast(l_partkey % 5 as int) + 1)").alias("transformation"),
    )


def _all(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    contracts, schemas, constraints = contracts_of(spark, sf_dir), literal(spark, "schemas"), literal(spark, "constraints")
    return contracts, schemas, constraints, parse_fields(schemas)


def rule_query(rule: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        contracts, schemas, constraints, fields = _all(spark, sf_dir)
        pairs = pairs_of(contracts)
        found = {"type": lambda: type_mismatch(pairs, fields), "field": lambda: missing_field(pairs, fields), "text": lambda: unnormalized(pairs, fields, constraints), "schema": lambda: missing_schema(pairs, schemas)}[rule]()
        return contracts.select("contract_id", "from_no", "to_no").join(found, ["from_no", "to_no"]).select("contract_id", "mismatch_type", "path", "level", "message")

    return query


def severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    contracts, schemas, constraints, _ = _all(spark, sf_dir)
    by_pair = severity_of_pairs(contracts, run_rules(contracts, schemas, constraints))
    return contracts.select("contract_id", "chain_id", "from_no", "to_no").join(by_pair, ["from_no", "to_no"])


def severity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severities(spark, sf_dir).select("contract_id", "severity", "n_mismatches")


def summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over contracts, as the machine-readable report gives them."""
    return severities(spark, sf_dir).agg(F.count_distinct("chain_id").alias("chains"), F.count("*").alias("contracts"), F.count_if(F.col("severity") == "Critical").alias("critical"), F.count_if(F.col("severity") == "Warning").alias("warning"))


def chain_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chain by its worst contract."""
    rank = F.expr("case severity when 'Critical' then 2 when 'Warning' then 1 else 0 end")
    return severities(spark, sf_dir).groupBy("chain_id").agg(F.max(rank).alias("worst"), F.count("*").alias("contracts"))


def chain_verdict_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_verdicts(spark, sf_dir).select("chain_id", F.expr("case worst when 2 then 'Critical' when 1 then 'Warning' else 'Info' end").alias("severity"), "contracts")


def coverage_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over chains, as the readable report gives them: critical, with warnings only, valid, and the share of valid ones."""
    counts = chain_verdicts(spark, sf_dir).agg(F.count("*").alias("chains"), F.count_if(F.col("worst") == 2).alias("critical"), F.count_if(F.col("worst") == 1).alias("warning"), F.count_if(F.col("worst") == 0).alias("valid"))
    return counts.withColumn("coverage", F.round(F.coalesce(F.try_divide(F.col("valid") * 100.0, "chains"), F.lit(0.0)), 6))


def transformation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transformation_problems(contracts_of(spark, sf_dir), literal(spark, "schemas"), literal(spark, "transformations"))
    return found.select("contract_id", "transformation", F.lit("<transformation>").alias("path"), F.lit("Medium").alias("level"), "reasons")


def contract_minimum_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity that a contract has before its rules run: a missing schema or a bad transformation makes a Warning at least."""
    contracts, schemas = contracts_of(spark, sf_dir), literal(spark, "schemas")
    bad = transformation_problems(contracts, schemas, literal(spark, "transformations")).select("contract_id", F.lit(1).alias("bad"))
    gone = schemas.filter("missing").select("schema_no")
    flagged = contracts.join(gone.select(F.col("schema_no").alias("from_no"), F.lit(1).alias("x")), "from_no", "left").join(gone.select(F.col("schema_no").alias("to_no"), F.lit(1).alias("y")), "to_no", "left").join(bad, "contract_id", "left")
    return flagged.select("contract_id", F.when(F.coalesce("x", "y", "bad").isNotNull(), "Warning").otherwise("Info").alias("severity"))


def fields_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_fields(literal(spark, "schemas"))


def type_map_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.col("word")
    return literal(spark, "type_words").select("word", types.base_type(word).alias("plain"), types.pydantic_base_type(word).alias("pydantic"), types.orm_base_type(word).alias("orm"))


def type_fit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every type word of the catalogue against every other; the catalogue is a fixed list."""
    words = literal(spark, "type_words")
    every = words.agg(F.collect_list("word").alias("all"))  # one row: the catalogue's words
    both = words.select(F.col("word").alias("a"), F.lit(1).alias("one")).join(every.withColumn("one", F.lit(1)), "one").select("a", F.explode("all").alias("b"))
    return both.select("a", "b", types.zod_fits_pydantic(F.col("a"), F.col("b")).alias("zod"), types.orm_fits_pydantic(F.col("a"), F.col("b")).alias("orm"), types.pydantic_fits_openapi(F.col("a"), F.col("b")).alias("openapi"))


def json_schema_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of JSON schemas: the event properties read as objects, their keys and values as fields."""
    events = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,int>").alias("m"))
    return events.select("event_id", F.explode("m").alias("field", "value"))


_CONTRACTS = """c AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS contract_id, l_orderkey AS chain_id, CAST(l_partkey % 7 AS INT) AS from_no, CAST(l_suppkey % 7 AS INT) AS to_no,
  list_extract(['FromDict','FromOrm','ToDict','PydanticToOrm','ValidateJson'], CAST(l_partkey % 5 AS INT) + 1) AS transformation FROM lineitem)"""
_FIELDS = """e AS (SELECT schema_no, schema_type, string_split(trim(u), ':') AS p FROM (SELECT schema_no, schema_type, unnest(string_split(fields, ',')) AS u FROM schemas)),
 n AS (SELECT schema_no, schema_type, trim(p[1]) AS field, trim(p[2]) AS type_name, coalesce(trim(p[3]) = 'optional', false) AS optional FROM e),
 f AS (SELECT schema_no, field, type_name, CASE WHEN schema_type = 'OrmModel' THEN coalesce(o.base_type, 'Unknown') ELSE coalesce(b.base_type, 'Unknown') END AS base_type, optional
   FROM n LEFT JOIN base_types b ON b.word = lower(type_name) LEFT JOIN orm_base_types o ON o.word = lower(type_name) WHERE field <> '' AND coalesce(type_name, '') <> '')"""
_BASE = ctes("schemas", "constraints", "base_types", "orm_base_types", "transformations") + ", " + _CONTRACTS + ", " + _FIELDS
_RULES = {
    "type": "SELECT contract_id, 'TypeMismatch' AS mismatch_type, a.field AS path, 'High' AS level, 'Type mismatch for field ''' || a.field || ''': expected ' || a.base_type || ', got ' || b.base_type AS message FROM c JOIN f a ON a.schema_no = from_no JOIN f b ON b.schema_no = to_no AND a.field = b.field WHERE a.base_type <> b.base_type",
    "field": "SELECT contract_id, 'MissingField' AS mismatch_type, b.field AS path, 'High' AS level, 'Missing required field ''' || b.field || ''' in source schema' AS message FROM c JOIN f b ON b.schema_no = to_no AND NOT b.optional WHERE NOT EXISTS (SELECT 1 FROM f a WHERE a.schema_no = from_no AND a.field = b.field)",
    "text": "SELECT contract_id, 'UnnormalizedData' AS mismatch_type, b.field AS path, 'Medium' AS level, 'Field ''' || b.field || ''' may require normalization (' || CASE kind WHEN 'Email' THEN 'email format expected' ELSE 'pattern validation expected' END || ')' AS message FROM c JOIN f a ON a.schema_no = from_no AND a.base_type = 'String' JOIN f b ON b.schema_no = to_no AND b.field = a.field JOIN constraints k ON k.schema_no = to_no AND k.field = b.field AND kind IN ('Email', 'Pattern') WHERE NOT EXISTS (SELECT 1 FROM constraints h WHERE h.schema_no = from_no AND h.field = a.field AND h.kind = k.kind)",
    "schema": "SELECT contract_id, 'MissingSchema' AS mismatch_type, '' AS path, 'Critical' AS level, 'Source schema ''' || name || ''' is missing validation schema (dict[str, Any] or any)' AS message FROM c JOIN schemas ON schema_no = from_no AND missing UNION ALL SELECT contract_id, 'MissingSchema', '', 'High', 'Target schema ''' || name || ''' is missing validation schema (dict[str, Any] or any)' FROM c JOIN schemas ON schema_no = to_no AND missing",
}
# Rules run over distinct pairs of schemas here too; a pair's number stands for the contract.
_PAIRS = "d AS (SELECT DISTINCT from_no * 100 + to_no AS contract_id, from_no, to_no FROM c)"
_SEVERITY = f"{_BASE}, {_PAIRS}, m AS (" + " UNION ALL ".join(f"({x})".replace("FROM c ", "FROM d ") for x in _RULES.values()) + "), g AS (SELECT contract_id AS pair, bool_or(mismatch_type = 'TypeMismatch') AS types, count(*) AS n FROM m GROUP BY 1), s AS (SELECT c.contract_id, chain_id, CASE WHEN types THEN 'Critical' WHEN n > 0 THEN 'Warning' ELSE 'Info' END AS severity, coalesce(n, 0) AS n_mismatches FROM c LEFT JOIN g ON pair = from_no * 100 + to_no), v AS (SELECT chain_id, max(CASE severity WHEN 'Critical' THEN 2 WHEN 'Warning' THEN 1 ELSE 0 END) AS worst, count(*) AS contracts FROM s GROUP BY 1)"
_PROBLEMS = "p AS (SELECT contract_id, transformation, concat_ws('; ', CASE WHEN expects_from <> a.schema_type THEN 'from_schema type mismatch: expected ' || expects_from || ', got ' || a.schema_type END, CASE WHEN expects_to <> b.schema_type THEN 'to_schema type mismatch: expected ' || expects_to || ', got ' || b.schema_type END) AS reasons FROM c JOIN transformations USING (transformation) JOIN schemas a ON a.schema_no = from_no JOIN schemas b ON b.schema_no = to_no)"
_FITS = {
    "zod": "(x = y OR (x, y) IN (('string','str'),('str','string'),('number','int'),('int','number'),('number','float'),('float','number'),('boolean','bool'),('bool','boolean')) OR (x = 'array' AND starts_with(y, 'list[')) OR (starts_with(x, 'list[') AND y = 'array') OR (x = 'object' AND starts_with(y, 'dict[')) OR (starts_with(x, 'dict[') AND y = 'object'))",
    "orm": "(x = y OR (x, y) IN (('integer','int'),('int','integer'),('string','str'),('str','string'),('text','str'),('str','text'),('boolean','bool'),('bool','boolean'),('numeric','float'),('float','numeric'),('decimal','float'),('float','decimal')) OR (contains(x,'uuid') AND contains(y,'uuid')) OR ((contains(x,'date') OR contains(x,'time')) AND (contains(y,'date') OR contains(y,'time'))) OR ((contains(x,'json') OR x = 'dict') AND (contains(y,'json') OR y IN ('dict','object'))))",
    "openapi": "(x = y OR (x, y) IN (('str','string'),('string','str'),('int','integer'),('integer','int'),('bool','boolean'),('boolean','bool'),('float','number'),('number','float'),('double','number'),('number','double')) OR (contains(x,'date') AND contains(y,'date')) OR (contains(x,'time') AND contains(y,'time')) OR (contains(x,'uuid') AND contains(y,'uuid')) OR ((starts_with(x,'list[') OR starts_with(x,'array')) AND y = 'array') OR (starts_with(x,'dict[') AND y = 'object'))",
}
_WRAPPED = "(starts_with(lower(word), 'optional[') OR starts_with(lower(word), 'union['))"

QUERIES = {
    "contract_type_mismatch": rule_query("type"),
    "contract_missing_field": rule_query("field"),
    "contract_unnormalized": rule_query("text"),
    "contract_missing_schema": rule_query("schema"),
    "contract_severity_rollup": severity_query,
    "json_summary": summary_query,
    "chain_verdict": chain_verdict_query,
    "markdown_stats": coverage_query,
    "transformation_validate": transformation_query,
    "contract_minimum_severity": contract_minimum_query,
    "schema_fields": fields_query,
    "type_maps": type_map_query,
    "type_compatibility": type_fit_query,
    "json_object_fields": json_schema_query,
}
ORACLE_SQL = {
    "contract_type_mismatch": f"{_BASE} {_RULES['type']}",
    "contract_missing_field": f"{_BASE} {_RULES['field']}",
    "contract_unnormalized": f"{_BASE} {_RULES['text']}",
    "contract_missing_schema": f"{_BASE} {_RULES['schema']}",
    "contract_severity_rollup": f"{_SEVERITY} SELECT contract_id, severity, n_mismatches FROM s",
    "json_summary": f"{_SEVERITY} SELECT count(DISTINCT chain_id) AS chains, count(*) AS contracts, count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'Warning') AS warning FROM s",
    "chain_verdict": f"{_SEVERITY} SELECT chain_id, CASE worst WHEN 2 THEN 'Critical' WHEN 1 THEN 'Warning' ELSE 'Info' END AS severity, contracts FROM v",
    "markdown_stats": f"{_SEVERITY} SELECT count(*) AS chains, count(*) FILTER (worst = 2) AS critical, count(*) FILTER (worst = 1) AS warning, count(*) FILTER (worst = 0) AS valid, round(CASE WHEN count(*) = 0 THEN 0.0 ELSE CAST(count(*) FILTER (worst = 0) AS DOUBLE) * 100 / count(*) END, 6) AS coverage FROM v",
    "transformation_validate": f"{_BASE}, {_PROBLEMS} SELECT contract_id, transformation, '<transformation>' AS path, 'Medium' AS level, reasons FROM p WHERE reasons <> ''",
    "contract_minimum_severity": f"{_BASE}, {_PROBLEMS} SELECT c.contract_id, CASE WHEN a.missing OR b.missing OR reasons <> '' THEN 'Warning' ELSE 'Info' END AS severity FROM c JOIN schemas a ON a.schema_no = from_no JOIN schemas b ON b.schema_no = to_no JOIN p USING (contract_id)",
    "schema_fields": f"{_BASE} SELECT * FROM f",
    "type_maps": ctes("type_words", "base_types", "orm_base_types")
    + f" SELECT t.word, coalesce(b.base_type, 'Unknown') AS plain, CASE WHEN {_WRAPPED} AND (contains(lower(t.word), 'array') OR contains(lower(t.word), 'list')) THEN 'Array' WHEN {_WRAPPED} AND regexp_matches(t.word, '\\[.*\\]') THEN coalesce(i.base_type, 'Unknown') ELSE coalesce(b.base_type, 'Unknown') END AS pydantic, coalesce(o.base_type, 'Unknown') AS orm".replace("(word)", "(t.word)")
    + " FROM type_words t LEFT JOIN base_types b ON b.word = lower(t.word) LEFT JOIN orm_base_types o ON o.word = lower(t.word) LEFT JOIN base_types i ON i.word = trim(regexp_extract(lower(t.word), '^[^\\[]*\\[(.*)\\]', 1))",
    "type_compatibility": ctes("type_words") + ", p AS (SELECT a.word AS a, b.word AS b, lower(a.word) AS x, lower(b.word) AS y FROM type_words a CROSS JOIN type_words b) SELECT a, b, " + ", ".join(f"{v} AS {k}" for k, v in _FITS.items()) + " FROM p",
    "json_object_fields": "SELECT event_id, k AS field, CAST(json_extract_string(props, '$.' || k) AS INT) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)",
}
