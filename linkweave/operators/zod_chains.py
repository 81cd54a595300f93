"""Chains from Zod schemas over API routes to Pydantic models.

A schema's first usage names the API call that follows it; the route at that place, the spec's endpoint of the route and the model of the endpoint's request make the chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions import types
from linkweave.operators.linking import usage_to_call
from linkweave.plans.fixtures import ctes, grown, values
from linkweave.session import materialize

#: What a model's name may add to a spec's name (fixed values).
MODEL_ENDINGS = ("Schema", "Model", "Request", "Response", "DTO")


def attach_usages(schemas: DataFrame, usages: DataFrame) -> DataFrame:
    """(node_id, usage_id, ord, file, line): usages by the first Zod node of their schema's name."""
    nodes = schemas.filter("schema_type = 'Zod'").groupBy(F.col("name").alias("schema_name")).agg(F.min("node_id").alias("node_id"))
    return usages.join(nodes, "schema_name").select("node_id", "usage_id", F.col("usage_id").alias("ord"), "file", "line")


def schema_node(schemas: DataFrame, asked: DataFrame) -> DataFrame:
    """First node of each (name, schema_type) in ``asked``."""
    first = schemas.groupBy("name", "schema_type").agg(F.min("node_id").alias("node_id"))
    return asked.join(first, ["name", "schema_type"])


def route_at(routes: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (file, line, ..) with the first route that stands there."""
    first = routes.groupBy("file", "line").agg(F.min("node_id").alias("route_id"))
    return places.join(first, ["file", "line"])


def model_of_name(schemas: DataFrame, asked: DataFrame) -> DataFrame:
    """(name, model_id): the first Pydantic node whose name is the asked one, in any case, or the asked one with a usual ending."""
    models = schemas.filter("schema_type = 'Pydantic'").groupBy(F.lower("name").alias("key")).agg(F.min("node_id").alias("model_id"))
    keys = F.array(F.lower("name"), *(F.lower(F.concat("name", F.lit(x))) for x in MODEL_ENDINGS))
    return asked.select("name", F.explode(keys).alias("key")).join(models, "key").groupBy("name").agg(F.min("model_id").alias("model_id"))


def chains(schemas: DataFrame, usages: DataFrame, calls: DataFrame, routes: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(zod_id, route_id, model_id, chain_id, name, links): one chain for each Zod schema whose first usage is followed by a call that is a route.

    ``schemas``: node_id, name, schema_type; ``usages``: usage_id, schema_name, file, line; ``calls``: call_id, file, line; ``routes``: node_id, path, method,
    file, line; ``endpoints``: path, method, request.  Without an endpoint, a request or a model the chain ends at the route (model_id is null)."""
    used = attach_usages(schemas, usages).groupBy("node_id").agg(F.min(F.struct("ord", "usage_id", "file", "line")).alias("u"))
    first = materialize(used.select("node_id", "u.file", "u.line"), "first-usages")
    # only first usages look for calls, each by its node: a schema that is used often costs no more rows
    called = usage_to_call(first.withColumnRenamed("node_id", "usage_id"), calls).withColumnRenamed("usage_id", "node_id")
    placed = first.join(called, "node_id").select(F.col("node_id").alias("zod_id"), "file", F.col("call_line").alias("line"))
    at = route_at(routes, placed).join(routes.select(F.col("node_id").alias("route_id"), "path", "method"), "route_id")
    spec = endpoints.groupBy("path", F.upper("method").alias("method")).agg(F.min("request").alias("asked"))
    asked = at.join(spec, ["path", "method"], "left")
    models = model_of_name(schemas, asked.filter("asked is not null").select(F.col("asked").alias("name")).distinct()).withColumnRenamed("name", "asked")
    label = lambda side: schemas.select(F.col("node_id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"))
    found = asked.join(models, "asked", "left").join(label("zod"), "zod_id").join(label("model"), "model_id", "left")
    whole = F.col("model_id").isNotNull()
    chain = F.when(whole, F.format_string("zod-%s-to-pydantic-%s", "zod_name", "model_name")).otherwise(F.format_string("zod-%s-to-api", "zod_name"))
    name = F.when(whole, F.format_string("Zod %s → Pydantic %s", "zod_name", "model_name")).otherwise(F.format_string("Zod %s → API", "zod_name"))
    return found.select("zod_id", "route_id", "model_id", chain.alias("chain_id"), name.alias("name"), F.when(whole, 3).otherwise(2).alias("links"))


def chain_mismatches(found: DataFrame, fields: DataFrame) -> DataFrame:
    """(chain_id, field, reason) between the fields of a chain's Zod schema and of its model; ``fields``: node_id, field, field_type, optional."""
    whole = found.filter("model_id is not null").select("chain_id", "zod_id", "model_id")
    a = whole.join(fields.withColumnRenamed("node_id", "zod_id"), "zod_id").select("chain_id", "field", F.col("field_type").alias("zod_type"), F.col("optional").alias("zod_optional"))
    b = whole.join(fields.withColumnRenamed("node_id", "model_id"), "model_id").select("chain_id", "field", F.col("field_type").alias("model_type"), F.col("optional").alias("model_optional"))
    both = a.join(b, ["chain_id", "field"], "full_outer")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("model_type").isNull(), "Field missing in Pydantic"),
            F.when(F.col("zod_type").isNull(), "Field missing in Zod"),
            F.when(~types.zod_fits_pydantic(F.col("zod_type"), F.col("model_type")), "Type mismatch"),
            F.when(F.col("zod_optional") != F.col("model_optional"), "Optionality mismatch"),
        )
    )
    return both.select("chain_id", "field", F.explode(reasons).alias("reason"))


def chain_contracts(found: DataFrame, mismatches: DataFrame) -> DataFrame:
    """(chain_id, pos, severity): contracts between neighbours; mismatches of fields raise the last one of a chain to Warning."""
    n = mismatches.groupBy("chain_id").agg(F.count("*").alias("n"))
    each = found.select("chain_id", "links", F.explode(F.sequence(F.lit(0), F.col("links") - 2)).alias("pos")).join(n, "chain_id", "left")
    return each.select("chain_id", "pos", F.when((F.col("pos") == F.col("links") - 2) & (F.col("n") > 0), "Warning").otherwise("Info").alias("severity"))


def chain_links(found: DataFrame, schemas: DataFrame, routes: DataFrame) -> DataFrame:
    """Links of the chains: the Zod schema as source, the route as transformer, the model, if there is one, as sink.

    ``schemas``: node_id, name, schema_type, file, line; ``routes``: node_id, id, schema, schema_type, missing, file, line.  Each chain becomes a row for each
    of its places, and places are joined with their nodes once."""
    places = F.array(F.struct(F.lit(0).alias("pos"), F.col("zod_id").alias("node_id")), F.struct(F.lit(1).alias("pos"), F.col("route_id").alias("node_id")), F.struct(F.lit(2).alias("pos"), F.col("model_id").alias("node_id")))
    each = found.select("chain_id", "name", F.inline(places)).filter("node_id is not null")
    shown = schemas.select("node_id", F.concat(F.lit("schema-"), "name").alias("id"), F.col("name").alias("schema"), "schema_type", F.lit(False).alias("missing"), "file", "line")
    kind = F.element_at(F.array(F.lit("Source"), F.lit("Transformer"), F.lit("Sink")), F.col("pos") + 1)
    nodes = shown.unionByName(routes).dropDuplicates(["node_id"])
    return each.join(nodes, "node_id").select("chain_id", "name", "pos", "node_id", "id", kind.alias("link_type"), "schema", "schema_type", "missing", "file", "line", F.lit(None).cast("string").alias("transformation"))


def mismatch_rows(found: DataFrame, mismatches: DataFrame) -> DataFrame:
    """(chain_id, pos, mismatch_type, path, level, message): differing fields at the last contract of their chain, which they raise to Warning."""
    at = found.select("chain_id", (F.col("links") - 2).alias("pos"))
    return mismatches.join(at, "chain_id").select("chain_id", "pos", F.lit("FieldMismatch").alias("mismatch_type"), F.col("field").alias("path"), F.lit("Medium").alias("level"), F.concat("reason", F.lit(": "), "field").alias("message"))


def _chains(s: SparkSession, d: str) -> DataFrame:
    return chains(*(grown(s, d, n) for n in ("zod_schemas", "zod_usages", "zod_calls", "zod_routes", "zod_endpoints")))


def _mismatches(s: SparkSession, d: str) -> DataFrame:
    return chain_mismatches(materialize(_chains(s, d), "zod-chains"), grown(s, d, "schema_fields"))


def _contracts(s: SparkSession, d: str) -> DataFrame:
    found = materialize(_chains(s, d), "zod-chains")
    return chain_contracts(found, chain_mismatches(found, grown(s, d, "schema_fields")))


QUERIES = {
    "zod_chains": lambda s, d: _chains(s, d),
    "zod_chain_mismatches": lambda s, d: _mismatches(s, d),
    "zod_chain_contracts": _contracts,
    "zod_usages_of_nodes": lambda s, d: attach_usages(grown(s, d, "zod_schemas"), grown(s, d, "zod_usages")).select("node_id", "usage_id"),
    "schema_nodes": lambda s, d: schema_node(grown(s, d, "zod_schemas"), s.sql("SELECT * FROM (VALUES ('ItemRequest', 'Pydantic'), ('ItemRequest', 'Zod'), ('Twice', 'Zod')) AS t(name, schema_type)")),
}

_CTES = ctes("zod_schemas", "zod_usages", "zod_calls", "zod_routes", "zod_endpoints", "schema_fields")
_CHAINS = f"""{_CTES}, n AS (SELECT name, min(node_id) AS zod_id FROM zod_schemas WHERE schema_type = 'Zod' GROUP BY 1), u AS (SELECT zod_id, arg_min(file, usage_id) AS file, arg_min(line, usage_id) AS line FROM zod_usages JOIN n ON name = schema_name GROUP BY 1),
 a AS (SELECT zod_id, file, (SELECT min(c.line) FROM zod_calls c WHERE c.file = u.file AND c.line >= u.line) AS line FROM u), r AS (SELECT a.zod_id, min(z.node_id) AS route_id FROM a JOIN zod_routes z ON z.file = a.file AND z.line = a.line GROUP BY 1),
 p AS (SELECT r.*, (SELECT min(request) FROM zod_endpoints e WHERE e.path = z.path AND upper(e.method) = z.method) AS asked FROM r JOIN zod_routes z ON z.node_id = r.route_id),
 m AS (SELECT p.*, (SELECT min(node_id) FROM zod_schemas s WHERE schema_type = 'Pydantic' AND lower(s.name) IN (lower(asked), lower(asked || 'Schema'), lower(asked || 'Model'), lower(asked || 'Request'), lower(asked || 'Response'), lower(asked || 'DTO'))) AS model_id FROM p),
 ch AS (SELECT m.zod_id, route_id, model_id, CASE WHEN model_id IS NULL THEN 'zod-' || z.name || '-to-api' ELSE 'zod-' || z.name || '-to-pydantic-' || q.name END AS chain_id, CASE WHEN model_id IS NULL THEN 'Zod ' || z.name || ' → API' ELSE 'Zod ' || z.name || ' → Pydantic ' || q.name END AS name, CASE WHEN model_id IS NULL THEN 2 ELSE 3 END AS links FROM m JOIN zod_schemas z ON z.node_id = zod_id LEFT JOIN zod_schemas q ON q.node_id = model_id)"""
_BOTH = f"{_CHAINS}, j AS (SELECT coalesce(x.chain_id, y.chain_id) AS chain_id, coalesce(x.field, y.field) AS field, x.field_type AS zt, y.field_type AS pt, x.optional AS zo, y.optional AS po FROM (SELECT * FROM ch JOIN schema_fields f ON f.node_id = zod_id WHERE model_id IS NOT NULL) x FULL OUTER JOIN (SELECT * FROM ch JOIN schema_fields f ON f.node_id = model_id) y ON x.chain_id = y.chain_id AND x.field = y.field), mm AS (SELECT chain_id, field, 'Field missing in Pydantic' AS reason FROM j WHERE pt IS NULL UNION ALL SELECT chain_id, field, 'Field missing in Zod' FROM j WHERE zt IS NULL UNION ALL SELECT chain_id, field, 'Type mismatch' FROM j WHERE NOT (zt = pt OR (zt, pt) IN (('string', 'str'), ('number', 'int'), ('number', 'float'), ('boolean', 'bool'))) UNION ALL SELECT chain_id, field, 'Optionality mismatch' FROM j WHERE zo <> po)"
ORACLE_SQL = {
    "zod_chains": f"{_CHAINS} SELECT * FROM ch",
    "zod_chain_mismatches": f"{_BOTH} SELECT * FROM mm",
    "zod_chain_contracts": f"{_BOTH} SELECT chain_id, CAST(pos AS INT) AS pos, CASE WHEN pos = links - 2 AND EXISTS (SELECT 1 FROM mm WHERE mm.chain_id = k.chain_id) THEN 'Warning' ELSE 'Info' END AS severity FROM (SELECT chain_id, links, unnest(range(links - 1)) AS pos FROM ch) k",
    "zod_usages_of_nodes": f"{ctes('zod_schemas', 'zod_usages')} SELECT node_id, usage_id FROM (SELECT name, min(node_id) AS node_id FROM zod_schemas WHERE schema_type = 'Zod' GROUP BY 1) JOIN zod_usages ON name = schema_name",
    "schema_nodes": f"SELECT name, schema_type, min(node_id) AS node_id FROM {values('zod_schemas')} WHERE (name, schema_type) IN (('ItemRequest', 'Pydantic'), ('ItemRequest', 'Zod'), ('Twice', 'Zod')) GROUP BY 1, 2",
}
