"""Linking facts: calls to callees, routes to a spec, models to models, usages to calls, imports to packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkweave.functions import frontend, names, types
from linkweave.plans.fixtures import ctes, grown, literal
from linkweave.session import materialize, table

FIELD_SCORE = 0.7
COMPONENT_SCORE = 0.7


def first_by(df: DataFrame, key: str | list[str], order: list, drop: str = "__rank") -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    return df.withColumn(drop, F.row_number().over(w)).filter(F.col(drop) == 1).drop(drop)


def resolve_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Callee of each call by the ladder: same file, then the only one, the same folder, the longest common path, the least id.

    Names match whole or after ``::``; a dotted name that no function has can still be a class's or another node's name (kind <> Function), the first of them.
    Functions are keyed by their last name part and by folder, so that this is an equi join.  Of a name's functions, those of one folder differ by file and id
    only, so a call meets one of each folder and its own file's: a common name costs as many rows as it has folders.  Calls that match nothing are left out."""
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    keyed = functions.select(F.element_at(F.split("name", "::"), -1).alias("callee"), F.col("file").alias("there"), "node_id")
    in_file = keyed.groupBy("callee", "there").agg(F.min("node_id").alias("node_id"))
    same = calls.join(in_file.withColumnRenamed("there", "file"), ["callee", "file"]).select("call_id", "node_id")
    others = calls.join(same, "call_id", "left_anti")
    in_folder = keyed.withColumn("near", folder(F.col("there"))).groupBy("callee", "near").agg(F.min("node_id").alias("node_id"))
    found = others.join(in_folder, "callee")
    ranked = found.withColumns({"same": folder(F.col("file")) == F.col("near"), "shared": names.common_prefix(folder(F.col("file")), F.col("near"))})
    return same.unionByName(first_by(ranked, "call_id", [F.desc("same"), F.desc("shared"), "node_id"]).select("call_id", "node_id"))


def resolve_by_name(calls: DataFrame, functions: DataFrame, nodes: DataFrame) -> DataFrame:
    """``resolve_calls``, and for calls without a function the first node of the name (a class, a method, a schema; never a route or module)."""
    found = resolve_calls(calls, functions)
    named = nodes.filter(~F.col("kind").isin("Route", "Module")).groupBy(F.col("name").alias("callee")).agg(F.min("node_id").alias("node_id"))
    return found.unionByName(calls.join(found, "call_id", "left_anti").join(named, "callee").select("call_id", "node_id"))


def usage_to_call(usages: DataFrame, calls: DataFrame) -> DataFrame:
    """As-of join: each usage with the nearest API call in its file at or after its line, the first of equals.

    Calls and usages of a file are ordered together, last first, and the last call met is carried on, so no pair of them is ever made.  (A window that looks
    ahead to the end of its file would go through the rest of the file again for each row.)"""
    both = calls.select("file", "line", F.lit(1).alias("is_call"), F.col("call_id").alias("id")).unionByName(usages.select("file", "line", F.lit(0).alias("is_call"), F.col("usage_id").alias("id"))).filter("file is not null and line is not null")
    met = Window.partitionBy("file").orderBy(F.desc("line"), F.desc("is_call"), F.desc("id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = F.last(F.when(F.col("is_call") == 1, F.struct(F.col("id").alias("call_id"), F.col("line").alias("call_line"))), ignorenulls=True).over(met)
    return both.withColumn("hit", hit).filter("is_call = 0 and hit is not null").select(F.col("id").alias("usage_id"), "hit.call_id", "hit.call_line")


def compare_fields(zod: DataFrame, pydantic: DataFrame) -> DataFrame:
    """Full outer join by field name; a field can differ in type and in being optional, which makes two rows."""
    a = zod.select("field", F.col("field_type").alias("zod_type"), F.col("optional").alias("zod_optional"))
    b = pydantic.select("field", F.col("field_type").alias("pydantic_type"), F.col("optional").alias("pydantic_optional"))
    both = a.join(b, "field", "full_outer")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("pydantic_type").isNull(), "Field missing in Pydantic"),
            F.when(F.col("zod_type").isNull(), "Field missing in Zod"),
            F.when(~types.zod_fits_pydantic(F.col("zod_type"), F.col("pydantic_type")), "Type mismatch"),
            F.when(F.col("zod_optional") != F.col("pydantic_optional"), "Optionality mismatch"),
        )
    )
    return both.select("field", "zod_type", "pydantic_type", F.explode(reasons).alias("reason"))


def _rarest(rows: DataFrame, side: str, seen: DataFrame, least: float) -> DataFrame:
    """(id, field): of each model the rarest fields, so many that a model with a score of ``least`` or more has one of them, too.

    ``seen``: field, many (rows that have it), repeats (the most rows of a field in one model)."""
    order = F.row_number().over(Window.partitionBy(f"{side}_id").orderBy("many", "field"))
    n = rows.groupBy(f"{side}_id").agg(F.count("*").alias("n"))
    ranked = rows.select(f"{side}_id", "field").join(seen, "field").withColumn("order", order).join(n, f"{side}_id")
    shared = F.greatest(F.lit(1), F.ceil(F.lit(least - 1e-5) * F.col("n") / F.col("repeats")))
    return ranked.filter(F.col("order") <= F.col("n") - shared + 1).select(f"{side}_id", "field").distinct()


def field_scores(left: DataFrame, right: DataFrame, fits, least: float) -> DataFrame:
    """(left_id, right_id, score): fields that agree by name and type (and in being optional, where both sides say so), over the larger number of fields.

    Only pairs with a score of ``least`` or more appear.  Pairs are made over the rarest fields alone and counted over all: of two models that agree in most
    fields each has one among its rarest, so a field that everyone has makes no pairs."""
    n_left, n_right = left.groupBy("left_id").agg(F.count("*").alias("n")), right.groupBy("right_id").agg(F.count("*").alias("m"))
    each = left.groupBy("field", F.col("left_id").alias("id")).agg(F.count("*").alias("k")).unionByName(right.groupBy("field", F.col("right_id").alias("id")).agg(F.count("*").alias("k")))
    seen = each.groupBy("field").agg(F.sum("k").alias("many")).crossJoin(each.agg(F.max("k").alias("repeats")))
    pairs = _rarest(left, "left", seen, least).join(_rarest(right, "right", seen, least), "field").select("left_id", "right_id").distinct()
    agree = fits(F.col("right_type"), F.col("left_type"))
    if "left_optional" in left.columns and "right_optional" in right.columns:
        agree &= F.col("left_optional") == F.col("right_optional")
    agree = pairs.join(left, "left_id").join(right, ["right_id", "field"]).filter(agree).groupBy("left_id", "right_id").agg(F.count("*").alias("k"))
    score = F.round(F.col("k") / F.greatest("n", "m"), 6)
    return agree.join(n_left, "left_id").join(n_right, "right_id").select("left_id", "right_id", score.alias("score")).filter(F.col("score") >= least)


def best_by_fields(left: DataFrame, right: DataFrame, fits, least: float) -> DataFrame:
    """(left_id, best): of each left model the right one with the highest score of ``least`` or more, the first of equals in the order of ``place``.

    ``left``: left_id, field, left_type and maybe left_optional; ``right``: the same of the right side, and ``place``, a struct.  ``best``: minus, place.  Models
    with the same fields have the same scores, so classes of such models are compared and each model takes what its class has found."""
    columns = lambda df, side: [F.col(c).alias(c) for c in ("field", f"{side}_type", f"{side}_optional") if c in df.columns]
    fields = lambda df, side: F.array_sort(F.collect_list(F.struct(*columns(df, side)))).alias("fields")
    models = materialize(left.groupBy("left_id").agg(fields(left, "left")), "models")
    classes = materialize(models.groupBy("fields").agg(F.min("left_id").alias("left_id")), "classes")
    others = right.groupBy("right_id").agg(F.min("place").alias("place"), fields(right, "right")).groupBy("fields").agg(F.min("right_id").alias("right_id"), F.min("place").alias("place"))
    others = materialize(others, "classes")
    scores = field_scores(classes.select("left_id", F.inline("fields")), others.select("right_id", F.inline("fields")), fits, least)
    best = scores.join(others.select("right_id", "place"), "right_id").groupBy("left_id").agg(F.min(F.struct((-F.col("score")).alias("minus"), "place")).alias("best"))
    return models.join(classes.join(best, "left_id").select("fields", "best"), "fields").select("left_id", "best")


def link_models(models: DataFrame) -> DataFrame:
    """Best ORM model of each Pydantic model that is made from attributes: 1.0 by name, 0.9 by name without suffixes, else the field score above 0.7."""
    p = models.filter("kind = 'Pydantic' and from_attributes").select("model_id", "name").distinct()
    o = models.filter("kind = 'OrmModel'").groupBy(F.col("name").alias("orm_name")).agg(F.min("model_id").alias("orm_id"))  # the first of each name
    found = lambda minus: F.struct(minus.alias("minus"), "orm_name", "orm_id").alias("best")
    exact = p.join(o, F.col("name") == F.col("orm_name")).select("model_id", found(F.lit(-1.0)))
    bare = p.withColumn("bare", names.strip_model_suffixes(F.col("name"))).join(o, F.col("bare") == F.col("orm_name")).select("model_id", found(F.lit(-0.9)))
    left = models.filter("kind = 'Pydantic' and from_attributes").select(F.col("model_id").alias("left_id"), "field", F.col("field_type").alias("left_type"), F.col("optional").alias("left_optional"))
    place = F.struct(F.col("name").alias("orm_name"), F.col("model_id").alias("orm_id")).alias("place")
    right = models.filter("kind = 'OrmModel'").select(F.col("model_id").alias("right_id"), "field", F.col("field_type").alias("right_type"), F.col("optional").alias("right_optional"), place)
    scored = best_by_fields(left, right, types.orm_fits_pydantic, FIELD_SCORE).filter(-F.col("best.minus") > FIELD_SCORE)
    scored = scored.select(F.col("left_id").alias("model_id"), F.struct("best.minus", "best.place.orm_name", "best.place.orm_id").alias("best"))
    return exact.unionByName(bare).unionByName(scored).groupBy("model_id").agg(F.min("best").alias("best")).select("model_id", "best.orm_id", (-F.col("best.minus")).alias("score"))


def link_components(models: DataFrame, components: DataFrame) -> DataFrame:
    """Spec component of each Pydantic model: by name, by name in any case, without suffixes, else by fields with a score of 0.7 or more."""
    p = models.filter("kind = 'Pydantic'")
    one = p.select("model_id", "name").distinct()
    c = components.groupBy(F.col("name").alias("key")).agg(F.min("name").alias("component"))
    low = components.groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("component"))  # of names that differ in case the least
    found = lambda rank, minus, component: F.struct(rank.alias("rank"), minus.alias("minus"), F.lower(component).alias("low"), component.alias("component")).alias("best")
    step = lambda rank, a, there: one.withColumn("key", a).join(there, "key").select("model_id", found(F.lit(rank), F.lit(-1.0), F.col("component")))
    name = F.col("name")
    ladder = step(1, name, c).unionByName(step(2, F.lower(name), low)).unionByName(step(3, F.lower(names.strip_model_suffixes(name)), low))
    left = p.select(F.col("model_id").alias("left_id"), "field", F.col("field_type").alias("left_type"))
    right = components.select(F.col("name").alias("right_id"), "field", F.col("field_type").alias("right_type"), F.struct(F.lower("name").alias("low"), F.col("name").alias("component")).alias("place"))
    scored = best_by_fields(left, right, lambda r, x: types.pydantic_fits_openapi(x, r), COMPONENT_SCORE)
    every = ladder.unionByName(scored.select(F.col("left_id").alias("model_id"), found(F.lit(4), F.col("best.minus"), F.col("best.place.component"))))
    best = every.groupBy("model_id").agg(F.min("best").alias("best"))
    return best.select("model_id", "best.component", "best.rank", (-F.col("best.minus")).alias("score"))


def best_response(endpoints: DataFrame) -> DataFrame:
    """Response of each endpoint: of the codes 2xx, 200 comes first, then 201, then the others in order; without a schema there neither it nor the code is told."""
    good = F.col("code").startswith("2")
    rank = F.when(F.col("code") == "200", 1).when(F.col("code") == "201", 2).when(good, 3).otherwise(4)
    best = first_by(endpoints.withColumn("rank", rank), ["path", "method"], ["rank", "code", "response"])
    told = good & F.col("response").isNotNull()
    return best.select("path", "method", F.when(told, F.col("code")).alias("code"), F.when(told, F.col("response")).alias("response"))


def routes_in_spec(routes: DataFrame, endpoints: DataFrame) -> DataFrame:
    spec = best_response(endpoints).select("path", F.upper("method").alias("method"), "response")
    return routes.join(spec, ["path", "method"]).select("node_id", "path", "method", "response")


def routes_missing(routes: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Both differences: routes that the spec lacks, and endpoints with a known verb that the code lacks."""
    spec = endpoints.select("path", names.verb_of(F.col("method")).alias("method")).filter("method is not null").distinct()
    code = routes.select("path", "method").distinct()
    return code.join(spec, ["path", "method"], "left_anti").withColumn("missing_in", F.lit("spec")).unionByName(spec.join(code, ["path", "method"], "left_anti").withColumn("missing_in", F.lit("code")))


def handlers_of_spec(routes: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Endpoints with an operation id whose handler isn't among the routes: they become virtual routes."""
    spec = endpoints.filter("operation_id is not null").select("path", F.upper("method").alias("method"), names.handler_of_operation(F.col("operation_id")).alias("handler")).distinct()
    return spec.join(routes.select("path", "method"), ["path", "method"], "left_anti").select("path", "method", "handler")


def external_modules(imports: DataFrame, requirements: DataFrame, installed: DataFrame) -> DataFrame:
    """A module is external if a requirement names its first part; installed packages are found, others are an error."""
    required = requirements.select(F.regexp_extract("line", r"^([A-Za-z0-9_.\-]+)", 1).alias("root")).filter("root <> ''").distinct()
    rooted = imports.withColumn("root", F.split_part("module", F.lit("."), F.lit(1))).join(required.withColumn("external", F.lit(True)), "root", "left").join(installed.select(F.col("module").alias("root"), F.lit(True).alias("there")), "root", "left")
    status = F.when(F.col("external").isNull(), "local").when(F.col("there"), "installed").otherwise("ExternalDependency")
    return rooted.select("import_id", "module", status.alias("status"))


def expand_routers(calls: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Endpoints of router generators: prefix and path, schemas by the place of arguments."""
    args = F.split("args", ",")
    arg = lambda c: F.nullif(F.get(args, F.col(c)), F.lit(""))
    return calls.join(catalogue, "generator").select("call_id", "ord", "method", F.concat("prefix", "path").alias("path"), arg("request_arg").alias("request"), arg("response_arg").alias("response"))


def classify_calls(calls: DataFrame, sdk: DataFrame) -> DataFrame:
    """The kind of API call, its verb, path and types: one ordered case expression, the first rule that fits wins.

    ``sdk``: verb and path of the functions of generated clients, by their name."""
    calls = calls.join(sdk.select(F.col("name").alias("callee"), F.col("method").alias("sdk_method"), F.col("path").alias("sdk_path")), "callee", "left")
    callee, parts = F.col("callee"), F.split("callee", r"\.")
    generics = F.when(F.col("generics") == "", F.array().cast("array<string>")).otherwise(F.split("generics", r"\|"))
    one, two = F.get(parts, 0), F.get(parts, 1)
    verb2, n = names.verb_of(two), F.size(parts)
    hook = F.col("callee").contains(".use") & (callee.contains("Query") | callee.contains("Mutation"))
    mutation = callee.isin("useMutation", "useSWRMutation")
    rules = [
        ("fetch", callee == "fetch", names.options_verb(F.col("options")), F.col("arg")),
        ("axios", (one == "axios") & (n == 2) & verb2.isNotNull(), verb2, F.col("arg")),
        ("client", one.isin("api", "client", "http", "request") & verb2.isNotNull(), verb2, F.col("arg")),
        ("base", (F.col("base") == "client") & names.verb_of(F.col("property")).isNotNull(), names.verb_of(F.col("property")), frontend.url_of_argument(F.col("arg"))),
        ("apollo", callee.isin("useQuery", "useMutation") & F.col("arg").rlike("gql|graphql"), F.lit("POST"), F.lit("/graphql")),
        ("tanstack", callee.isin("useQuery", "useMutation"), F.when(mutation, "POST").otherwise("GET"), F.col("arg")),
        ("swr", callee.isin("useSWR", "useSWRMutation"), F.when(mutation, "POST").otherwise("GET"), F.col("arg")),
        ("rtk", hook, names.hook_verb(callee), names.hook_path(callee)),
        ("trpc", callee.rlike(r"\.use(Query|Mutation)$"), F.when(callee.endswith("Mutation"), "POST").otherwise("GET"), frontend.trpc_path(callee)),
        ("action", callee.startswith("actions."), F.lit("POST"), names.action_path(callee)),
        ("sdk", F.col("sdk_method").isNotNull(), F.col("sdk_method"), F.col("sdk_path")),
    ]
    pick = lambda k: F.coalesce(*(F.when(rule[1], rule[k] if k else F.lit(rule[0])) for rule in rules))
    response = F.get(generics, 0)
    request = F.when(pick(0).isin("apollo", "rtk"), F.get(generics, 1)).when((pick(0) == "tanstack") & mutation, F.get(generics, 2)).when((pick(0) == "swr") & mutation & (F.size(generics) == 4), F.get(generics, 3))
    typed = pick(0).isin("apollo", "tanstack", "swr", "rtk")
    return calls.select("file", "ord", pick(0).alias("rule"), pick(2).alias("method"), pick(3).alias("path"), F.when(typed, response).alias("response"), F.when(typed, request).alias("request")).filter("rule is not null")


def call_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_calls(grown(spark, sf_dir, "python_calls"), grown(spark, sf_dir, "functions"))


def usage_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_to_call(grown(spark, sf_dir, "usages"), grown(spark, sf_dir, "api_calls"))


def event_usage_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The as-of join at scale: each view with the user's next purchase."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("file"), F.col("ts").alias("line"), "event_type")
    views = events.filter("event_type = 'view'").select(F.col("event_id").alias("usage_id"), "file", "line")
    return usage_to_call(views, events.filter("event_type = 'purchase'").select(F.col("event_id").alias("call_id"), "file", "line")).select("usage_id", "call_id")


def compare_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_fields(grown(spark, sf_dir, "zod_fields"), grown(spark, sf_dir, "pydantic_fields"))


def name_functions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("name")
    return grown(spark, sf_dir, "names").select(
        "name", names.kebab(n).alias("kebab"), names.strip_model_suffixes(n).alias("bare"), names.hook_path(n).alias("hook_path"), names.hook_verb(n).alias("hook_verb"), names.decorator_verb(n).alias("verb"), names.last_part(n).alias("last_part"),
        names.key_path(n).alias("key_path"), names.handler_of_operation(n).alias("handler"), names.action_path(n).alias("action_path"), names.truncate(n, 8).alias("short"),
    )


def path_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grown(spark, sf_dir, "paths").select("base", "path", names.join_paths(F.col("base"), F.col("path")).alias("joined"), names.common_prefix(F.col("base"), F.col("path")).alias("shared"))


def url_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and path of every page's address."""
    u = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(u, r"^https?://([^/]+)", 1).alias("host"), F.regexp_replace(u, r"^https?://[^/]+", "").alias("path"))


def hash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hash of every file, and whether it is the first with that content."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return docs.groupBy("sha").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("files"))


_one = {
    "spec_best_response": lambda s, d: best_response(grown(s, d, "endpoints")),
    "route_endpoint_match": lambda s, d: routes_in_spec(grown(s, d, "routes"), grown(s, d, "endpoints")),
    "route_coverage": lambda s, d: routes_missing(grown(s, d, "routes"), grown(s, d, "endpoints")),
    "virtual_routes": lambda s, d: handlers_of_spec(grown(s, d, "routes"), grown(s, d, "endpoints")),
    "pydantic_orm_score": lambda s, d: link_models(grown(s, d, "models")),
    "spec_link_ladder": lambda s, d: link_components(grown(s, d, "models"), grown(s, d, "components")),
    "external_dependencies": lambda s, d: external_modules(grown(s, d, "imports"), grown(s, d, "requirements"), grown(s, d, "installed")),
    "router_generators": lambda s, d: expand_routers(grown(s, d, "router_calls"), literal(s, "router_catalog")),
    "api_call_classify": lambda s, d: classify_calls(grown(s, d, "calls"), grown(s, d, "sdk_calls")),
}
QUERIES = {
    "name_resolution_ladder": call_query,
    "zod_usage_asof_call": usage_query,
    "event_asof_next": event_usage_query,
    "zod_pydantic_compare": compare_query,
    "name_functions": name_functions_query,
    "combine_paths": path_query,
    "page_paths": url_query,
    "content_hashes": hash_query,
    **_one,
}

_FITS = {
    "orm": "(lower(x) = lower(y) OR (lower(x), lower(y)) IN (('integer','int'),('string','str'),('text','str'),('boolean','bool'),('numeric','float'),('decimal','float'),('int','integer'),('str','string'),('str','text'),('bool','boolean'),('float','numeric'),('float','decimal')))",
    "spec": "(lower(x) = lower(y) OR (lower(x), lower(y)) IN (('string','str'),('integer','int'),('boolean','bool'),('number','float'),('number','double'),('str','string'),('int','integer'),('bool','boolean'),('float','number'),('double','number')))",
}
_SUFFIX = "name"
for _s in names.MODEL_SUFFIXES:
    _SUFFIX = f"regexp_replace({_SUFFIX}, '({_s})+$', '')"
_HOOK = "string_split(name, '.')[-1]"
for _p in ("^(use)+", "(Query)+$", "(Mutation)+$", "(ById)+$", "(Lazy)+$"):
    _HOOK = f"regexp_replace({_HOOK}, '{_p}', '')"
_KEBAB = "lower(regexp_replace(regexp_replace({}, '([A-Z])', '-\\1', 'g'), '^-', ''))"
_VERBS = "('GET','POST','PUT','PATCH','DELETE','OPTIONS','HEAD')"
_HOOK_VERB = "CASE WHEN contains(lower({0}), 'create') OR contains(lower({0}), 'add') THEN 'POST' WHEN contains(lower({0}), 'update') OR contains(lower({0}), 'edit') OR contains(lower({0}), 'patch') THEN 'PUT' WHEN contains(lower({0}), 'delete') OR contains(lower({0}), 'remove') THEN 'DELETE' ELSE 'GET' END"
_SHARED = "(SELECT count(*) FROM (SELECT unnest(range(1, 20)) AS i) WHERE i <= least(len(a), len(b)) AND list_slice(a, 1, i) = list_slice(b, 1, i))"
_CLEAN = "nullif(regexp_replace({}, '^/+|/+$', '', 'g'), '')"

ORACLE_SQL = {
    "name_resolution_ladder": ctes("python_calls", "functions")
    + ", k AS (SELECT call_id, node_id, c.file AS x, f.file AS y, string_split(regexp_extract(c.file, '^(.*)/[^/]*$', 1), '/') AS a, string_split(regexp_extract(f.file, '^(.*)/[^/]*$', 1), '/') AS b FROM python_calls c JOIN functions f ON callee = string_split(name, '::')[-1]) SELECT call_id, node_id FROM (SELECT call_id, node_id, row_number() OVER (PARTITION BY call_id ORDER BY x = y DESC, regexp_extract(x, '^(.*)/[^/]*$', 1) = regexp_extract(y, '^(.*)/[^/]*$', 1) DESC, "
    + _SHARED
    + " DESC, node_id) AS r FROM k) WHERE r = 1",
    "zod_usage_asof_call": ctes("usages", "api_calls") + " SELECT usage_id, call_id, call_line FROM (SELECT usage_id, call_id, c.line AS call_line, row_number() OVER (PARTITION BY usage_id ORDER BY c.line, call_id) AS r FROM usages u JOIN api_calls c ON u.file = c.file AND c.line >= u.line) WHERE r = 1",
    "event_asof_next": "SELECT usage_id, call_id FROM (SELECT v.event_id AS usage_id, p.event_id AS call_id, row_number() OVER (PARTITION BY v.event_id ORDER BY p.ts, p.event_id) AS r FROM events v JOIN events p ON v.user_id = p.user_id AND p.ts >= v.ts AND p.event_type = 'purchase' WHERE v.event_type = 'view') WHERE r = 1",
    "zod_pydantic_compare": ctes("zod_fields", "pydantic_fields")
    + ", j AS (SELECT coalesce(z.field, p.field) AS field, z.field_type AS zod_type, p.field_type AS pydantic_type, z.optional AS a, p.optional AS b FROM zod_fields z FULL OUTER JOIN pydantic_fields p ON z.field = p.field) SELECT field, zod_type, pydantic_type, 'Field missing in Pydantic' AS reason FROM j WHERE pydantic_type IS NULL UNION ALL SELECT field, zod_type, pydantic_type, 'Field missing in Zod' FROM j WHERE zod_type IS NULL"
    + " UNION ALL SELECT field, zod_type, pydantic_type, 'Type mismatch' FROM j WHERE NOT (zod_type = pydantic_type OR (zod_type, pydantic_type) IN (('string','str'),('number','int'),('number','float'),('boolean','bool')) OR (zod_type = 'array' AND starts_with(pydantic_type, 'list[')) OR (zod_type = 'object' AND starts_with(pydantic_type, 'dict['))) UNION ALL SELECT field, zod_type, pydantic_type, 'Optionality mismatch' FROM j WHERE a <> b",
    "name_functions": ctes("names")
    + f" SELECT name, {_KEBAB.format('name')} AS kebab, {_SUFFIX} AS bare, '/' || {_KEBAB.format(_HOOK)} AS hook_path, {_HOOK_VERB.format('string_split(name, chr(46))[-1]')} AS hook_verb, CASE WHEN upper(split_part(name, '.', 2)) IN {_VERBS} THEN upper(split_part(name, '.', 2)) ELSE 'GET' END AS verb, string_split(name, '.')[-1] AS last_part, regexp_extract(name, '^(.*)::', 1) AS key_path, string_split(name, ':')[-1] AS handler, '/api/' || replace(regexp_replace(name, '^actions\\.', ''), '.', '/') AS action_path, CASE WHEN strlen(name) > 8 THEN list_max(list_filter([name[1:i] for i in range(0, 9)], lambda x: strlen(x) <= 8)) || '...' ELSE name END AS short FROM names",
    "combine_paths": ctes("paths") + f", s AS (SELECT base, path, string_split(base, '/') AS a, string_split(path, '/') AS b FROM paths) SELECT base, path, '/' || concat_ws('/', {_CLEAN.format('base')}, {_CLEAN.format('path')}) AS joined, CAST({_SHARED} AS INT) AS shared FROM s",
    "page_paths": "SELECT page_id, regexp_extract(u, '^https?://([^/]+)', 1) AS host, regexp_replace(u, '^https?://[^/]+', '') AS path FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages)",
    "content_hashes": "SELECT sha256(text) AS sha, min(doc_id) AS first_doc, count(*) AS files FROM documents GROUP BY 1",
    "spec_best_response": ctes("endpoints") + ", k AS (SELECT *, row_number() OVER (PARTITION BY path, method ORDER BY code LIKE '2%' DESC, code = '200' DESC, code = '201' DESC, code, response) AS r FROM endpoints) SELECT path, method, CASE WHEN code LIKE '2%' AND response IS NOT NULL THEN code END AS code, CASE WHEN code LIKE '2%' THEN response END AS response FROM k WHERE r = 1",
    "route_endpoint_match": ctes("routes", "endpoints") + ", k AS (SELECT *, row_number() OVER (PARTITION BY path, method ORDER BY code LIKE '2%' DESC, code = '200' DESC, code = '201' DESC, code, response) AS r FROM endpoints) SELECT node_id, routes.path, routes.method, CASE WHEN code LIKE '2%' THEN response END AS response FROM routes JOIN k ON k.path = routes.path AND upper(k.method) = routes.method AND r = 1",
    "route_coverage": ctes("routes", "endpoints") + f", s AS (SELECT DISTINCT path, upper(method) AS method FROM endpoints WHERE upper(method) IN {_VERBS}), c AS (SELECT DISTINCT path, method FROM routes) SELECT path, method, 'spec' AS missing_in FROM c ANTI JOIN s USING (path, method) UNION ALL SELECT path, method, 'code' FROM s ANTI JOIN c USING (path, method)",
    "virtual_routes": ctes("routes", "endpoints") + " SELECT DISTINCT path, upper(method) AS method, string_split(operation_id, ':')[-1] AS handler FROM endpoints e WHERE operation_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM routes r WHERE r.path = e.path AND r.method = upper(e.method))",
    "pydantic_orm_score": ctes("models")
    + f", m AS (SELECT DISTINCT model_id, name, kind, from_attributes, {_SUFFIX} AS bare FROM models), p AS (SELECT * FROM m WHERE kind = 'Pydantic' AND from_attributes), o AS (SELECT * FROM m WHERE kind = 'OrmModel'), n AS (SELECT model_id, count(*) AS n FROM models GROUP BY 1),"
    + f" k AS (SELECT a, b, count(*) AS k FROM (SELECT l.model_id AS a, r.model_id AS b, r.field_type AS x, l.field_type AS y FROM models l JOIN models r ON l.kind = 'Pydantic' AND l.from_attributes AND r.kind = 'OrmModel' AND l.field = r.field AND l.optional = r.optional) WHERE {_FITS['orm']} GROUP BY 1, 2),"
    + " c AS (SELECT p.model_id, o.model_id AS orm_id, o.name, CAST(1.0 AS DOUBLE) AS score FROM p JOIN o ON p.name = o.name UNION ALL SELECT p.model_id, o.model_id, o.name, 0.9 FROM p JOIN o ON p.bare = o.name UNION ALL SELECT a, b, o.name, round(CAST(k AS DOUBLE) / greatest(x.n, y.n), 6) FROM k JOIN n x ON x.model_id = a JOIN n y ON y.model_id = b JOIN o ON o.model_id = b WHERE CAST(k AS DOUBLE) / greatest(x.n, y.n) > 0.7) SELECT model_id, orm_id, score FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY score DESC, name, orm_id) AS r FROM c) WHERE r = 1",
    "spec_link_ladder": ctes("models", "components")
    + f", p AS (SELECT DISTINCT model_id, name, {_SUFFIX} AS bare FROM models WHERE kind = 'Pydantic'), o AS (SELECT DISTINCT name AS component FROM components), n AS (SELECT model_id, count(*) AS n FROM models GROUP BY 1), q AS (SELECT name, count(*) AS n FROM components GROUP BY 1),"
    + f" k AS (SELECT a, b, count(*) AS k FROM (SELECT l.model_id AS a, r.name AS b, r.field_type AS x, l.field_type AS y FROM models l JOIN components r ON l.kind = 'Pydantic' AND l.field = r.field) WHERE {_FITS['spec']} GROUP BY 1, 2),"
    + " c AS (SELECT model_id, component, 1 AS rank, CAST(1.0 AS DOUBLE) AS score FROM p JOIN o ON name = component UNION ALL SELECT model_id, component, 2, 1.0 FROM p JOIN o ON lower(name) = lower(component) UNION ALL SELECT model_id, component, 3, 1.0 FROM p JOIN o ON lower(bare) = lower(component) UNION ALL SELECT a, b, 4, round(CAST(k AS DOUBLE) / greatest(n.n, q.n), 6) FROM k JOIN n ON n.model_id = a JOIN q ON q.name = b WHERE CAST(k AS DOUBLE) / greatest(n.n, q.n) >= 0.7) SELECT model_id, component, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY rank, score DESC, lower(component)) AS r FROM c) WHERE r = 1",
    "external_dependencies": ctes("imports", "requirements", "installed") + ", r AS (SELECT DISTINCT regexp_extract(line, '^([A-Za-z0-9_.\\-]+)', 1) AS root FROM requirements) SELECT import_id, i.module, CASE WHEN r.root IS NULL THEN 'local' WHEN n.module IS NOT NULL THEN 'installed' ELSE 'ExternalDependency' END AS status FROM imports i LEFT JOIN r ON r.root = split_part(i.module, '.', 1) LEFT JOIN installed n ON n.module = split_part(i.module, '.', 1)",
    "router_generators": ctes("router_calls", "router_catalog") + " SELECT call_id, ord, method, prefix || path AS path, nullif(string_split(args, ',')[request_arg + 1], '') AS request, nullif(string_split(args, ',')[response_arg + 1], '') AS response FROM router_calls JOIN router_catalog USING (generator)",
    "api_call_classify": ctes("calls", "sdk_calls")
    + f", p AS (SELECT *, string_split(callee, '.') AS s, CASE WHEN generics = '' THEN [] ELSE string_split(generics, '|') END AS g FROM calls), k AS (SELECT *, upper(s[2]) IN {_VERBS} AS v, CASE WHEN callee = 'fetch' THEN 'fetch' WHEN s[1] = 'axios' AND len(s) = 2 AND upper(s[2]) IN {_VERBS} THEN 'axios' WHEN s[1] IN ('api','client','http','request') AND upper(s[2]) IN {_VERBS} THEN 'client' WHEN base = 'client' AND upper(property) IN {_VERBS} THEN 'base' WHEN callee IN ('useQuery','useMutation') AND regexp_matches(arg, 'gql|graphql') THEN 'apollo' WHEN callee IN ('useQuery','useMutation') THEN 'tanstack' WHEN callee IN ('useSWR','useSWRMutation') THEN 'swr' WHEN contains(callee, '.use') AND (contains(callee, 'Query') OR contains(callee, 'Mutation')) THEN 'rtk' WHEN starts_with(callee, 'actions.') THEN 'action' WHEN d.method IS NOT NULL THEN 'sdk' END AS rule FROM p LEFT JOIN (SELECT name, method, path AS sdk_path FROM sdk_calls) d ON d.name = callee)"
    + f" SELECT file, ord, rule, CASE WHEN rule = 'fetch' THEN coalesce(nullif(upper(regexp_extract(options, 'method:\\s*[\"'']?([A-Za-z]+)', 1)), ''), 'GET') WHEN rule IN ('axios','client') THEN upper(s[2]) WHEN rule IN ('apollo','action') THEN 'POST' WHEN rule IN ('tanstack','swr') THEN CASE WHEN contains(callee, 'Mutation') THEN 'POST' ELSE 'GET' END WHEN rule = 'base' THEN upper(property) WHEN rule = 'sdk' THEN k.method ELSE {_HOOK_VERB.format('string_split(callee, chr(46))[-1]')} END AS method,"
    + f" CASE WHEN rule = 'apollo' THEN '/graphql' WHEN rule = 'rtk' THEN '/' || {_KEBAB.format(_HOOK.replace('name', 'callee'))} WHEN rule = 'action' THEN '/api/' || replace(regexp_replace(callee, '^actions\\.', ''), '.', '/') WHEN rule = 'sdk' THEN sdk_path WHEN rule = 'base' AND contains(arg, 'url:') THEN string_split(split_part(arg, 'url:', 2), '\"')[2] ELSE arg END AS path, CASE WHEN rule IN ('apollo','tanstack','swr','rtk') THEN g[1] END AS response, CASE WHEN rule IN ('apollo','rtk') THEN g[2] WHEN rule = 'tanstack' AND callee = 'useMutation' THEN g[3] WHEN rule = 'swr' AND callee = 'useSWRMutation' AND len(g) = 4 THEN g[4] END AS request FROM k WHERE rule IS NOT NULL",
}
