"""Facts of Python sources: definitions, calls, imports, decorators, models.  Sources are parsed, never run.

One pass over each file gives rows of one wide table; files with errors give an error row and stop nothing.

``extra`` holds what a fact has besides, as JSON: ``top`` for imports of the module's own statements; [name, value] pairs of a call's arguments and of a field's
constraints; default of a parameter; parts of a text ([0, text] or [1, variable]) of an assignment or a router's prefix."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkweave.functions import annotations, names
from linkweave.plans.fixtures import per_supplier, per_supplier_sql
from linkweave.session import materialize

FACTS = "path string, ord int, fact string, name string, owner string, detail string, line int, extra string"

#: Example sources for the query.
EXAMPLE = {
    "main.py": "from fastapi import FastAPI, APIRouter\nimport os\nfrom .schemas import ItemRead\napp = FastAPI()\n\n@app.get('/items/{item_id}', response_model=ItemRead)\nasync def get_item(item_id: int, q: str | None = None) -> ItemRead:\n    return ItemRead.model_validate(load(item_id))\n\n@app.post('/items/')\ndef create_item(item):\n    return save(item, flag=True)\n",
    "schemas.py": "from typing import Optional\nfrom pydantic import BaseModel, Field\n\nclass ItemBase(BaseModel):\n    title: str = Field(min_length=1)\n    note: Optional[str] = None\n\nclass ItemRead(ItemBase):\n    id: int\n    tags: list[str] = []\n    def label(self) -> str:\n        return self.title.upper()\n",
    "broken.py": "def broken(:\n",
    "empty.py": "",
}


def dotted(node: ast.expr) -> str:
    """Text of a dotted name; what isn't a name becomes nothing."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = dotted(node.value)
        return f"{base}.{node.attr}" if base else node.attr
    if isinstance(node, ast.Call):
        return dotted(node.func)
    return ""


def text_parts(node: ast.expr) -> str:
    """A text or formatted text as JSON parts: [0, text], [1, variable]; empty for other expressions."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return json.dumps([[0, node.value]])
    if isinstance(node, ast.JoinedStr):
        parts = [[0, x.value] if isinstance(x, ast.Constant) else [1, dotted(x.value)] for x in node.values if isinstance(x, ast.Constant) or dotted(x.value)]
        return json.dumps(parts or [[0, ""]])
    return ""


#: Arguments of Field() that bound a field, and the constraints that they make (fixed values).
BOUNDS = {"min_length": "MinLength", "max_length": "MaxLength", "min": "MinValue", "max": "MaxValue", "regex": "Pattern", "pattern": "Pattern"}


def constraints_of(value: ast.expr | None) -> list[list[str]]:
    """[kind, value] of the bounds in a call of Field(); bounds that aren't plain numbers are left out."""
    if not isinstance(value, ast.Call) or dotted(value.func).rpartition(".")[2] != "Field":
        return []
    found = []
    for k in value.keywords:
        kind, text = BOUNDS.get(k.arg or ""), k.value.value if isinstance(k.value, ast.Constant) else None
        whole = isinstance(text, int) and not isinstance(text, bool) and text >= 0
        if kind == "Pattern" or (kind in ("MinLength", "MaxLength") and whole) or (kind in ("MinValue", "MaxValue") and isinstance(text, int | float)):
            found.append([kind, str(text) if text is not None else ast.unparse(k.value)])
    return found


def facts_of(path: str, content: str | None) -> list[tuple]:
    rows: list[tuple] = []

    def add(fact: str, name: str, owner: str, detail: str, line: int, extra: str = "") -> None:
        rows.append((path, len(rows), fact, name, owner, detail, line, extra))

    try:
        tree = ast.parse(content or "")
    except (SyntaxError, ValueError, RecursionError) as error:
        return [(path, 0, "error", type(error).__name__, "", "", getattr(error, "lineno", None) or 0, "")]

    def signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
        a = node.args
        every = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
        shown = ",".join(f"{x.arg}:{ast.unparse(x.annotation)}" if x.annotation else x.arg for x in every)
        return f"({shown})" + (f"->{ast.unparse(node.returns)}" if node.returns else "")

    def parameters(node: ast.FunctionDef | ast.AsyncFunctionDef, owner: str) -> None:
        a = node.args
        plain = [*a.posonlyargs, *a.args]
        given = dict(zip(plain[len(plain) - len(a.defaults) :], a.defaults, strict=True)) | {x: d for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True) if d is not None}
        for x in [*plain, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]:
            add("param", x.arg, owner, ast.unparse(x.annotation) if x.annotation else "", x.lineno, ast.unparse(given[x]) if x in given else "")
        if node.returns:
            add("returns", "", owner, ast.unparse(node.returns), node.lineno)

    def statement(node: ast.stmt) -> None:
        """Assignments, routers and calls among the module's own statements."""
        if isinstance(node, ast.Assign | ast.AnnAssign) and node.value is not None:
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(target, ast.Name):
                    add("assign", target.id, "", ast.unparse(node.value), node.lineno, text_parts(node.value))
        elif isinstance(node, ast.Expr) and isinstance(node.value, ast.Call):
            call = node.value
            included = isinstance(call.func, ast.Attribute) and call.func.attr == "include_router"
            prefix = next((text_parts(k.value) for k in call.keywords if k.arg == "prefix"), "") if included else ""
            router = (call.args[0] if call.args and isinstance(call.args[0], ast.Call) else None) if included else call
            named = [dotted(x) for x in router.args if isinstance(x, ast.Name | ast.Attribute)] if router else []
            add("include_router" if included else "plain_call", dotted(router.func) if router else "", "", ",".join(named), node.lineno, prefix)

    def decorators(node: ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef, owner: str) -> None:
        for d in node.decorator_list:
            args = [*map(ast.unparse, d.args), *(f"{k.arg}={ast.unparse(k.value)}" for k in d.keywords)] if isinstance(d, ast.Call) else []
            add("decorator", dotted(d), owner, ",".join(args), d.lineno)

    def walk(node: ast.AST, owner: str) -> None:
        for child in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(child, ast.Import):
                for x in child.names:
                    add("import", x.name, owner, x.asname or "", child.lineno, "top" if node is tree else "")
            elif isinstance(child, ast.ImportFrom):
                add("import", "." * child.level + (child.module or ""), owner, ",".join(x.name for x in child.names), child.lineno, "top" if node is tree else "")
            elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                inner = f"{owner}.{child.name}" if owner else child.name
                add("method" if isinstance(node, ast.ClassDef) else "function", child.name, owner, signature(child), child.lineno, "async" if isinstance(child, ast.AsyncFunctionDef) else "")
                parameters(child, inner)
                decorators(child, inner)
            elif isinstance(child, ast.ClassDef):
                inner = f"{owner}.{child.name}" if owner else child.name
                add("class", child.name, owner, ",".join(map(dotted, child.bases)), child.lineno)
                decorators(child, inner)
            elif isinstance(child, ast.AnnAssign) and isinstance(node, ast.ClassDef) and isinstance(child.target, ast.Name):
                add("field", child.target.id, owner, ast.unparse(child.annotation) + ("" if child.value is None else " = ..."), child.lineno, json.dumps(constraints_of(child.value)))
            elif isinstance(child, ast.Call):
                add("call", dotted(child.func), owner, str(len(child.args) + len(child.keywords)), child.lineno, json.dumps([[f"arg{k}", ast.unparse(x)] for k, x in enumerate(child.args)] + [[x.arg or "", ast.unparse(x.value)] for x in child.keywords]))
            elif isinstance(child, ast.Assign | ast.AnnAssign) and isinstance(node, ast.ClassDef) and isinstance(child.value, ast.Dict):
                if any(isinstance(t, ast.Name) and t.id == "model_config" for t in (child.targets if isinstance(child, ast.Assign) else [child.target])):
                    for k, v in zip(child.value.keys, child.value.values, strict=True):
                        if k is not None:
                            add("config", k.value if isinstance(k, ast.Constant) and isinstance(k.value, str) else ast.unparse(k), owner, ast.unparse(v), child.lineno)
            elif isinstance(child, ast.Assign) and isinstance(node, ast.ClassDef) and node.name == "Config" and "." in owner:
                for t in child.targets:
                    if isinstance(t, ast.Name):
                        add("config", t.id, owner.rpartition(".")[0], ast.unparse(child.value), child.lineno)
            if node is tree:
                statement(child)
            walk(child, inner)

    walk(tree, "")
    return rows


def extract(files: DataFrame) -> DataFrame:
    """Facts of (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())
        names = [c.split()[0] for c in FACTS.split(", ")]
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if rows := facts_of(path, content):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, FACTS)


def routes(facts: DataFrame) -> DataFrame:
    """Routes by their decorators: verb, path, handler and response model."""
    found = facts.filter((F.col("fact") == "decorator") & annotations.is_route_decorator(F.col("name")))
    text = r"^(['\"])(.*?)\1"
    route = F.when(F.col("detail").rlike(text), F.regexp_extract("detail", text, 2)).otherwise("/")
    model = F.nullif(F.trim(F.regexp_extract("detail", r"response_model=((?:[^,\[]|\[[^\]]*\](?:\])*)*)", 1)), F.lit(""))
    return found.select("path", names.decorator_verb(F.col("name")).alias("method"), route.alias("route"), F.col("owner").alias("handler"), model.alias("response_model"), "line", "ord")


def models(facts: DataFrame) -> DataFrame:
    """Classes that come from BaseModel, over any number of steps: the models found last move the frontier, and what is known is written out for each step."""
    classes = materialize(facts.filter("fact = 'class'").select("path", "name", F.explode_outer(F.split("detail", ",")).alias("base")).withColumn("base", F.element_at(F.split("base", r"\."), -1)), "classes")
    frontier = materialize(classes.filter("base = 'BaseModel'").select("name").distinct(), "models")
    known = frontier
    while True:
        more = classes.join(frontier.select(F.col("name").alias("base")), "base").select("name").distinct().join(known, "name", "left_anti")
        frontier = materialize(more, "models")
        if frontier.isEmpty():
            return classes.join(known, "name", "left_semi").select("path", "name").distinct()
        known = materialize(known.unionByName(frontier), "models", instead_of=known)


def model_fields(facts: DataFrame) -> DataFrame:
    """(name, field, type_name, inner_type, optional, depth, ord, constraints) of the models: their own fields, then those of the classes they come from.

    Of two fields of one name the nearer counts."""
    found = models(facts).select("name").distinct()
    classes = facts.filter("fact = 'class'").select("name", F.explode_outer(F.split("detail", ",")).alias("base")).select("name", F.element_at(F.split("base", r"\."), -1).alias("base")).join(found, "name", "left_semi")
    classes = materialize(classes.distinct(), "bases")
    frontier = materialize(found.select("name", F.col("name").alias("from"), F.lit(0).alias("depth")), "ancestors")
    every = frontier
    while True:
        step = frontier.join(classes.select(F.col("name").alias("from"), F.col("base").alias("next")), "from").select("name", F.col("next").alias("from"), F.col("depth") + 1)
        step = step.toDF("name", "from", "depth").join(found.select(F.col("name").alias("from")), "from", "left_semi").join(every, ["name", "from"], "left_anti").distinct()
        frontier = materialize(step.select("name", "from", "depth"), "ancestors")
        if frontier.isEmpty():
            break
        every = every.unionByName(frontier)
    typed = annotations.with_generics(F.regexp_replace("detail", r" = \.\.\.$", ""))
    own = facts.filter("fact = 'field'").select(F.element_at(F.split("owner", r"\."), -1).alias("from"), F.col("name").alias("field"), "ord", typed.alias("t"), F.col("extra").alias("constraints"))
    rows = every.join(own, "from").select("name", "field", F.col("t.base").alias("type_name"), F.col("t.inner").alias("inner_type"), F.col("t.optional").alias("optional"), "depth", "ord", "constraints")
    w = Window.partitionBy("name", "field").orderBy("depth", "ord")
    return rows.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def orm_fields(facts: DataFrame) -> DataFrame:
    """(name, field, type_name, nullable) of mapped classes: annotated columns only, as the analysed tool reads them."""
    fields = facts.filter("fact = 'field'").select(F.col("owner").alias("name"), F.col("name").alias("field"), F.regexp_replace("detail", r" = \.\.\.$", "").alias("annotation"))
    of_class = fields.groupBy("name").agg(F.collect_list("annotation").alias("annotations"))
    classes = facts.filter("fact = 'class' and owner = ''").select("name", F.split("detail", ",").alias("bases")).join(of_class, "name", "left")
    mapped = classes.filter(annotations.is_orm_class(F.col("bases"), F.coalesce("annotations", F.array().cast("array<string>")))).select("name").distinct()
    column = annotations.column_type(F.col("annotation"))
    kept = fields.filter(F.col("annotation").rlike("Column|Mapped") & ~F.col("field").startswith("__"))
    return kept.join(mapped, "name", "left_semi").select("name", "field", column["type_name"].alias("type_name"), column["nullable"].alias("nullable"))


def from_attributes(facts: DataFrame) -> DataFrame:
    """Models that say that they are made from attributes."""
    return facts.filter("fact = 'config' and name = 'from_attributes' and lower(detail) = 'true'").select(F.col("owner").alias("name")).distinct()


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The example's sources, and those of a team for each supplier."""
    return per_supplier(spark, sf_dir, EXAMPLE, "Item")


QUERIES = {
    "python_facts": lambda spark, sf_dir: extract(examples(spark, sf_dir)),
    "python_routes": lambda spark, sf_dir: routes(extract(examples(spark, sf_dir))).drop("ord"),
    "python_models": lambda spark, sf_dir: models(extract(examples(spark, sf_dir))),
}
ORACLE_SQL = {
    "python_routes": per_supplier_sql("SELECT * FROM (VALUES ('main.py', 'GET', '/items/{item_id}', 'get_item', 'ItemRead', 6), ('main.py', 'POST', '/items/', 'create_item', NULL, 10)) AS t(path, method, route, handler, response_model, line)", ('Item',), ('response_model',), ('path',)),
    "python_models": per_supplier_sql("SELECT * FROM (VALUES ('schemas.py', 'ItemBase'), ('schemas.py', 'ItemRead')) AS t(path, name)", ('Item',), ('name',), ('path',)),
}
