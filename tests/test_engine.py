"""Hand-worked cases and what has no oracle."""

import json
import os
import subprocess
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkweave.operators import contracts, graph, reports
from linkweave.plans.fixtures import literal
from linkweave.session import materialize, scratch_dir
from linkweave.sources import python_source, spec, typescript_source

PATH = "/root/testdata/sf0.001"


def test_rules_on_the_worked_schemas(spark):
    schemas, constraints = literal(spark, "schemas"), literal(spark, "constraints")
    pairs = spark.createDataFrame([(0, 1), (1, 0), (0, 0), (5, 0), (0, 5)], "from_no int, to_no int")
    found = {(r.from_no, r.to_no, r.mismatch_type, r.path, r.level) for r in contracts.run_rules(pairs, schemas, constraints).collect()}
    assert {x[2:] for x in found if x[:2] == (0, 1)} == {("TypeMismatch", "id", "High"), ("MissingField", "age", "High"), ("UnnormalizedData", "mail", "Medium")}
    assert {x[2:] for x in found if x[:2] == (1, 0)} == {("TypeMismatch", "id", "High")}
    assert not [x for x in found if x[:2] == (0, 0)]
    assert (5, 0, "MissingSchema", "", "Critical") in found and (0, 5, "MissingSchema", "", "High") in found
    severity = {(r.from_no, r.to_no): r.severity for r in contracts.severity_of_pairs(pairs, contracts.run_rules(pairs, schemas, constraints)).collect()}
    assert severity[0, 1] == "Critical" and severity[0, 0] == "Info" and severity[0, 5] == "Warning"


def test_walk_does_not_turn_back(spark):
    edges = spark.createDataFrame([(0, 1, 0), (1, 2, 1), (2, 0, 2), (1, 3, 3), (3, 3, 4), (3, 0, 5)], "src long, dst long, edge_id long")
    start = spark.createDataFrame([(0,)], "node_id long")
    assert graph.greedy_walk(start, edges).first().path == [0, 1, 3]
    assert graph.greedy_walk(start, edges, most=1).first().path == [0, 1, 3]
    long = spark.createDataFrame([(k, k + 1, k) for k in range(12)], "src long, dst long, edge_id long")
    assert graph.greedy_walk(start, long, most=2).first().path == list(range(13))  # walks longer than the first adjacency was made for


def test_saved_graph_round_trip_and_damage(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "a"), (2, "b")], "node_id long, name string")
    edges = spark.createDataFrame([(1, 2, 0)], "src long, dst long, edge_id long")
    reports.save_graph(nodes, edges, str(tmp_path / "g"))
    assert reports.load_graph(spark, str(tmp_path / "g"))[0].count() == 2
    reports.save_graph(nodes.limit(0), edges, str(tmp_path / "h"))
    with pytest.raises(ValueError, match="Corrupted cache"):
        reports.load_graph(spark, str(tmp_path / "h"))


def test_reports(spark, tmp_path):
    reports.write_markdown(spark, PATH, str(tmp_path / "m"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "m")).collect())
    assert "# Report" in text and "Coverage" in text
    reports.write_json(spark, PATH, str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first().value)["version"] == "1.0.0"


def test_python_facts():
    rows = python_source.facts_of("schemas.py", python_source.EXAMPLE["schemas.py"])
    assert ("class", "ItemRead", "", "ItemBase") in {r[2:6] for r in rows} and ("field", "note", "ItemBase", "Optional[str] = ...") in {r[2:6] for r in rows}
    assert python_source.facts_of("b.py", "def broken(:")[0][2:4] == ("error", "SyntaxError")
    assert python_source.facts_of("e.py", None) == []


def test_source_files_and_changes(spark, tmp_path):
    (tmp_path / "src/deep").mkdir(parents=True)
    for name in ("src/a.ts", "src/deep/b.tsx", "src/c.py"):
        (tmp_path / name).write_text(f"// {name}\n")
    files = spec.read_sources(spark, str(tmp_path / "src"), "*.{ts,tsx}")
    assert {os.path.basename(r.path) for r in files.collect()} == {"a.ts", "b.tsx"}
    known = files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha"))
    assert spec.changed(files, known.filter(F.col("path").endswith("a.ts"))).count() == 1


YAML_SPEC = """---
openapi: 3.0.0
paths:
  /items/:
    post:
      operationId: create_item
      requestBody: {content: {application/json: {schema: {$ref: '#/components/schemas/ItemCreate'}}}}
      responses:
        200: {}
        201: {content: {application/json: {schema: {$ref: '#/components/schemas/ItemRead'}}}}
components:
  schemas:
    ItemRead: {required: [id], properties: {id: {type: integer}, born: {type: string, example: 2024-01-01}}}
"""


def test_specs_of_both_kinds(spark, tmp_path):
    pytest.importorskip("yaml")
    for name, text in {"a.yaml": YAML_SPEC, "b.json": spec.EXAMPLE, "c.yml": "a: [", "d.txt": YAML_SPEC, "e.json": ""}.items():
        (tmp_path / name).write_text(text)
    specs = spec.read_specs(spark, [str(tmp_path)])
    found = spec.endpoints(specs.filter("path like '%/a.yaml'")).collect()
    assert [tuple(r) for r in found] == [("/items/", "POST", "create_item", "ItemCreate", None, None)]  # only the best code counts, and it has no schema
    assert {tuple(r) for r in spec.components(specs.filter("path like '%/d.txt'")).collect()} == {("ItemRead", "id", "integer", True), ("ItemRead", "born", "string", False)}
    assert spec.endpoints(specs).count() == 1 + 1 + 3
    assert specs.filter("path like '%/c.yml'").first().spec is None


def test_specification_is_found(tmp_path):
    assert spec.find_spec(str(tmp_path)) is None
    (tmp_path / "api").mkdir()
    (tmp_path / "api/swagger.json").write_text('{"swagger": "2.0"}')
    (tmp_path / "openapi.json").write_text("{}")
    assert spec.find_spec(str(tmp_path)) == str(tmp_path / "api/swagger.json")
    (tmp_path / "app.py").write_text("")
    (tmp_path / "c.toml").write_text('project_name = "p"\n[[adapters]]\ntype = "fastapi"\napp_path = "app.py"\n')
    config = spec.load_config(str(tmp_path / "c.toml"))
    assert config.openapi_path == config.adapters[0]["openapi_path"] == str(tmp_path / "api/swagger.json")


def test_config(tmp_path):
    (tmp_path / "app.py").write_text("")
    good = 'project_name = "p"\n[[adapters]]\ntype = "fastapi"\napp_path = "app.py"\n[output]\nformat = "json"\npath = "out.json"\n'
    path = tmp_path / "c.toml"
    path.write_text(good)
    config = spec.load_config(str(path))
    assert config.adapters[0]["app_path"] == str(tmp_path / "app.py") and config.output["path"] == str(tmp_path / "out.json")
    for bad in (good.replace('"p"', '""'), good.replace("fastapi", "django"), good.replace("app.py", "none.py"), good.replace('"json"', '"xml"'), 'project_name = "p"\n'):
        path.write_text(bad)
        with pytest.raises(spec.ConfigError):
            spec.load_config(str(path))


def test_scratch_is_the_shared_folder(spark):
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert scratch_dir(spark) == shared
    assert materialize(spark.range(3), "x").inputFiles()[0].startswith(shared)


def test_entry_works_without_the_llm_folders(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("linkweave", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", f"{root}/{name}", tmp_path], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/linkweave/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": ""})


def _ts(text):
    return {r[2:6] for r in typescript_source.facts_of("a.ts", text)}


def test_typescript_tokens():
    assert _ts("const r = /a[/]`{/g; f(`x${y({a:`}`})}z`); if (a < b && c > (d)) { g(a<b, c>d) }") == {("call", "f", "", "1"), ("call", "g", "", "1")}
    assert _ts("this.q?.(a)?.b.c<T[], U<V>>('x')") == {("call", "this.q", "", "1"), ("call", "this.q.b.c", "", "1")}
    assert typescript_source.facts_of("a.ts", "f(") == [("a.ts", 0, "error", "Unmatched", "", "", [], "", 1)]
    assert _ts("") == _ts("// f()\n/* g() */ 'h()'") == set() and typescript_source.facts_of("a.ts", None) == []


def test_typescript_classes_and_types():
    found = _ts("class A<T> extends B<T> { x = 1\n  y: Map<string, number> = new Map()\n  z?: { a: number }\n  m<U>(a?: T, ...b: U[]): T { return h(a)\n}\n get v() { return 1 } }")
    assert {("class", "A", "", "B"), ("field", "y", "A", "Map<string, number>"), ("field", "z", "A", "{ a: number }"), ("method", "m", "A", "T"), ("method", "v", "A", ""), ("call", "h", "A.m", "1")} <= found
    found = _ts("type C = { a: T } & B\ninterface D extends E<F> { readonly g: string, 'h-i'?: (x: number) => void; [k: string]: any; m(): void }")
    assert found == {("schema", "C", "", "{ a: T } & B"), ("schema", "D", "", "interface"), ("schema_field", "g", "D", "string"), ("schema_field", "h-i", "D", "(x: number) => void")}


def test_zod_schemas_that_count():
    assert not [r for r in _ts("export const A = z.object({a: z.string()}); const B = z.string().min(1); function f() { const C = z.object({c: z.string()}) }") if r[0].startswith("zod")]
    assert {r for r in _ts("const A = z.object({a: other.optional(), 'b': z.coerce.number(), c: z.array(z.string()).nullable().optional()})") if r[0] == "zod_field"} == {("zod_field", "a", "A", "unknown"), ("zod_field", "b", "A", "unknown"), ("zod_field", "c", "A", "array")}


@given(st.lists(st.sampled_from([*"@<>(){}[],.:;?=|&`'/\\ \n", "=>", "?.", "${", "class", "interface", "type", "const", "import", "from", "function", "async", "z", "object", "x", "extends", "'s'"]), max_size=40))
@settings(max_examples=400, deadline=None)
def test_typescript_never_fails(words):
    typescript_source.facts_of("a.ts", " ".join(words))
    typescript_source.facts_of("a.ts", "".join(words))
