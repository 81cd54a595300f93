"""Commands on a small project of both sides, and what the driver finds in folders."""

import json
import os

import pytest

from linkweave import cli
from linkweave.operators import contracts, reports
from linkweave.plans import python_graph, typescript_graph
from linkweave.sources import project, spec

SPEC = """{"openapi": "3.0.0", "paths": {"/orders": {"post": {"operationId": "addOrder", "requestBody": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/OrderIn"}}}},
"responses": {"200": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/OrderOut"}}}}}}}}}"""
FRONTEND = """import { addOrder } from '@/api/sdk.gen';
const OrderIn = z.object({ title: z.string() });
OrderIn.parse(input);
addOrder(input);
"""


@pytest.fixture
def folder(tmp_path):
    for name, text in python_graph.EXAMPLE.items():
        (tmp_path / "back" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "back" / name).write_text(text)
    (tmp_path / "back/requirements.txt").write_text("fastapi==1\npydantic\n")
    for name, text in {"web/src/app.ts": FRONTEND, "web/src/api/sdk.gen.ts": "export function addOrder(o: OrderIn) { return client.post({ url: '/orders' }) }\n", "web/tsconfig.json": json.dumps({"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"]}}}), "openapi.json": SPEC}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "p.toml").write_text('project_name = "shop"\n[[adapters]]\ntype = "fastapi"\napp_path = "back/shop/main.py"\n[[adapters]]\ntype = "typescript"\nsrc_paths = ["web/src"]\n[output]\npath = "out/report.md"\n')
    return tmp_path


def test_check_and_visualize(spark, folder):
    path = cli.check(spark, str(folder / "p.toml"))
    text = open(path, encoding="utf-8").read()
    assert text.startswith("# Data chain report") and "POST /orders" in text and "missing validation schema" in text and "Zod OrderIn → Pydantic OrderIn" in text
    assert "**OrderIn** (Pydantic Model) → **OrderIn** (Pydantic Model) → **OrderIn** (Pydantic Model)" in text
    drawn = cli.visualize(spark, str(folder / "p.toml"))
    assert [os.path.basename(p) for p in drawn] == ["fastapi_0.dot", "typescript_1.dot"]
    dots = [open(p, encoding="utf-8").read() for p in drawn]
    assert dots[0].startswith("digraph fastapi_0 {") and "Route /orders" in dots[0] and "style=dashed" in dots[0] and "addOrder" in dots[1]


def test_zod_chains_end_at_models_in_any_order_of_adapters(spark, folder):
    text = (folder / "p.toml").read_text()
    head, back, front, tail = text.partition("[[adapters]]\ntype = \"fastapi\"")[0], '[[adapters]]\ntype = "fastapi"\napp_path = "back/shop/main.py"\n', '[[adapters]]\ntype = "typescript"\nsrc_paths = ["web/src"]\n', '[output]\npath = "out/r.json"\n'
    (folder / "q.toml").write_text(head + front + back + tail)
    data = json.loads(open(cli.check(spark, str(folder / "q.toml"), "json"), encoding="utf-8").read())
    [chain] = [c for c in data["chains"] if c["name"].startswith("Zod ")]
    assert chain["name"] == "Zod OrderIn → Pydantic OrderIn"
    assert [(x["pos"], x["link_type"], x["schema_type"]) for x in chain["links"]] == [(0, "Source", "Zod"), (1, "Transformer", "TypeScript"), (2, "Sink", "Pydantic")]
    assert [x["file"].rsplit("/", 1)[-1] for x in chain["links"]] == ["app.ts", "app.ts", "__init__.py"]
    last = chain["contracts"][-1]
    assert (last["pos"], last["severity"]) == (1, "Warning")
    assert {"FieldMismatch"} == {m["mismatch_type"] for m in last["mismatches"] if m["level"] == "Medium"} and any("Field missing in" in m["message"] for m in last["mismatches"])


def test_report_as_json(spark, tmp_path):
    g = python_graph._graph(spark)
    links = python_graph.materialize(python_graph.chains(g), "links")
    found = python_graph.link_contracts(links)
    wrong = python_graph.check(g, found)
    reports.write_report(str(tmp_path / "r.json"), "json", links, python_graph.report(found, wrong), wrong)
    data = json.loads((tmp_path / "r.json").read_text())
    assert data["version"] == "1.0.0" and data["summary"]["chains"] == len(data["chains"]) == 9 and data["summary"]["warnings"] == 1 and data["summary"]["critical"] == 0
    [raw] = [c for c in data["chains"] if c["name"] == "GET /raw"]
    assert sorted(m["level"] for m in raw["contracts"][0]["mismatches"]) == ["Critical", "High"]


def test_components_of_a_specification_are_compared(spark):
    g = python_graph._graph(spark)
    text = '{"required": ["gone"], "properties": {"title": {"type": "integer"}, "gone": {"type": "string", "pattern": "^x"}}}'
    components = spark.createDataFrame([("Described", text), ("Other", '{"properties": {"title": {"type": "string"}, "gone": {"type": "string"}}}')], "name string, schema string")
    more = cli.with_components(g, components)
    assert more.fields.filter("name in ('Described', 'Other')").count() == 4 and more.fields.count() == g.fields.count() + 4
    row = lambda k, a, b: (f"c{k}", 0, a, "Pydantic", False, b, "Pydantic", False, None)
    found = spark.createDataFrame([row(0, "Described", "Other"), row(1, "Other", "Described")], "chain_id string, pos int, from_schema string, from_type string, from_missing boolean, to_schema string, to_type string, to_missing boolean, transformation string")
    got = {(r.chain_id, r.mismatch_type, r.path) for r in python_graph.check(more, found).collect()}
    assert got == {("c0", "TypeMismatch", "title"), ("c1", "TypeMismatch", "title"), ("c1", "UnnormalizedData", "gone")}
    assert python_graph.check(g, found).collect() == []


def test_init_and_logging(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert cli.main(["--log-file", "x.log", "init", "new.toml"]) == 0 and cli.main(["--log-file", "x.log", "init", "new.toml"]) == 1
    with pytest.raises(spec.ConfigError):  # its paths aren't there
        spec.load_config("new.toml")
    (tmp_path / "server").mkdir()
    (tmp_path / "server/main.py").write_text("")
    (tmp_path / "client/src").mkdir(parents=True)
    assert [a["type"] for a in spec.load_config("new.toml").adapters] == ["fastapi", "typescript"]
    assert "there is a configuration already" in (tmp_path / "x.log").read_text()
    assert cli.main(["check", "-c", "none.toml"]) == 1
    cli.set_up_logging("warning", console=False)
    assert cli.log.level == 30 and not cli.log.handlers


def test_drawings_go_beside_each_other():
    assert reports.dot_file("out/g.dot", "typescript_1", True) == "out/g-typescript_1.dot" and reports.dot_file("out/g.dot", "x", False) == "out/g.dot"
    assert reports.dot_file("out", "fastapi_0", True) == os.path.join("out", "fastapi_0.dot")


def test_folders(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("VIRTUAL_ENV", raising=False)
    (tmp_path / "a/b/c").mkdir(parents=True)
    (tmp_path / "a/setup.py").write_text("")
    (tmp_path / "a/b/c/main.py").write_text("")
    assert project.python_root(str(tmp_path / "a/b/c/main.py")) == str(tmp_path / "a")
    assert project.find_entry(str(tmp_path / "a/b/c")).endswith("c/main.py") and project.find_entry(str(tmp_path / "a"), "b/c/main.py").endswith("c/main.py")
    for asked, error in (("../x.py", ValueError), ("none.py", FileNotFoundError)):
        with pytest.raises(error):
            project.find_entry(str(tmp_path / "a/b"), asked)
    with pytest.raises(FileNotFoundError):
        project.find_entry(str(tmp_path))
    assert project.common_folder(["/x/ab/c", "/x/abc"]) == "/x" and project.common_folder(["a", "b"]) == ""
    (tmp_path / "a/package.json").write_text("{}")
    assert project.frontend_root([str(tmp_path / "a/b/c"), str(tmp_path / "a/b")]) == str(tmp_path / "a") and project.frontend_root([]) == "."
    site = tmp_path / "a/venv/lib/python3.13/site-packages"
    (site / "pkg").mkdir(parents=True)
    (site / "pkg/__init__.py").write_text("")
    (site / "one.py").write_text("")
    folders = project.site_packages(str(tmp_path / "a"))
    assert folders == [str(site)] and project.find_module("pkg", folders) == str(site / "pkg") and project.find_module("one", folders) == str(site / "one.py") and project.find_module("no", folders) is None
    assert {r.module for r in project.installed_modules(spark, folders).collect()} == {"pkg", "one"}
    (tmp_path / "a/pyproject.toml").write_text('[project]\ndependencies = ["fastapi>=1"]\n[tool.poetry.dependencies]\npython = "3"\nhttpx = "1"\n')
    assert [r.line for r in project.requirement_lines(spark, str(tmp_path / "a")).collect()] == ["fastapi>=1", "httpx"]


def test_path_mappings_extend_and_do_not_go_round(tmp_path):
    (tmp_path / "base").mkdir()
    (tmp_path / "tsconfig.json").write_text(json.dumps({"extends": "./base", "compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["x/*", 3], "y": "no"}}}))
    (tmp_path / "base/tsconfig.base.json").write_text(json.dumps({"extends": "..", "compilerOptions": {"baseUrl": "lib", "paths": {"~": ["z.ts"]}}}))
    assert project.path_mappings(str(tmp_path)) == (str(tmp_path / "src"), [("~", "z.ts"), ("@/*", "x/*")])
    (tmp_path / "tsconfig.json").write_text("{ // no json")
    assert project.path_mappings(str(tmp_path)) == (str(tmp_path), [])


def test_rules_and_generators_can_be_added(spark):
    pairs = spark.createDataFrame([(0, 1)], "from_no int, to_no int")
    schemas, limits = contracts.literal(spark, "schemas"), contracts.literal(spark, "constraints")
    rule = lambda p, s, f: p.selectExpr("from_no", "to_no", "'Odd' AS mismatch_type", "'' AS path", "'Low' AS level", "'odd pair' AS message")
    contracts.add_rule("odd", rule)
    try:
        assert "Odd" in {r.mismatch_type for r in contracts.run_rules(pairs, schemas, limits).collect()}
    finally:
        contracts.remove_rule("odd")
    assert "Odd" not in {r.mismatch_type for r in contracts.run_rules(pairs, schemas, limits).collect()}
    files = spark.createDataFrame([("m.py", "app.include_router(lib.make(A, B), prefix='/p')\nlib.get_users_router(A)\nother.make(A)\n")], "path string, content string")
    facts = python_graph.python_source.extract(files)
    declared = {"generators": [{"module": "lib", "method": "make", "schema_params": ["response_schema", "request_schema"], "endpoints": [{"path": "/x", "method": "FETCH"}, {"path": "/y", "method": "put", "response_schema_param": 1}]}]}
    found = python_graph.python_routers(facts, "m.py", python_graph.router_catalogue(spark, declared))
    got = {tuple(r)[2:] for r in found.collect()}
    assert {("GET", "/p/x", "B", "A"), ("PUT", "/p/y", "B", "B")} <= got and ("GET", "/p/me", None, "A") in got and len([x for x in got if x[1] in ("/p/x", "/p/y")]) == 2
    python_graph.register_generator("other_kind", [("GET", "/z", None, 0)])
    assert "other_kind" in {r.generator for r in python_graph.router_catalogue(spark).collect()}
    python_graph._generators.clear()


def test_strict_imports_and_depth(spark):
    files = spark.createDataFrame([("a.py", "import b\nimport fastapi\n"), ("b.py", "import c\n"), ("c.py", "")], "path string, content string")
    facts = python_graph.python_source.extract(files)
    assert {r.path for r in python_graph.reached(facts, files, "a.py")[0].collect()} == {"a.py", "b.py", "c.py"}
    assert {r.path for r in python_graph.reached(facts, files, "a.py", max_depth=2)[0].collect()} == {"a.py", "b.py"}
    with pytest.raises(ValueError, match="fastapi"):
        python_graph.reached(facts, files, "a.py", strict=True)
    assert python_graph.entry_point(files.selectExpr("'x/app.py' AS path"), "x") == "x/app.py" and python_graph.entry_point(files) is None


def test_classes_of_a_long_line_are_models(spark):
    text = "class M0(BaseModel):\n    a: int\n" + "".join(f"class M{k}(M{k - 1}):\n    f{k}: str\n" for k in range(1, 31))
    facts = python_graph.python_source.extract(spark.createDataFrame([("m.py", text), ("n.py", "class X(Y): pass\nclass Y(X): pass\n")], "path string, content string"))
    assert python_graph.python_source.models(facts).count() == 31


def test_controllers_get_routes(spark):
    files = spark.createDataFrame([("c.ts", "@Controller('c') class C { @Post('x') add(@Body() dto: Dto): Promise<Item> { return go(dto) } }\nclass Dto { @IsString() a: string }\n")], "path string, content string")
    g = typescript_graph.build(files, cli.endpoints_of(spark, None), controllers=True)
    [route] = g.nodes.filter("kind = 'Route'").collect()
    assert (route.method, route.route, route.request, route.response) == ("POST", "/c/x", "Dto", "Item")
    assert [r.id for r in python_graph.chains(g).orderBy("pos").collect()] == ["route--c-x", "method-add"]
