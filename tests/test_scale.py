"""Steps whose work must not grow with pairs of rows or go through one task."""

from pyspark.sql import functions as F

from linkweave.functions import frontend as paths
from linkweave.operators import frontend, graph, increment, json_schema, linking, zod_chains
from linkweave.plans import fixtures

MODELS = "model_id long, name string, kind string, field string, field_type string, optional boolean, from_attributes boolean"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_next_call_looks_back_in_a_turned_order(spark):
    usages = spark.createDataFrame([(1, "a", 3), (2, "a", 5), (3, "a", 9), (4, None, 1), (5, "a", None)], "usage_id long, file string, line int")
    calls = spark.createDataFrame([(7, "a", 5), (6, "a", 5), (8, "a", 8), (9, None, 2)], "call_id long, file string, line int")
    found = linking.usage_to_call(usages, calls)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 6, 5), (2, 6, 5)]  # a file or line that isn't known meets nothing
    assert "unboundedfollowing" not in plan(found).lower().replace(" ", "")


def test_places_of_client_bodies_look_back(spark):
    functions = spark.createDataFrame([("c.ts", "get", 1), ("c.ts", "none", 4)], "file string, name string, line int")
    sources = spark.createDataFrame([("c.ts", "x\nclient.get(\n url: '/a'\nend")], "file string, content string")
    found = frontend.sdk_bodies(functions, sources)
    assert [tuple(r) for r in found.collect()] == [("c.ts", "get", "GET", "/a")]
    assert "unboundedfollowing" not in plan(found).lower().replace(" ", "")


def test_usages_of_one_id_make_one_chain(spark):
    schemas = spark.createDataFrame([(1, "A", "Zod")], "node_id long, name string, schema_type string")
    usages = spark.createDataFrame([(5, "A", "x.ts", 1), (5, "A", "x.ts", 1)], "usage_id long, schema_name string, file string, line int")
    calls = spark.createDataFrame([(1, "x.ts", 2)], "call_id long, file string, line int")
    routes = spark.createDataFrame([(9, "/a", "GET", "x.ts", 2)], "node_id long, path string, method string, file string, line int")
    endpoints = spark.createDataFrame([("/a", "get", None)], "path string, method string, request string")
    assert [r.chain_id for r in zod_chains.chains(schemas, usages, calls, routes, endpoints).collect()] == ["zod-A-to-api"]


def test_models_with_the_same_fields_are_compared_once(spark):
    """200 models a side and one set of fields: a pair of classes and no 40,000 pairs of models; repeated fields count as before."""
    rows = [(k, f"P{k}" if k < 200 else f"O{k}", "Pydantic" if k < 200 else "OrmModel", f, "int", False, True) for k in range(400) for f in ("a", "b", "b", "c")]
    models = spark.createDataFrame(rows, MODELS)
    found = linking.link_models(models).collect()
    assert len(found) == 200 and {(r.orm_id, r.score) for r in found} == {(200, 1.5)}  # a + 2 x 2 b + c over four
    side = lambda name, n: spark.createDataFrame([(k, f, "int") for k in range(n) for f in ("all", f"{k}x", f"{k}y")], f"{name}_id long, field string, {name}_type string")
    scores = linking.field_scores(side("left", 40), side("right", 40), lambda a, b: a == b, 0.7)
    assert sorted(tuple(r) for r in scores.collect()) == [(k, k, 1.0) for k in range(40)]
    pairs = linking._rarest(side("left", 40), "left", side("left", 40).groupBy("field").count().selectExpr("field", "count as many", "1 as repeats"), 0.7)
    assert pairs.filter("field = 'all'").isEmpty()


def test_sources_of_suppliers_are_dealt_to_all_cores(spark):
    table = fixtures.per_supplier(spark, "/root/testdata/sf0.01", {"a.ts": "let a = 1"}, "a")
    assert table.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism


def test_texts_of_schemas_are_dealt_to_all_cores(spark):
    assert json_schema._texts(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() > spark.sparkContext.defaultParallelism


def plans_of(monkeypatch, module, label):
    """Plans of the tables with this label that a module writes from now on."""
    seen, write = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, name="table", **kw: (seen.append(df._jdf.queryExecution().executedPlan().toString()) if name == label else None, write(df, name, **kw))[1])
    return seen


def test_walks_bring_no_graph_to_the_driver(spark, monkeypatch):
    seen = plans_of(monkeypatch, graph, "walks")
    edges = spark.createDataFrame([(1, 1, 2), (2, 2, 3)], "edge_id long, src long, dst long")
    found = graph.greedy_walk(spark.createDataFrame([(1,)], "node_id long"), edges)
    assert [tuple(r) for r in found.collect()] == [(1, [1, 2, 3])]
    assert len(seen) > 2 and not any("BroadcastExchange" in p for p in seen)


def test_closures_bring_no_steps_to_the_driver(spark, monkeypatch):
    seen = plans_of(monkeypatch, increment, "closure")
    steps = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "path string, resolved string")
    found = increment.closures(spark.createDataFrame([("a",)], "path string"), steps)
    assert sorted(tuple(r) for r in found.collect()) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2)]
    assert len(seen) > 2 and not any("BroadcastExchange" in p for p in seen)


def test_crowds_at_a_node_are_dealt_to_shares(spark):
    """Twenty starts at one node and one at another: the same rows as a plain join, and more than one share of the crowd."""
    frontier = spark.createDataFrame([(k, 1) for k in range(20)] + [(99, 2)], "start long, node_id long")
    links = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "src long, dst long")
    found = graph.hop(frontier, links, ["start"], crowd=4)
    assert sorted(tuple(r) for r in found.collect()) == sorted([(k, d) for k in range(20) for d in (5, 6)] + [(99, 5)])
    assert "share" in plan(found)


def test_parallel_edges_are_counted_before_starts_meet_them(spark):
    edges = spark.createDataFrame([(1, 2)] * 5, "src long, dst long")
    names = spark.createDataFrame([(1, "v"), (2, "v")], "node_id long, name string")
    found = graph.track_variable(names, edges, names)
    assert [tuple(r) for r in found.collect()] == [(1, "v", 1, 2)] * 5
    assert "array_repeat" in plan(found)


def test_starts_that_lead_to_one_another_are_followed_in_few_rounds(spark, monkeypatch):
    """A chain of 60 nodes into a circle: ways get twice as long in each round, and pairs are the same as those of a walk."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(60, 55), (57, 3 + 55), (60, 60), (59, 900)], "src long, dst long")
    starts = spark.createDataFrame([(k,) for k in range(61)] + [(None,)], "node_id long")
    seen = plans_of(monkeypatch, graph, "pairs")
    found = graph.reachable_together(starts, edges.distinct())
    assert 3 < len(seen) < 9
    assert sorted(tuple(r) for r in found.filter("start < 900").collect()) == sorted(tuple(r) for r in graph.reachable(starts.filter("node_id >= 0"), edges).collect())


def test_starts_that_lead_elsewhere_are_walked_from(spark):
    """A long way beside the starts, or more rows than a round may make: the caller walks from each start."""
    links = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(0, k) for k in range(2, 40)], "src long, dst long").distinct()
    starts = spark.createDataFrame([(k,) for k in range(40)], "node_id long")
    assert graph.reachable_together(spark.createDataFrame([(1,)], "node_id long"), links) is None
    assert graph.reachable_together(starts, links, most=1) is None
    assert graph.reachable_together(starts, links).filter("start = 1").count() == 20


def test_names_are_followed_without_a_walk_for_each_name(spark, monkeypatch):
    """Functions that call one another: no frontier of starts and names, at any depth."""
    seen = plans_of(monkeypatch, graph, "spread")
    edges = [(k, k, k + 1, "Call") for k in range(12)] + [(20, 12, 0, "Call")]
    args = [(k, "p", "p") for k in range(12)] + [(20, "p", "q")]
    frames = spark.createDataFrame(edges, "edge_id long, src long, dst long, kind string"), spark.createDataFrame(args, "edge_id long, param string, arg string")
    found = graph.parameter_flow(*frames)
    assert found.filter("direction = 'on' and name = 'p'").count() == 13 * 12 and not seen


def test_rows_of_many_parallel_edges_come_in_pieces(spark, monkeypatch):
    """No row stands for more than a piece, and tasks are as many as the rows need."""
    rows = spark.createDataFrame([("a", 10), ("b", 4), ("c", 1), ("d", 8), ("e", 9)], "k string, n int")
    found = graph._repeated(rows, piece=4, task_rows=1)
    assert {r.k: r["count"] for r in found.groupBy("k").count().collect()} == {"a": 10, "b": 4, "c": 1, "d": 8, "e": 9}
    assert found.rdd.getNumPartitions() == 32
    assert graph._repeated(rows.filter("n > 99")).count() == 0
    counted = graph._repeated(rows, piece=4).rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(counted) == 32 and max(counted) <= 12


def test_crowds_may_be_counted_by_a_part_of_the_key(spark):
    left = spark.createDataFrame([(k, 1, "v") for k in range(20)] + [(99, 2, "w")], "start long, src long, name string")
    right = spark.createDataFrame([(1, "v", 5), (1, "v", 6), (1, "w", 7), (2, "w", 8)], "src long, name string, dst long")
    found = graph.meet(left, right, ["src", "name"], ["start"], crowd=4, of=left.select("src"))
    assert sorted((r.start, r.dst) for r in found.collect()) == sorted([(k, d) for k in range(20) for d in (5, 6)] + [(99, 8)])


def test_variables_are_tracked_without_a_walk_for_each_start(spark, monkeypatch):
    """Nodes that lead to one another: no frontier; repeated starts, parallel edges, two names of a node and nulls count as in the SQL."""
    seen = plans_of(monkeypatch, graph, "frontier")
    edges = [(k, k + 1) for k in range(9)] * 2 + [(9, 4), (9, 4), (9, 4), (3, 3), (None, 2), (8, None)]
    names = [(k, f"v{k % 2}") for k in range(10)] + [(4, "v1"), (7, "v1"), (7, "v1"), (5, None), (None, "v0")]
    frame = spark.createDataFrame(names, "node_id long, name string")
    found = graph.track_variable(frame, spark.createDataFrame(edges, "src long, dst long"), frame)
    out = []
    for start, name in names:
        met, todo = set(), [start] if start is not None else []
        while todo:
            if (at := todo.pop()) not in met and at is not None:
                met.add(at)
                todo += [b for a, b in edges if a == at]
        out += [(start, name, a, b) for a, b in edges if a in met and b is not None and name is not None and (b, name) in names]
    assert sorted(tuple(r) for r in found.collect()) == sorted(out) and not seen


def test_reexports_are_resolved_once_for_a_folder(spark, monkeypatch):
    """Levels of the walk look up steps: no path is resolved again for a start that comes to it."""
    seen = plans_of(monkeypatch, frontend, "reexports")
    names = ["s/a.ts", "s/b.ts", "s/c.ts", "s/k.gen.ts"]
    files = spark.createDataFrame([(n,) for n in names], "file string")
    exports = spark.createDataFrame([("s/a.ts", "./b"), ("s/b.ts", "./c"), ("s/c.ts", "./k.gen"), ("s/c.ts", "./a")], "file string, path string")
    functions = spark.createDataFrame([("s/k.gen.ts", "get"), ("s/a.ts", "own")], "file string, name string")
    found = frontend.reexported(files, exports, files, functions)
    assert sorted(tuple(r) for r in found.collect()) == [(f, "get", "s/k.gen.ts") for f in names[:3]]
    assert len(seen) > 3 and not any("Generate" in p or "BroadcastExchange" in p for p in seen)


def test_reexports_of_names_with_bars_are_kept_apart(spark):
    files = spark.createDataFrame([(n,) for n in ("s|./x", "s", "k.gen.ts", "x|./k.gen.ts")], "file string")
    exports = spark.createDataFrame([("s|./x", "./k.gen"), ("s", "./x|./k.gen")], "file string, path string")
    functions = spark.createDataFrame([("k.gen.ts", "get"), ("x|./k.gen.ts", "put")], "file string, name string")
    found = frontend.reexported(files.filter("file like 's%'"), exports, files, functions)
    once = frontend.resolve_imports(exports.selectExpr("monotonically_increasing_id() as import_id", "file", "path"), files)
    expected = {(r.file, r.resolved) for r in once.collect()}
    assert {(r.file, r.source) for r in found.collect()} == {(f, r) for f, r in expected if r is not None and r.endswith(".gen.ts")}


def test_imports_are_sent_out_a_few_times_and_find_the_first_file(spark):
    """Odd targets and files: the same as trying each candidate in its order, and at most four rows for a target."""
    targets = [(t,) for t in ("a", "a.ts", "a.b", "a.gen", "a.gen.ts", "d/a", "d/", "d/.x", "/a.b", ".x", "", "d.e/a", "d/index", "d/a.b.c", "d/lost")]
    files = [(f,) for f in ("a.ts", "a.tsx", "a.gen.ts", "a.b", "a.b.ts", "d/a/index.gen.tsx", "d/a/index.js", "d/index.tsx", "d/.ts", "d/.x.jsx", ".x.gen.ts", "/a.b.ts", ".ts", "d.e/a.jsx", "d/a.b.c.ts", "d/a.b.ts", "a.ts")]
    asked, there = spark.createDataFrame(targets, "target string"), spark.createDataFrame(files, "file string")
    tried = {r.target: r.c for r in asked.select("target", paths.candidates(F.col("target")).alias("c")).collect()}
    expected = {t: next((c for c in cs if (c,) in files), None) for t, cs in tried.items()}
    found = {r.target: r.resolved for r in frontend.first_files(asked, there, ["target"]).collect()}
    assert found == {t: f for t, f in expected.items() if f is not None} and len(found) > 10
    forms = asked.select(F.size(paths.candidate_forms(F.col("target"))).alias("n"))
    assert forms.agg(F.max("n")).first()[0] <= 4
