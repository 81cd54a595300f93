"""The property graph: neighbours, walks, chains, data flow.

Nodes and edges are DataFrames; an edge's id gives the order in which a node's neighbours are tried, newest first.  The star schema serves as
a graph that grows with the scale: orders are routes, customers functions, nations classes, suppliers methods, parts schemas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkweave.functions import names
from linkweave.plans.fixtures import ctes, grown, values
from linkweave.session import discard, materialize, table

#: node_id = key * 8 + kind
KINDS = ("Module", "Class", "Function", "Method", "Schema", "Route")


def node_id(key: Column, kind: str) -> Column:
    return key.cast("long") * 8 + KINDS.index(kind)


def star_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, kind, name, file): files by kind, so that chains mix languages."""
    parts = []
    for name, key, label, kind in (("orders", "o_orderkey", "o_orderpriority", "Route"), ("customer", "c_custkey", "c_name", "Function"), ("nation", "n_nationkey", "n_name", "Class"), ("supplier", "s_suppkey", "s_name", "Method"), ("part", "p_partkey", "p_name", "Schema")):
        file = F.concat(F.lit(kind.lower()), (F.col(key) % 3).cast("string"), F.when(F.col(key) % 2 == 0, ".py").otherwise(".ts"))
        parts.append(table(spark, sf_dir, name).select(node_id(F.col(key), kind).alias("node_id"), F.lit(kind).alias("kind"), F.col(label).alias("name"), file.alias("file")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, edge_id, kind): order -> customer -> nation, order -> supplier -> nation, order -> part."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    edge = lambda df, a, x, b, y, order, kind: df.select(node_id(F.col(a), x).alias("src"), node_id(F.col(b), y).alias("dst"), order.cast("long").alias("edge_id"), F.lit(kind).alias("kind"))
    out = edge(orders, "o_orderkey", "Route", "o_custkey", "Function", F.col("o_orderkey") * 32, "Call")
    out = out.unionByName(edge(lines, "l_orderkey", "Route", "l_suppkey", "Method", F.col("l_orderkey") * 32 + F.col("l_linenumber") * 2 + 1, "Call"))
    out = out.unionByName(edge(lines, "l_orderkey", "Route", "l_partkey", "Schema", F.col("l_orderkey") * 32 + F.col("l_linenumber") * 2 - 40, "DataFlow"))
    out = out.unionByName(edge(table(spark, sf_dir, "customer"), "c_custkey", "Function", "c_nationkey", "Class", F.col("c_custkey"), "Call"))
    return out.unionByName(edge(table(spark, sf_dir, "supplier"), "s_suppkey", "Method", "s_nationkey", "Class", F.col("s_suppkey"), "Call"))


def find_nodes(nodes: DataFrame, predicate: Column) -> DataFrame:
    """Nodes that a condition holds for, in the order of their ids."""
    return nodes.filter(predicate).orderBy("node_id")


def add_variables(variables: DataFrame, more: DataFrame) -> DataFrame:
    """Variables (node_id, name) with further ones; one that is there already stays one."""
    return variables.select("node_id", "name").unionByName(more.select("node_id", "name")).distinct()


def adjacency(edges: DataFrame, most: int) -> DataFrame:
    """(src, out): the ``most`` newest different neighbours, newest first.

    A walk of fewer nodes can't have been at all of them, so it never needs more; a node with many edges stays small, and
    Spark limits the ranks before the shuffle."""
    newest = edges.groupBy("src", "dst").agg(F.max("edge_id").alias("edge_id"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("edge_id"), "dst"))
    few = newest.withColumn("rank", rank).filter(F.col("rank") <= most)
    return few.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "dst"))), lambda x: x["dst"]).alias("out"))


def greedy_walk(starts: DataFrame, edges: DataFrame, most: int = 64) -> DataFrame:
    """(start, path): from each start to the first neighbour that isn't on the path, until there is none.

    All walks take a step together: one join of the walks' ends with the adjacency for each level, and walks that have
    ended leave the loop.  ``most`` neighbours of a node are enough for walks of that length; where walks get longer, the adjacency is made anew with four times as many."""
    near = materialize(adjacency(edges, most + 1), "adjacency")
    going = materialize(starts.select(F.col("node_id").alias("start"), F.array("node_id").alias("path"), F.col("node_id").alias("at")), "walks")
    done, steps = None, 0
    while True:
        if steps == most:
            most *= 4
            near = materialize(adjacency(edges, most + 1), "adjacency", instead_of=near)
        step = going.join(near.hint("merge"), going["at"] == near["src"], "left")  # a broadcast would bring the graph to the driver at each level
        following = F.get(F.filter("out", lambda x: ~F.array_contains("path", x)), 0)
        step = materialize(step.select("start", "path", following.alias("next")), "walks")
        ended = step.filter("next is null").select("start", "path")
        done = ended if done is None else done.unionByName(ended)
        going = step.filter("next is not null").select("start", F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("at"))
        if going.isEmpty():
            return done
        steps += 1


def chain_type(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Full if a route is on the path or languages mix; else by the language of its files."""
    on = paths.select("start", F.explode("path").alias("node_id")).join(nodes, "node_id")
    by = on.groupBy("start").agg(F.bool_or(F.col("kind") == "Route").alias("route"), F.bool_or(F.col("file").rlike(r"\.tsx?$")).alias("ts"), F.bool_or(F.col("file").endswith(".py")).alias("py"))
    kind = F.when(F.col("route"), "Full").when(F.col("ts") & ~F.col("py"), "FrontendInternal").when(F.col("py") & ~F.col("ts"), "BackendInternal").otherwise("Full")
    return by.select("start", kind.alias("chain_type"))


def links_of(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(start, pos, node_id, link_type): first is the source, last the sink, between by kind."""
    last = F.size("path") - 1
    on = paths.select("start", F.posexplode("path").alias("pos", "node_id"), last.alias("last")).join(nodes.select("node_id", "kind"), "node_id")
    middle = F.when(F.col("kind") == "Route", "Source").when(F.col("kind") == "Class", "Sink").otherwise("Transformer")
    return on.select("start", "pos", "node_id", F.when(F.col("pos") == 0, "Source").when(F.col("pos") == F.col("last"), "Sink").otherwise(middle).alias("link_type"))


def contracts_of_links(paths: DataFrame) -> DataFrame:
    """(start, pos, from_node, to_node): neighbours on each path; made within the row, without a window."""
    pairs = F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(i.alias("pos"), F.get("path", i).alias("from_node"), F.get("path", i + 1).alias("to_node")))
    return paths.filter(F.size("path") > 1).select("start", F.inline(pairs))


#: Rows of a frontier that may stand at one node before they are dealt to several tasks.
CROWD = 100_000


def meet(left: DataFrame, right: DataFrame, on: list[str], by: list[str], crowd: int = CROWD, of: DataFrame | None = None) -> DataFrame:
    """Both joined on ``on``, where many rows of ``left`` may have one key.  ``of``: some columns of the key, from rows that are counted in place of ``left``.

    All starts meet at the nodes in the middle of a graph, and a join by node would bring them to one task.  So rows at a key with more than ``crowd`` of
    them are dealt by ``by``, and the rows of ``right`` for such a key are repeated for each share.  Both sides are shuffled and none goes through the driver."""
    of = left.select(*on) if of is None else of
    full = of.groupBy(*of.columns).agg(F.ceil(F.count("*") / crowd).cast("int").alias("shares")).filter("shares > 1")
    full = F.broadcast(full)  # at most one row for ``crowd`` rows
    shares = F.coalesce("shares", F.lit(1)).cast("long")
    dealt = left.join(full, of.columns, "left").withColumn("share", F.pmod(F.xxhash64(*by), shares)).drop("shares")
    repeated = right.join(full, of.columns, "left").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))).drop("shares")
    return dealt.join(repeated.hint("merge"), [*on, "share"]).drop("share")


def hop(frontier: DataFrame, links: DataFrame, by: list[str], crowd: int = CROWD) -> DataFrame:
    """(by.., node_id): one step of a frontier (by.., node_id) over links (src, dst)."""
    at = frontier.select(*by, F.col("node_id").alias("src"))
    return meet(at, links.select("src", "dst"), ["src"], by, crowd).select(*by, F.col("dst").alias("node_id")).distinct()


def reachable(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, node_id) of everything reachable, the start included: the frontier moves until nothing new is found."""
    seen = materialize(starts.select(F.col("node_id").alias("start"), "node_id").distinct(), "reach")
    frontier = seen
    step = materialize(edges.select("src", "dst").distinct(), "links")
    while True:
        frontier = materialize(hop(frontier, step, ["start"]).join(seen.hint("merge"), ["start", "node_id"], "left_anti"), "frontier")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


#: Nodes that starts may lead to besides themselves, and steps to them, for ``reachable_together``: what is made for them is not asked for.
OTHERS, OTHER_STEPS = 1000, 8
#: Rows for each node that a round of ``reachable_together`` may make.
PAIRS = 1024


def reachable_together(starts: DataFrame, links: DataFrame, most: int = PAIRS) -> DataFrame | None:
    """(start, node_id) of everything reachable over different links (src, dst), where the starts are (nearly) all nodes that they lead to; else None.

    Ways get twice as long in each round: what lies k steps away is joined with what is less far from there, so a node's ways are made once for all that come
    to it, and pairs are shuffled a few times, not once for each step.  A few nodes besides the starts are taken in.  None, too, if a round would make more
    than ``most`` rows for each node: a walk from each start may need fewer.  Starts that were not asked for may be among the pairs."""
    nodes = materialize(starts.select("node_id").filter("node_id is not null").distinct(), "nodes")
    there, others = nodes, 0
    for _ in range(OTHER_STEPS):
        met = links.join(there, F.col("src") == F.col("node_id"), "left_semi").select(F.col("dst").alias("node_id")).filter("node_id is not null").distinct()
        there = materialize(met.join(nodes, "node_id", "left_anti"), "nodes")
        new = there.count()
        if new == 0:
            break
        others += new
        if others > OTHERS:
            return None
        nodes = nodes.unionByName(there)
    else:
        return None
    first = links.join(nodes, F.col("src") == F.col("node_id"), "left_semi").filter("src <> dst").select(F.col("src").alias("start"), F.col("dst").alias("node_id"), F.lit(1).alias("steps"))
    near = materialize(nodes.select(F.col("node_id").alias("start"), "node_id", F.lit(0).alias("steps")).unionByName(first), "pairs")
    count, steps = nodes.count(), 1
    while True:
        far = near.filter(F.col("steps") == steps).select("start", F.col("node_id").alias("src"))
        on = near.filter("steps > 0").select(F.col("start").alias("src"), F.col("node_id").alias("dst"), F.col("steps").alias("more"))
        rows = far.groupBy("src").agg(F.count("*").alias("a")).join(on.groupBy("src").agg(F.count("*").alias("b")), "src").agg(F.sum(F.col("a") * F.col("b"))).first()[0]
        if rows is None:
            return near.select("start", "node_id")
        if rows > most * count:
            discard(near)
            return None
        further = meet(far, on, ["src"], ["start"]).select("start", F.col("dst").alias("node_id"), (F.col("more") + steps).alias("steps"))
        near = materialize(near.unionByName(further).groupBy("start", "node_id").agg(F.min("steps").alias("steps")), "pairs", instead_of=near)
        steps *= 2


def _named_at(reach: DataFrame, names: DataFrame, there: DataFrame) -> DataFrame:
    """Rows (start, name, from_node, to_node), repeated: what is ``there`` (src, dst, name, n) at the nodes that a start (node_id, name) reaches, under its name."""
    named = reach.join(names.select(F.col("node_id").alias("start"), "name"), "start").withColumnRenamed("node_id", "src")
    out = meet(named, there, ["src", "name"], ["start"], of=reach.select(F.col("node_id").alias("src")))
    return _repeated(out.select("start", "name", F.col("src").alias("from_node"), F.col("dst").alias("to_node"), "n"))


def track_variable(starts: DataFrame, edges: DataFrame, variables: DataFrame) -> DataFrame:
    """(start, name, from_node, to_node): each edge out of what is reachable whose target holds the variable of the start's name."""
    links = materialize(edges.select("src", "dst").distinct(), "links")
    reach = reachable_together(starts, links)
    if reach is None:
        reach = reachable(starts.select("node_id").distinct(), links)
    # edges between the same two nodes are counted, and their rows are made last
    every = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    there = every.join(variables.select(F.col("node_id").alias("dst"), "name").distinct(), "dst")
    return _named_at(reach, starts, there)


def _calling_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, edge_id): the first edge between two nodes, where it is a call."""
    first = edges.groupBy("src", "dst").agg(F.min_by(F.struct("edge_id", "kind"), "edge_id").alias("e"))
    return first.select("src", "dst", "e.edge_id", "e.kind").filter("kind = 'Call'").drop("kind")


def track_parameter(edges: DataFrame, args: DataFrame) -> DataFrame:
    """(caller, callee, name): calls that hand over a name on either side, by the first edge between the two."""
    named = args.select("edge_id", F.explode(F.array("param", "arg")).alias("name")).distinct()
    return _calling_edges(edges).join(named, "edge_id").select(F.col("src").alias("caller"), F.col("dst").alias("callee"), "name")


def _spread(seed: DataFrame, links: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """Rows of ``seed`` (node_id and what stays with it) with all nodes that links (src, dst) lead to; ``within`` has the rows that may be met, by the columns it shares."""
    keep = [c for c in seed.columns if c != "node_id"]
    frontier = materialize(seed.distinct(), "spread")
    pieces, seen = 1, frontier
    while not frontier.isEmpty():
        new = hop(frontier, links, keep)
        if within is not None:
            new = new.join(within.hint("merge"), [c for c in within.columns], "left_semi").select(*keep, "node_id")
        frontier = materialize(new.join(seen.hint("merge"), [*keep, "node_id"], "left_anti"), "spread")
        seen, pieces = seen.unionByName(frontier), pieces + 1
        if pieces > 16:  # a deep graph: one table in place of a union of many
            seen, pieces = materialize(seen, "spread"), 1
    return seen


def handed_on(starts: DataFrame, edges: DataFrame, args: DataFrame) -> DataFrame:
    """(start, name, from_node, to_node): from each start (node_id, name) on, over calls of any depth, the calls that hand the name over as an argument.

    A row for each edge between the two nodes and each argument of that name, as edges of a pair aren't told apart.  Cycles are gone through once.  Null names
    match nothing.  Starts that lead to one another are followed together, whatever their names; else only nodes that lead to a call with the name are met: they are
    found first, against the edges, so a start moves no further than its name does."""
    links = materialize(edges.select("src", "dst").distinct(), "links")
    asked = starts.select("node_id", "name").filter("node_id is not null and name is not null").distinct()
    calls = _calling_edges(edges).join(args.select("edge_id", F.col("arg").alias("name")), "edge_id").join(asked.select("name").distinct(), "name", "left_semi")
    hands = materialize(calls.select("src", "dst", "name"), "hands")
    # as many rows as there are edges between the two
    every = edges.groupBy("src", "dst").agg(F.count("*").alias("n")).join(hands, ["src", "dst"])
    asked = materialize(asked.join(hands.select("name").distinct(), "name", "left_semi"), "asked")
    reach = reachable_together(asked, links)
    if reach is not None:
        return _named_at(reach, asked, every)
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    leading = materialize(_spread(hands.select("name", F.col("src").alias("node_id")), back), "leading")
    met = _spread(asked.join(leading, ["node_id", "name"], "left_semi").select(F.col("node_id").alias("start"), "name", "node_id"), links, leading)
    out = meet(met.withColumnRenamed("node_id", "src"), every, ["src", "name"], ["start"])
    return _repeated(out.select("start", "name", F.col("src").alias("from_node"), F.col("dst").alias("to_node"), "n"))


#: Rows that a row stands for at most when it is dealt, and rows that a task makes.
PIECE, TASK_ROWS = 4096, 50_000_000


def _repeated(rows: DataFrame, piece: int = PIECE, task_rows: int = TASK_ROWS) -> DataFrame:
    """Each row ``n`` times.  Rows are dealt to all cores first: those of a node that all starts reach come out of one task.

    Counted rows are few and the rows they stand for many, so there are as many tasks as the latter need, and no row stands for more than ``piece`` of them:
    what a task holds doesn't grow with the number of edges between two nodes."""
    columns = [c for c in rows.columns if c != "n"]
    last = F.floor((F.col("n") - 1) / piece)
    parts = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.least(F.lit(piece).cast("long"), F.col("n") - i * piece))
    counted = materialize(rows.select(*columns, F.col("n").cast("long").alias("n")), "counted")
    total = counted.agg(F.sum("n")).first()[0] or 0
    tasks = max(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-total // task_rows))
    dealt = counted.select(*columns, F.explode(parts).alias("n")).repartition(tasks)
    return dealt.select(*columns, F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("one")).drop("one")


def parameter_flow(edges: DataFrame, args: DataFrame) -> DataFrame:
    """(func, name, direction, from_node, to_node): calls that hand a name to a function, and the calls below the function that hand it on."""
    up = materialize(track_parameter(edges, args).filter("name is not null"), "callers")
    below = handed_on(up.select(F.col("callee").alias("node_id"), "name"), edges, args)
    return up.select(F.col("callee").alias("func"), "name", F.lit("in").alias("direction"), F.col("caller").alias("from_node"), F.col("callee").alias("to_node")).unionByName(
        below.select(F.col("start").alias("func"), "name", F.lit("on").alias("direction"), "from_node", "to_node")
    )


def track_return(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(from_node, to_node): from the function to its callers, then from callers to what else they call, over all ancestors."""
    calls = edges.select("src", "dst")
    up = reachable(start, calls.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select("node_id").distinct()
    back = up.join(calls, F.col("node_id") == F.col("dst")).select(F.col("dst").alias("from_node"), F.col("src").alias("to_node"))
    sideways = back.select(F.col("from_node").alias("current"), F.col("to_node").alias("caller")).distinct().join(calls, F.col("caller") == F.col("src")).filter(F.col("dst") != F.col("current"))
    return back.distinct().unionByName(sideways.select(F.col("caller").alias("from_node"), F.col("dst").alias("to_node")).distinct()).distinct()


def _walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy_walk(table(spark, sf_dir, "orders").select(node_id(F.col("o_orderkey"), "Route").alias("node_id")), star_edges(spark, sf_dir))


def walk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walks(spark, sf_dir).select("start", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def reverse_walk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each nation against the edges, the path turned round."""
    edges = star_edges(spark, sf_dir)
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_id", "kind")
    starts = table(spark, sf_dir, "nation").select(node_id(F.col("n_nationkey"), "Class").alias("node_id"))
    return greedy_walk(starts, turned).select("start", F.array_join(F.transform(F.reverse("path"), lambda x: x.cast("string")), ">").alias("path"))


def small_walk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = grown(spark, sf_dir, "walk_edges")
    starts = edges.select(F.col("src").alias("node_id")).distinct()
    return greedy_walk(starts, edges).select("start", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def degree_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In- and out-neighbours of every node, one for each edge."""
    edges = star_edges(spark, sf_dir)
    ends = edges.select(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node_id").agg(F.sum("o").alias("out_edges"), F.sum("i").alias("in_edges"))


def first_by_name_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First node of each name; routes and modules have none."""
    nodes = star_nodes(spark, sf_dir).filter(~F.col("kind").isin("Route", "Module"))
    return nodes.groupBy("name").agg(F.min_by("node_id", "node_id").alias("node_id"), F.min_by("kind", "node_id").alias("kind"))


def chain_type_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain types of what every customer and supplier calls."""
    starts = star_nodes(spark, sf_dir).filter(F.col("kind").isin("Function", "Method")).select("node_id")
    return chain_type(star_nodes(spark, sf_dir), greedy_walk(starts, star_edges(spark, sf_dir)))


def chains_by_type_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_type_query(spark, sf_dir).groupBy("chain_type").agg(F.count("*").alias("chains"))


def link_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links_of(star_nodes(spark, sf_dir), _walks(spark, sf_dir))


def contract_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts_of_links(_walks(spark, sf_dir))


def name_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain names and labels of nodes for the drawing."""
    kind = F.col("kind")
    chain = F.when(kind == "Route", F.concat(F.lit("GET /"), F.col("name"))).otherwise(F.concat_ws(" ", kind, F.col("name")))
    return star_nodes(spark, sf_dir).select("node_id", chain.alias("chain_name"), names.dot_escape(F.concat_ws("\n", F.concat(kind, F.lit(":")), F.col("name"))).alias("label"))


def edge_label_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = grown(spark, sf_dir, "edge_args").groupBy("edge_id").agg(F.count("*").alias("n"))
    label = F.when(F.col("kind") == "Call", F.when(F.col("n") > 0, F.format_string("calls (%d args)", "n")).otherwise("calls")).when(F.col("kind") == "Import", "imports").otherwise("data flow")
    return grown(spark, sf_dir, "walk_edges").join(n, "edge_id", "left").select("edge_id", label.alias("label"))


def variable_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track_variable(grown(spark, sf_dir, "variables"), grown(spark, sf_dir, "walk_edges"), grown(spark, sf_dir, "variables"))


def parameter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track_parameter(grown(spark, sf_dir, "walk_edges"), grown(spark, sf_dir, "edge_args"))


def parameter_flow_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parameter_flow(grown(spark, sf_dir, "walk_edges"), grown(spark, sf_dir, "edge_args"))


def return_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = grown(spark, sf_dir, "walk_edges").filter("dst in (3, 100)").select(F.col("dst").alias("node_id")).distinct()
    return track_return(start, grown(spark, sf_dir, "walk_edges"))


def reach_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = table(spark, sf_dir, "customer").select(node_id(F.col("c_custkey"), "Function").alias("node_id"))
    return reachable(starts, star_edges(spark, sf_dir))


def next_turn_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in a chain of turns: each turn with the one that follows it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lead("turn").over(w).alias("next_turn"), F.lead("role").over(w).alias("next_role"))


def _edge_sql() -> str:
    i = KINDS.index
    return f"""e AS (SELECT o_orderkey * 8 + {i('Route')} AS src, o_custkey * 8 + {i('Function')} AS dst, o_orderkey * 32 AS edge_id, 'Call' AS kind FROM orders
 UNION ALL SELECT l_orderkey * 8 + {i('Route')}, l_suppkey * 8 + {i('Method')}, l_orderkey * 32 + l_linenumber * 2 + 1, 'Call' FROM lineitem
 UNION ALL SELECT l_orderkey * 8 + {i('Route')}, l_partkey * 8 + {i('Schema')}, l_orderkey * 32 + l_linenumber * 2 - 40, 'DataFlow' FROM lineitem
 UNION ALL SELECT c_custkey * 8 + {i('Function')}, CAST(c_nationkey AS BIGINT) * 8 + {i('Class')}, c_custkey, 'Call' FROM customer
 UNION ALL SELECT s_suppkey * 8 + {i('Method')}, CAST(s_nationkey AS BIGINT) * 8 + {i('Class')}, s_suppkey, 'Call' FROM supplier)"""


def _node_sql() -> str:
    part = lambda t, k, label, kind: f"SELECT CAST({k} AS BIGINT) * 8 + {KINDS.index(kind)} AS node_id, '{kind}' AS kind, {label} AS name, '{kind.lower()}' || ({k} % 3) || CASE WHEN {k} % 2 = 0 THEN '.py' ELSE '.ts' END AS file FROM {t}"
    return "n AS (" + " UNION ALL ".join(part(*x) for x in (("orders", "o_orderkey", "o_orderpriority", "Route"), ("customer", "c_custkey", "c_name", "Function"), ("nation", "n_nationkey", "n_name", "Class"), ("supplier", "s_suppkey", "s_name", "Method"), ("part", "p_partkey", "p_name", "Schema"))) + ")"


def _walk_sql(edges: str, starts: str) -> str:
    return f"""WITH RECURSIVE {edges}, nb AS (SELECT src, list(dst ORDER BY edge_id DESC, dst) AS ns FROM e GROUP BY src),
 w AS (SELECT node_id AS start, [node_id] AS path FROM ({starts}) UNION ALL SELECT start, list_append(path, list_filter(ns, lambda x: NOT list_contains(path, x))[1]) FROM w JOIN nb ON nb.src = path[-1] WHERE len(list_filter(ns, lambda x: NOT list_contains(path, x))) > 0),
 p AS (SELECT start, arg_max(path, len(path)) AS path FROM w GROUP BY start)"""


FUNCTION = KINDS.index("Function")
_ROUTES = f"SELECT o_orderkey * 8 + {KINDS.index('Route')} AS node_id FROM orders"
_TURNED = _edge_sql().replace("e AS (", "e0 AS (", 1) + ", e AS (SELECT dst AS src, src AS dst, edge_id, kind FROM e0)"
_SMALL = f"e AS (SELECT * FROM {values('walk_edges')})"
_PATH = "array_to_string(list_transform({}, lambda x: CAST(x AS VARCHAR)), '>') AS path"
_CALLERS = f"SELECT node_id FROM n WHERE kind IN ('Function', 'Method')"
_TYPED = _walk_sql(_edge_sql() + ", " + _node_sql(), _CALLERS) + ", t AS (SELECT start, CASE WHEN bool_or(kind = 'Route') THEN 'Full' WHEN bool_or(file LIKE '%.ts') AND NOT bool_or(file LIKE '%.py') THEN 'FrontendInternal' WHEN bool_or(file LIKE '%.py') AND NOT bool_or(file LIKE '%.ts') THEN 'BackendInternal' ELSE 'Full' END AS chain_type FROM (SELECT start, unnest(path) AS node_id FROM p) JOIN n USING (node_id) GROUP BY start)"
_REACH = "r AS (SELECT node_id AS start, node_id FROM ({}) UNION SELECT start, dst FROM r JOIN e ON src = node_id)"

def class_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of Python files that are classes or methods."""
    return find_nodes(star_nodes(spark, sf_dir), F.col("kind").isin("Class", "Method") & F.col("file").endswith(".py")).select("node_id", "kind", "name")


def added_variable_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's variables with one for each customer's and supplier's node."""
    more = star_nodes(spark, sf_dir).filter(F.col("kind").isin("Function", "Method"))
    return add_variables(add_variables(grown(spark, sf_dir, "variables"), more), grown(spark, sf_dir, "variables"))


QUERIES = {
    "nodes_by_predicate": class_query,
    "registered_variables": added_variable_query,
    "greedy_walk_forward": walk_query,
    "greedy_walk_reverse": reverse_walk_query,
    "greedy_walk_small": small_walk_query,
    "node_degrees": degree_query,
    "first_node_by_name": first_by_name_query,
    "chain_types": chain_type_query,
    "chains_by_type": chains_by_type_query,
    "link_types": link_query,
    "contracts_from_links": contract_query,
    "dot_labels": name_query,
    "dot_edge_labels": edge_label_query,
    "track_variable": variable_query,
    "track_parameter": parameter_query,
    "parameter_flow": parameter_flow_query,
    "track_return": return_query,
    "reachable_nodes": reach_query,
    "adjacent_turns": next_turn_query,
}
ORACLE_SQL = {
    "nodes_by_predicate": f"WITH {_node_sql()} SELECT node_id, kind, name FROM n WHERE kind IN ('Class', 'Method') AND file LIKE '%.py'",
    "registered_variables": f"WITH {_node_sql()} SELECT CAST(node_id AS BIGINT) AS node_id, name FROM {values('variables')} UNION SELECT node_id, name FROM n WHERE kind IN ('Function', 'Method')",
    "greedy_walk_forward": _walk_sql(_edge_sql(), _ROUTES) + f" SELECT start, {_PATH.format('path')} FROM p",
    "greedy_walk_reverse": _walk_sql(_TURNED, f"SELECT CAST(n_nationkey AS BIGINT) * 8 + {KINDS.index('Class')} AS node_id FROM nation") + f" SELECT start, {_PATH.format('list_reverse(path)')} FROM p",
    "greedy_walk_small": _walk_sql(_SMALL, "SELECT DISTINCT src AS node_id FROM e") + f" SELECT start, {_PATH.format('path')} FROM p",
    "node_degrees": f"WITH {_edge_sql()} SELECT node_id, CAST(sum(o) AS BIGINT) AS out_edges, CAST(sum(i) AS BIGINT) AS in_edges FROM (SELECT src AS node_id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY 1",
    "first_node_by_name": f"WITH {_node_sql()} SELECT name, min(node_id) AS node_id, arg_min(kind, node_id) AS kind FROM n WHERE kind NOT IN ('Route', 'Module') GROUP BY name",
    "chain_types": f"{_TYPED} SELECT * FROM t",
    "chains_by_type": f"{_TYPED} SELECT chain_type, count(*) AS chains FROM t GROUP BY 1",
    "link_types": _walk_sql(_edge_sql() + ", " + _node_sql(), _ROUTES) + " SELECT start, CAST(pos - 1 AS INT) AS pos, node_id, CASE WHEN pos = 1 THEN 'Source' WHEN pos = len THEN 'Sink' WHEN kind = 'Route' THEN 'Source' WHEN kind = 'Class' THEN 'Sink' ELSE 'Transformer' END AS link_type FROM (SELECT start, len(path) AS len, unnest(path) AS node_id, generate_subscripts(path, 1) AS pos FROM p) JOIN n USING (node_id)",
    "contracts_from_links": _walk_sql(_edge_sql(), _ROUTES) + " SELECT start, CAST(i AS INT) AS pos, path[i + 1] AS from_node, path[i + 2] AS to_node FROM (SELECT start, path, unnest(range(len(path) - 1)) AS i FROM p)",
    "dot_labels": f"WITH {_node_sql()} SELECT node_id, CASE kind WHEN 'Route' THEN 'GET /' || name ELSE kind || ' ' || name END AS chain_name, kind || ':\\n' || replace(replace(name, '\\', '\\\\'), '\"', '\\\"') AS label FROM n",
    "dot_edge_labels": ctes("walk_edges", "edge_args") + " SELECT e.edge_id, CASE kind WHEN 'Call' THEN CASE WHEN n > 0 THEN 'calls (' || n || ' args)' ELSE 'calls' END WHEN 'Import' THEN 'imports' ELSE 'data flow' END AS label FROM walk_edges e LEFT JOIN (SELECT edge_id, count(*) AS n FROM edge_args GROUP BY 1) a USING (edge_id)",
    "track_variable": f"WITH RECURSIVE {_SMALL}, v AS (SELECT * FROM {values('variables')}), {_REACH.format('SELECT DISTINCT node_id FROM v')} SELECT r.start, s.name, e.src AS from_node, e.dst AS to_node FROM r JOIN v s ON s.node_id = r.start JOIN e ON e.src = r.node_id WHERE EXISTS (SELECT 1 FROM v x WHERE x.node_id = e.dst AND x.name = s.name)",
    "track_parameter": ctes("walk_edges", "edge_args") + " SELECT f.src AS caller, f.dst AS callee, name FROM (SELECT src, dst, min(edge_id) AS edge_id, arg_min(kind, edge_id) AS kind FROM walk_edges GROUP BY 1, 2) f JOIN (SELECT edge_id, param AS name FROM edge_args UNION SELECT edge_id, arg FROM edge_args) a USING (edge_id) WHERE kind = 'Call'",
    "parameter_flow": f"WITH RECURSIVE {_SMALL}, g AS (SELECT * FROM {values('edge_args')}), f AS (SELECT src, dst, min(edge_id) AS edge_id, arg_min(kind, edge_id) AS kind, count(*) AS n FROM e GROUP BY 1, 2), c AS (SELECT * FROM f WHERE kind = 'Call'),"
    " up AS (SELECT src, dst, name FROM c JOIN (SELECT edge_id, param AS name FROM g UNION SELECT edge_id, arg FROM g) a USING (edge_id)), r AS (SELECT dst AS func, name, dst AS node_id FROM up UNION SELECT func, name, dst FROM r JOIN f ON src = node_id)"
    " SELECT dst AS func, name, 'in' AS direction, src AS from_node, dst AS to_node FROM up UNION ALL SELECT func, name, 'on', from_node, to_node FROM (SELECT r.func, r.name, c.src AS from_node, c.dst AS to_node, unnest(range(c.n)) FROM r JOIN c ON c.src = r.node_id JOIN g ON g.edge_id = c.edge_id AND g.arg = r.name)",
    "track_return": f"WITH RECURSIVE {_SMALL}, u AS (SELECT unnest([3, 100]) AS node_id UNION SELECT src FROM u JOIN e ON dst = node_id), b AS (SELECT DISTINCT dst AS from_node, src AS to_node FROM u JOIN e ON dst = node_id) SELECT * FROM b UNION SELECT to_node, dst FROM b JOIN e ON src = to_node AND dst <> from_node",
    "reachable_nodes": f"WITH RECURSIVE {_edge_sql()}, {_REACH.format(f'SELECT c_custkey * 8 + {FUNCTION} AS node_id FROM customer')} SELECT * FROM r",
    "adjacent_turns": "SELECT conv_id, turn, role, lead(turn) OVER w AS next_turn, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
}
