import random
from collections import Counter

from linkweave.operators import graph

EDGES = "edge_id long, src long, dst long, kind string"
ARGS = "edge_id long, param string, arg string"


def frames(spark, edges, args):
    return spark.createDataFrame(edges, EDGES), spark.createDataFrame(args, ARGS)


def flow(spark, edges, args):
    return Counter(tuple(r) for r in graph.parameter_flow(*frames(spark, edges, args)).collect())


def brute(edges, args):
    """Every function and name: callers, then a search below the function."""
    first, many = {}, Counter()
    for e, a, b, kind in edges:
        many[a, b] += 1
        if (a, b) not in first or first[a, b][0] > e:
            first[a, b] = (e, kind)
    given = {}
    for e, p, x in args:
        given.setdefault(e, []).append((p, x))
    out, below = Counter(), {}
    for (a, b), (e, kind) in first.items():
        if kind == "Call":
            for name in {n for pair in given.get(e, []) for n in pair if n is not None}:
                out[b, name, "in", a, b] += 1
                below[b, name] = None
    for func, name in below:
        seen, todo = set(), [func]
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            for (a, b), (e, kind) in first.items():
                if a == at:
                    todo.append(b)
                    if kind == "Call":
                        out[func, name, "on", a, b] += many[a, b] * sum(x == name for _, x in given.get(e, []))
    return +out


def test_a_name_is_followed_over_three_calls(spark):
    edges = [(1, 10, 20, "Call"), (2, 20, 30, "Call"), (3, 30, 40, "Call"), (4, 40, 50, "Call"), (5, 40, 60, "DataFlow"), (6, 20, 70, "Call")]
    args = [(1, "x", "total"), (2, "y", "x"), (3, "z", "w"), (4, "q", "x"), (6, "x", "other")]
    found = flow(spark, edges, args)
    assert found == brute(edges, args)
    assert {k[3:] for k in found if k[:3] == (20, "x", "on")} == {(20, 30), (40, 50)}  # 30 -> 40 hands on another name, the way goes on


def test_cycles_parallel_edges_repeats_and_nulls(spark):
    edges = [(1, 1, 2, "Call"), (2, 2, 1, "Call"), (3, 2, 2, "Call"), (4, 1, 2, "Call"), (5, 2, 3, "Import"), (6, 2, 3, "Call"), (7, 3, 1, "Call"), (8, 3, 1, "DataFlow")]
    args = [(1, "a", "a"), (2, "b", "a"), (2, "c", "a"), (3, "a", None), (4, "a", "b"), (6, "a", "a"), (7, None, "a"), (99, "a", "a")]
    assert flow(spark, edges, args) == brute(edges, args)
    assert not flow(spark, edges, []) and not flow(spark, [], args)


def test_random_graphs(spark):
    for seed in range(2):
        r = random.Random(seed)
        edges = [(k, r.randrange(12), r.randrange(12), r.choice(["Call", "Call", "Import"])) for k in range(30)]
        args = [(r.randrange(30), r.choice("abc"), r.choice("abc")) for _ in range(25)]
        assert flow(spark, edges, args) == brute(edges, args)


def test_a_deep_chain(spark):
    edges = [(k, k, k + 1, "Call") for k in range(40)]
    args = [(0, "p", "p"), (39, "p", "p")]
    assert flow(spark, edges, args) == brute(edges, args)
