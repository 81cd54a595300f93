"""The drawing of the whole graph against brute force over the small tables."""

import pyarrow.parquet as pq

from linkweave import queries

PATH = "/root/testdata/sf0.001"


def rows(name):
    return pq.read_table(f"{PATH}/{name}.parquet").to_pylist()


def test_whole_graph_is_drawn(spark):
    want = []
    for name, key, label, kind, number in (("orders", "o_orderkey", "o_orderpriority", "Route", 5), ("customer", "c_custkey", "c_name", "Function", 2), ("nation", "n_nationkey", "n_name", "Class", 1), ("supplier", "s_suppkey", "s_name", "Method", 3), ("part", "p_partkey", "p_name", "Schema", 4)):
        for r in rows(name):
            text = f"{kind} {r[label]}".replace("\\", "\\\\").replace('"', '\\"')
            want.append((0, r[key] * 8 + number, f'  n{r[key] * 8 + number} [label="{text}"];'))
    for r in rows("orders"):
        want.append((1, r["o_orderkey"] * 32, f"  n{r['o_orderkey'] * 8 + 5} -> n{r['o_custkey'] * 8 + 2};"))
    for r in rows("lineitem"):
        order, place = r["l_orderkey"] * 8 + 5, r["l_orderkey"] * 32 + r["l_linenumber"] * 2
        want.append((1, place + 1, f"  n{order} -> n{r['l_suppkey'] * 8 + 3};"))
        want.append((1, place - 40, f"  n{order} -> n{r['l_partkey'] * 8 + 4} [style=dashed, color=purple];"))
    want += [(1, r["c_custkey"], f"  n{r['c_custkey'] * 8 + 2} -> n{r['c_nationkey'] * 8 + 1};") for r in rows("customer")]
    want += [(1, r["s_suppkey"], f"  n{r['s_suppkey'] * 8 + 3} -> n{r['s_nationkey'] * 8 + 1};") for r in rows("supplier")]
    got = [tuple(r) for r in queries.QUERIES["dot_lines"](spark, PATH).collect()]
    assert sum("dashed" in line for _, _, line in got) == len(rows("lineitem")) > 0
    assert sorted(got) == sorted(want)
