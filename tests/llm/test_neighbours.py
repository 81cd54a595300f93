"""Operator 11: recall and scores against brute force; awkward vectors; hot vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkweave.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, id string"


def brute(rows, every=20, most=20):
    """Exact neighbours of the usable rows; the least vector of an id counts, shorter vectors are filled with zeros."""
    usable = [(i, v) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    least = {}
    for i, v in usable:
        v = [float(np.float32(x)) for x in v]
        least[i] = min(least.get(i, v), v)
    width = max(map(len, least.values()), default=0)
    ids = np.array(sorted(least))
    x = np.array([least[i] + [0.0] * (width - len(least[i])) for i in ids])
    out = {}
    for k, i in enumerate(ids):
        if i % every == 0:
            s = np.einsum("ij,j->i", x, x[k])
            order = [j for j in np.lexsort((ids, -s)) if j != k][:most]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def search(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    out = {}
    for r in sorted(neighbours.nearest(df, F.col("id") % 20 == 0, **options).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / max(1, sum(map(len, want.values())))


def test_quantile():
    assert neighbours.chi_square_quantile(0.95, 12) == pytest.approx(21.0261, abs=1e-3)
    assert neighbours.chi_square_quantile(0.5, 2) == pytest.approx(2 * math.log(2))


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [2.0, 1.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0])]
    rows += [(7, [1.0]), (8, [1.0, 2.0, 3.0]), (9, [-1.0, -2.0]), (9, [5.0, 5.0]), (40, [1.0, 2.0]), (40, [1.0, 2.0]), (-20, [1e-20, 0.0]), (11, [1e15, -1e15])]
    got, want = search(spark, rows), brute(rows)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])


def test_empty_table_and_single_row(spark):
    assert search(spark, []) == {} and search(spark, [(0, [1.0])]) == {} and search(spark, [(1, [1.0]), (2, [1.0])]) == {}


def test_a_third_of_all_rows_in_one_vector(spark):
    rng = np.random.default_rng(5)
    hot = 4 * rng.standard_normal(8)
    rows = [(i, (hot if i % 3 == 0 else rng.standard_normal(8)).tolist()) for i in range(3000)]
    got, want = search(spark, rows), brute(rows)
    assert recall(got, want) >= 0.95
    assert [i for i, _ in got[0]] == [i for i, _ in want[0]] == [3 * k for k in range(1, 21)]


@pytest.mark.parametrize("shape", ["clusters", "norms", "one long vector"])
def test_recall_on_other_shapes(spark, shape, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_ROWS", 256)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 24))
    if shape == "clusters":
        x = x * 0.2 + rng.standard_normal((40, 24))[np.arange(4000) % 40]
    if shape == "norms":
        x *= np.exp(rng.standard_normal(4000))[:, None]
    if shape == "one long vector":
        x[17] *= 1e6
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = search(spark, rows), brute(rows)
    assert recall(got, want) >= 0.93


def test_query_recall_and_scores_on_a_whole_table(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    want, got = brute(rows), {}
    for r in sorted(neighbours.query(spark, path).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert recall(got, want) >= 0.93
    exact = {i: np.array(v, np.float64) for i, v in rows}
    for q, found in got.items():
        assert [s for _, s in found] == pytest.approx([float(exact[q] @ exact[i]) for i, _ in found], abs=1e-12)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))


def test_the_stopping_test_leaves_out_far_vectors():
    """On clusters, few vectors lie within the projected distance at which the searches end."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((5000, 8)) * 0.05 + rng.standard_normal((10, 8))[np.arange(5000) % 10]
    directions = rng.standard_normal((9, 12))
    size = neighbours.norms(x)
    top = size.max()
    points = np.hstack([x, np.sqrt(top**2 - size**2)[:, None]]) @ directions
    q, quantile = x[:50], neighbours.chi_square_quantile(0.96, 12)
    q_points = (q * (top / size[:50])[:, None]) @ directions[:-1]
    place, ids, scores = neighbours.search(np.arange(5000), x, points, np.arange(50), q, q_points, np.full(50, -np.inf), size[:50], top, quantile, 20)
    assert np.bincount(place).tolist() == [20] * 50
    last = np.array([scores[place == k].min() for k in range(50)])
    far = np.square(q_points[:, None] - points).sum(axis=2)
    within = (far <= neighbours.radius(last, size[:50], top, quantile)[:, None]).mean()
    assert within < 0.15
