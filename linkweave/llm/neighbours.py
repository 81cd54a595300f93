"""Operator 11: approximate nearest neighbours by largest inner product, with few stable projections, a kd-tree and a chi-square stopping test.

Search for the largest inner product is turned into search for the least distance: a vector x gets one more component ``sqrt(M^2 - |x|^2)`` and a query
is scaled to norm M, so that the squared distance is ``2 M^2 - 2 M <q, x> / |q|``.  M is the greatest norm of a class of similar norms (a factor of
2 each), so that one long vector doesn't blur all others; a class whose M can't reach a query's 20th score is left out, exactly.

A vector is projected on ``PROJECTIONS`` random directions with normal (2-stable) components: a projected squared distance is the true one times a
chi-square variable.  Projected vectors lie in the leaves of a kd-tree.  A leaf's rows are a smaller kd-tree inside a task, whose buckets a
query meets by growing projected distance; vectors within the radius are verified by their inner product in double precision.  With d the distance of
the 20th vector found so far, the search stops when the next projected squared distance passes ``d^2`` times the chi-square quantile of ``CONFIDENCE``:
a vector nearer than d lies beyond it with a probability of less than ``1 - CONFIDENCE``.

Each query first meets the leaf where it lies; its 20th score there tells which other leaves can hold nearer ones, and only these are searched then.

Sizes: the tree is fitted on ``FIT_ROWS`` rows at most (the index holds all rows); it has ``MOST_LEAVES`` leaves at most for each class, and a leaf of more than
``PART_ROWS`` rows is dealt to parts by a hash.  A task holds one part and a block of about ``BLOCK_QUERIES`` queries.  Of identical vectors only the 21 least ids are indexed, as
no further one can be among 20 neighbours; so a third of all rows in one vector weighs nothing.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows without an id.  Of rows with the
same id the least vector counts.  A shorter vector counts as if zeros followed.  Ties go to the smaller id.  Queries with fewer candidates get all of them; an
empty table gives an empty result.  Further columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.session import materialize, table

#: Neighbours of a query; directions (an even number); confidence of the stopping test.
NEIGHBOURS, PROJECTIONS, CONFIDENCE = 20, 12, 0.96

#: Rows that the tree is fitted on, its leaves at most, rows of a part, rows of a bucket in a task, queries of a block.
FIT_ROWS, MOST_LEAVES, PART_ROWS, BUCKET_ROWS, BLOCK_QUERIES = 32_768, 4_096, 4_096, 256, 1_024

_SEED = 11


def chi_square_quantile(p: float, freedom: int) -> float:
    """Quantile of the chi-square distribution with an even number of degrees of freedom."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        tail, term = 0.0, math.exp(-x / 2)
        for i in range(freedom // 2):
            tail += term
            term *= x / 2 / (i + 1)
        low, high = (x, high) if 1 - tail < p else (low, x)
    return low


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite, and one that isn't zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_rows(df: DataFrame, key: str, vector: str, copies: int) -> DataFrame:
    """(id, vector) of the usable rows: one row an id, and of identical vectors the ``copies`` least ids."""
    kind = df.schema[vector].dataType.elementType
    values = F.col(vector) if isinstance(kind, T.FloatType | T.DoubleType) else F.col(vector).cast("array<double>")
    clean = df.select(F.col(key).cast("long").alias("id"), values.alias("vector")).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    one = clean.groupBy("id").agg(F.min("vector").alias("vector"))
    return one.withColumn("copy", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).filter(F.col("copy") <= copies).drop("copy")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column in double precision; shorter ones are filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def norms(x: np.ndarray) -> np.ndarray:
    """Euclidean norms, without overflow."""
    top = np.abs(x).max(axis=1, initial=0)
    safe = np.where(top > 0, top, 1)
    return top * np.sqrt(np.square(x / safe[:, None]).sum(axis=1))


def norm_class(norm: Column) -> Column:
    """Norms of a factor of 2; a border lies between powers of 2, where norms of 1 aren't torn apart."""
    return F.floor(F.log2(norm) + 0.5).cast("int")


class Tree(NamedTuple):
    """A kd-tree over projected vectors: at each level of the heap a coordinate and its border; leaves are numbered from ``base``."""

    axis: np.ndarray
    border: np.ndarray
    base: int

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64)
        while len(self.axis) and (inner := at < len(self.axis)).any():
            rows = np.flatnonzero(inner)
            k = at[rows]
            at[rows] = 2 * k + 1 + (points[rows, self.axis[k]] > self.border[k])
        return at - len(self.axis) + self.base


def fit_tree(points: np.ndarray, levels: int, base: int) -> Tree:
    """Halves at the median of the widest coordinate, ``levels`` times."""
    axis, border = np.zeros(2**levels - 1, np.int64), np.zeros(2**levels - 1)
    groups = [points]
    for node in range(2**levels - 1):
        group = groups[node]
        if len(group):
            axis[node] = np.argmax(np.ptp(group, axis=0))
            border[node] = np.median(group[:, axis[node]])
        right = group[:, axis[node]] > border[node]
        groups += [group[~right], group[right]]
    return Tree(axis, border, base)


class Index(NamedTuple):
    """What tasks know of the index: directions, greatest norms and trees of the classes, and of each leaf its class, box and parts."""

    width: int
    directions: np.ndarray
    tops: dict[int, float]
    trees: dict[int, Tree]
    leaves: np.ndarray
    leaf_class: np.ndarray
    low: np.ndarray
    high: np.ndarray
    parts: np.ndarray

    def queries_in(self, kind: int, q: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Projections of queries that are scaled to the greatest norm of a class."""
        return (q * (self.tops[kind] / size)[:, None]) @ self.directions[:-1]

    def box_distances(self, q: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Squared projected distances of queries to the boxes of all leaves."""
        out = np.empty((len(q), len(self.leaves)))
        for kind in self.tops:
            own = np.flatnonzero(self.leaf_class == kind)
            out[:, own] = box_distances(self.queries_in(kind, q, size), self.low[own], self.high[own])
        return out


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.zeros((len(points), len(low)))
    for k in range(points.shape[1]):
        x = points[:, k, None]
        out += np.square(np.maximum(np.maximum(low[:, k] - x, x - high[:, k]), 0))
    return out


def radius(score: np.ndarray, size: np.ndarray, top: float, quantile: float) -> np.ndarray:
    """Squared projected distance at which the test stops a search whose last place has this score."""
    with np.errstate(invalid="ignore"):
        return np.where(np.isneginf(score), np.inf, quantile * np.maximum(2 * top * top - 2 * top * score / size, 0))


def buckets(points: np.ndarray, most: int) -> tuple[np.ndarray, list[int]]:
    """The kd-tree of a part: an order of its rows, and where the buckets begin in it."""
    done, open_ = [], [np.arange(len(points))]
    while open_:
        rows = open_.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        values = points[rows, np.argmax(np.ptp(points[rows], axis=0))]
        order = rows[np.argpartition(values, len(rows) // 2)]
        open_ += [order[: len(rows) // 2], order[len(rows) // 2 :]]
    return np.concatenate(done), np.cumsum([0, *map(len, done)]).tolist()


def search(ids: np.ndarray, x: np.ndarray, points: np.ndarray, query_ids: np.ndarray, q: np.ndarray, q_points: np.ndarray, last: np.ndarray, size: np.ndarray, top: float, quantile: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the query, id, score) of the best ``most`` rows of a part that the stopping test lets be verified and that reach ``last``."""
    order, bounds = buckets(points, BUCKET_ROWS)
    ids, x, points = ids[order], x[order], points[order]
    low = np.array([points[a:b].min(axis=0) for a, b in zip(bounds, bounds[1:], strict=False)])
    high = np.array([points[a:b].max(axis=0) for a, b in zip(bounds, bounds[1:], strict=False)])
    squares, q_squares = np.square(points).sum(axis=1), np.square(q_points).sum(axis=1)
    ahead = box_distances(q_points, low, high)
    turns = np.argsort(ahead, axis=1)
    last = last.copy()
    slack = 1e-12 * size * top
    place, rows, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    for turn in range(ahead.shape[1]):
        bucket = turns[:, turn]
        reach = radius(last, size, top, quantile)
        active = ahead[np.arange(len(q)), bucket] <= reach
        if not active.any():
            break
        new_place, new_rows, new_scores = [place], [rows], [scores]
        for b in np.unique(bucket[active]).tolist():
            here = np.flatnonzero(active & (bucket == b))
            part = slice(bounds[b], bounds[b + 1])
            near = q_squares[here, None] + squares[part] - 2 * q_points[here] @ points[part].T <= reach[here, None] * (1 + 1e-9)
            near &= query_ids[here, None] != ids[part]
            s = np.where(near, q[here] @ x[part].T, -np.inf)
            least = last[here]
            if s.shape[1] > most:
                least = np.maximum(least, np.partition(s, -most, axis=1)[:, -most])
            i, j = np.nonzero(near & (s >= (least - slack[here])[:, None]))
            new_place.append(here[i])
            new_rows.append(j + bounds[b])
            new_scores.append(np.einsum("ij,ij->i", q[here[i]], x[part][j]))
        place, rows, scores = np.concatenate(new_place), np.concatenate(new_rows), np.concatenate(new_scores)
        best = np.lexsort((ids[rows], -scores, place))
        rank = np.arange(len(best)) - np.searchsorted(place[best], place[best])
        best, rank = best[rank < most], rank[rank < most]
        place, rows, scores = place[best], rows[best], scores[best]
        full = rank == most - 1
        last[place[full]] = np.maximum(last[place[full]], scores[full])
    return place, ids[rows], scores


def build(rows: DataFrame, projections: int = PROJECTIONS) -> tuple[DataFrame, Index]:
    """The index of a table of (id, vector): the table with leaves and projections, and what tasks have to know."""
    schema = T.StructType([*rows.schema.fields, T.StructField("norm", T.DoubleType())])

    def with_norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("vector").offsets.to_numpy())
            x = matrix(batch.column("vector"), int(sizes.max(initial=0)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norms(x))], names=[*batch.schema.names, "norm"])

    plain = materialize(rows.mapInArrow(with_norms, schema), "ann-rows")
    kinds = plain.groupBy(norm_class(F.col("norm")).alias("kind")).agg(F.count("*").alias("n"), F.max("norm").alias("top"), F.max(F.size("vector")).alias("width")).collect()
    width = max((k.width for k in kinds), default=1)
    directions = np.random.default_rng(_SEED).standard_normal((width + 1, projections))
    tops = {k.kind: k.top for k in sorted(kinds)}

    def project(x: np.ndarray, size: np.ndarray, top: float) -> np.ndarray:
        return x @ directions[:-1] + np.sqrt(np.maximum(top * top - size * size, 0))[:, None] * directions[-1]

    sample = plain.select("vector", "norm", norm_class(F.col("norm")).alias("kind"), F.xxhash64("id").alias("at")).orderBy("at").limit(FIT_ROWS).toArrow().combine_chunks()
    trees, base = {}, 0
    vectors = matrix(sample.column("vector").combine_chunks(), width) if sample.num_rows else np.empty((0, width))
    sample_norms, sample_kinds = (sample.column(c).to_numpy() for c in ("norm", "kind"))
    for k in sorted(kinds):
        own = sample_kinds == k.kind
        levels = max(0, min(math.ceil(math.log2(max(k.n / PART_ROWS, 1))), int(math.log2(MOST_LEAVES)), int(math.log2(max(own.sum(), 1)))))
        trees[k.kind] = fit_tree(project(vectors[own], sample_norms[own], k.top), levels, base)
        base += 2**levels

    fields = [T.StructField("kind", T.IntegerType()), T.StructField("leaf", T.LongType()), T.StructField("point", T.ArrayType(T.FloatType()))]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, size, kind = matrix(batch.column("vector"), width), batch.column("norm").to_numpy(), batch.column("kind").to_numpy()
            points, leaf = np.zeros((len(x), projections), np.float32), np.zeros(len(x), np.int64)
            for k in np.unique(kind).tolist():
                own = kind == k
                points[own] = project(x[own], size[own], tops[k])
                leaf[own] = trees[k].leaf_of(points[own])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * projections, pa.int32()), pa.array(points.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), lists], names=[*batch.schema.names, "leaf", "point"])

    out = materialize(plain.withColumn("kind", norm_class(F.col("norm"))).mapInArrow(placed, T.StructType([*plain.schema.fields, *fields])), "ann-index", instead_of=plain)
    side = lambda f, name: [f(F.col("point")[k]).alias(f"{name}{k}") for k in range(projections)]
    stats = out.groupBy("leaf").agg(F.count("*").alias("n"), F.first("kind").alias("kind"), *side(F.min, "low"), *side(F.max, "high")).orderBy("leaf").collect()
    box = lambda name: np.array([[r[f"{name}{k}"] for k in range(projections)] for r in stats]).reshape(-1, projections)
    parts = np.array([math.ceil(r.n / (2 * PART_ROWS)) for r in stats], np.int64)
    return out, Index(width, directions, tops, trees, np.array([r.leaf for r in stats], np.int64), np.array([r.kind for r in stats]), box("low"), box("high"), parts)


def part_of(key: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(_SEED)), parts).cast("int")


def meet(rows: DataFrame, visits: DataFrame, index: Index, most: int, quantile: float) -> DataFrame:
    """(query_id, id, score) from the parts that the queries visit; ``visits`` has query_id, vector, norm, last, leaf and part."""
    spark = rows.sparkSession
    busy = {r.leaf: r.n for r in visits.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    sizes = spark.createDataFrame([(int(leaf), int(parts), math.ceil(busy.get(int(leaf), 0) / parts / BLOCK_QUERIES)) for leaf, parts in zip(index.leaves, index.parts, strict=True)], "leaf long, parts int, blocks int")
    sizes = F.broadcast(sizes)  # a row for each leaf
    left = rows.join(sizes, "leaf").filter("blocks > 0").select("leaf", part_of(F.col("id"), F.col("parts")).alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "vector", "point", "kind")
    right = visits.join(sizes, "leaf").select("leaf", "part", F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block"), "query_id", "vector", "norm", "last")

    def run(have: pa.Table, want: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not have.num_rows or not want.num_rows:
            return empty
        column = lambda t, c: t.column(c).combine_chunks()
        top = index.tops[have.column("kind")[0].as_py()]
        q, size, query_ids = matrix(column(want, "vector"), index.width), want.column("norm").to_numpy(), want.column("query_id").to_numpy()
        points = matrix(column(have, "point"), index.directions.shape[1])
        place, ids, scores = search(have.column("id").to_numpy(), matrix(column(have, "vector"), index.width), points, query_ids, q, index.queries_in(have.column("kind")[0].as_py(), q, size), want.column("last").to_numpy(), size, top, quantile, most)
        return pa.table({"query_id": query_ids[place], "id": ids, "score": scores})

    return left.groupBy("leaf", "part", "block").cogroup(right.groupBy("leaf", "part", "block")).applyInArrow(run, "query_id long, id long, score double")


def nearest(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", most: int = NEIGHBOURS, projections: int = PROJECTIONS, confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, id, score): for each row of ``df`` whose id meets ``is_query`` (a condition on ``id``), the ``most`` other rows with the largest inner product."""
    quantile = chi_square_quantile(confidence, projections)
    distinct = distinct_rows(df, key, vector, most + 1)
    rows, index = build(distinct, projections)
    # queries may be copies that the index leaves out, so they come from the table
    asked = distinct_rows(df.filter(F.col(key).isNotNull()).withColumn("id", F.col(key).cast("long")).filter(is_query).select(F.col("id").alias(key), vector), key, vector, 1 << 30)
    fields = "query_id long, vector array<double>, norm double, last double, leaf long, part int"

    def first_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column("vector"), index.width)
            size = norms(q)
            far = index.box_distances(q, size)
            tops = np.array([index.tops[k] for k in index.leaf_class.tolist()])
            hope = tops * (1 - far / (2 * projections * tops * tops))  # the score that the distance of a leaf's box lets expect
            home = np.argmax(hope, axis=1) if hope.size else np.zeros(len(q), np.int64)
            part = np.abs(batch.column("id").to_numpy()) % index.parts[home] if hope.size else home
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * index.width, pa.int32()), pa.array(q.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists, pa.array(size), pa.array(np.full(len(q), -np.inf)), pa.array(index.leaves[home]), pa.array(part.astype(np.int32))], names=["query_id", "vector", "norm", "last", "leaf", "part"])

    homes = materialize(asked.mapInArrow(first_visits, fields), "ann-queries")
    found = materialize(meet(rows, homes, index, most, quantile), "ann-first")
    known = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    start = homes.join(known, "query_id", "left").select("query_id", "vector", "norm", F.when(F.col("n") == most, F.col("least")).otherwise(float("-inf")).alias("last"), "leaf", "part")

    def more_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = np.array([index.tops[k] for k in index.leaf_class.tolist()])
        for batch in batches:
            q, size, last = matrix(batch.column("vector"), index.width), batch.column("norm").to_numpy(), batch.column("last").to_numpy()
            reach = np.stack([radius(last, size, top, quantile) for top in tops.tolist()], axis=1)
            i, j = np.nonzero((index.box_distances(q, size) <= reach) & (size[:, None] * tops * (1 + 1e-9) >= last[:, None]))
            counts = index.parts[j]
            i, j, part = np.repeat(i, counts), np.repeat(j, counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            new = (index.leaves[j] != batch.column("leaf").to_numpy()[i]) | (part != batch.column("part").to_numpy()[i])
            i, j, part = i[new], j[new], part[new]
            for a in range(0, len(i), 4096):
                s = slice(a, a + 4096)
                taken = batch.take(pa.array(i[s]))
                yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in ("query_id", "vector", "norm", "last")), pa.array(index.leaves[j[s]]), pa.array(part[s].astype(np.int32))], names=["query_id", "vector", "norm", "last", "leaf", "part"])

    visits = materialize(start.mapInArrow(more_visits, fields), "ann-visits")
    both = found.unionByName(meet(rows, visits, index, most, quantile))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return both.withColumn("rank", place).filter(F.col("rank") <= most).select("query_id", "rank", "id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the 20 nearest of every 20th vector."""
    out = nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
