"""Operator 3: near-duplicate detection with BagMinHash signatures of weighted shingle sets.

A text is the multiset of its five-word shingles (words: runs without the characters 0x20 and 0x09-0x0D; a text of fewer words is one
shingle).  BagMinHash: weights are discretised at the whole numbers; every element has a Poisson process over its weight
range whose points carry a signature place, and a signature holds the first point at each place, so two signatures agree at a place with
the probability of the weighted Jaccard similarity.  The range is cut into (0,1], (1,2], (2,4], (4,8] ...; the
process of a wider interval is split at its first point, half to half, down to unit intervals, and intervals beyond the
element's weight are left out, as are processes past the largest value in the signature.  Times are whole
numbers of ticks, so that sums don't depend on their order.

Signatures of 216 places make 36 bands of 6: a pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8**6)**36 > 0.99998.

Equal texts are one node.  Nodes that share a band form a bucket; a bucket is never expanded to pairs.  Instead:
1. Each bucket's hub (the node whose hash is least, mostly the same one for all buckets of a group) is paired with the bucket's other nodes.  Pairs
   are verified by the exact overlap of their multisets; a hub's pairs are dealt to tasks by salts, and each task gets the hub's text once. Verified links
   give components.  This settles groups of copies in as many pairs as they have members.
2. In buckets that still hold several components, nodes of different components are compared by an 8-bit sketch of the signature, without
   their texts: block by block, where nodes of the bucket's largest component meet only nodes outside it, and a pair only in the first band that it
   shares.  Pairs whose estimate comes within 4.5 deviations of the threshold are candidates.  Only nodes that have a candidate in a cell of two blocks come
   there again, now with their texts; a task verifies its candidates, the likeliest first and none within what it has linked, and only verified links leave it.
   Blocks are bounded by their texts' bytes.
Classes are the components of all verified links: no link between different texts is lost, but for the stated probabilities.

Defined results: null text equals the empty text; texts without words are like their equals only; repeated rows are all returned, with one class; a class has the
least doc_id of its rows as id (null if it has none else); an empty table gives an empty table.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm._text import WordHashes, by_bytes, held, mix64, shingles, weighted_jaccard
from linkweave.session import discard, materialize, table

BANDS, ROWS = 36, 6
PLACES = BANDS * ROWS
THRESHOLD = 0.8
#: Weight of a block of a bucket, a node weighing as many as it has times NODE_BYTES of text; parts that a hub's pairs are dealt to.
BLOCK, NODE_BYTES, SALTS = 1024, 4096, 512
#: Deviations below the threshold at which a sketch still counts.
DEVIATIONS = 4.5
_TICKS = float(1 << 40)
_NEVER = np.int64(1) << np.int64(62)
_G = np.uint64(0x9E3779B97F4A7C15)
_SIDE = np.uint64(0x6A09E667F3BCC909)


def _waits(seed: np.ndarray, count: np.ndarray, rate: np.ndarray | int) -> np.ndarray:
    """Ticks until the next point of a process: exponential, from the seed and the number of the point."""
    u = (mix64(seed + (count.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _G) >> np.uint64(11)).astype(np.float64) + 0.5
    return np.maximum(1, (-np.log(u / float(1 << 53)) * (_TICKS / rate)).astype(np.int64))


def _places(seed: np.ndarray, count: np.ndarray) -> np.ndarray:
    return ((mix64(seed + (count.astype(np.uint64) * np.uint64(2) + np.uint64(2)) * _G) >> np.uint64(32)) * np.uint64(PLACES) >> np.uint64(32)).astype(np.int64)


def _seed(element: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return mix64(element ^ mix64((low.astype(np.uint64) << np.uint64(32)) + high.astype(np.uint64) + _G))


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """texts x PLACES ticks; ``owner``: the text of each element.  Texts without elements have _NEVER everywhere."""
    out = np.full((texts, PLACES), _NEVER)
    flat = out.reshape(-1)
    # One process for each element and dyadic interval that its weight reaches into.
    low, high, o, e, w = [], [], [], [], []
    a, b = 0, 1
    at = np.arange(len(weight))
    while len(at):
        low.append(np.full(len(at), a))
        high.append(np.full(len(at), b))
        o.append(owner[at])
        e.append(element[at])
        w.append(weight[at])
        a, b = b, 2 * b
        at = at[weight[at] > a]
    if not o:
        return out
    low, high, o, e, w = map(np.concatenate, (low, high, o, e, w))
    seed = _seed(e, low, high)
    count = np.zeros(len(o), np.int64)
    x = _waits(seed, count, high - low)
    size = 1
    while len(o):
        # Wider intervals: the point goes to one half, the other half gets a process of its own from there on.
        wide = np.flatnonzero(high - low > 1)
        if len(wide):
            middle = (low[wide] + high[wide]) // 2
            right = (mix64(seed[wide] + _SIDE) >> np.uint64(63)).astype(bool)
            halves = [(low[wide], middle, ~right), (middle, high[wide], right)]
            unit = np.flatnonzero(high - low == 1)
            parts = [(o[unit], e[unit], w[unit], low[unit], high[unit], seed[unit], count[unit], x[unit])]
            for p, q, has in halves:
                s = _seed(e[wide], p, q)
                zero = np.zeros(len(wide), np.int64)
                later = x[wide] + np.where(has, 0, _waits(s, zero, q - p))
                reach = p < w[wide]
                parts.append(tuple(v[reach] for v in (o[wide], e[wide], w[wide], p, q, s, zero, later)))
            o, e, w, low, high, seed, count, x = (np.concatenate(v) for v in zip(*parts, strict=True))
        unit = high - low == 1
        if unit.any():
            u = np.flatnonzero(unit)
            top = out.max(1)
            k = count[u][:, None] + np.arange(size)
            # x is the point of number count; the ones after it follow by waits
            steps = _waits(seed[u][:, None], k + 1, 1)
            points = x[u][:, None] + np.concatenate([np.zeros((len(u), 1), np.int64), np.cumsum(steps[:, :-1], 1)], 1)
            place = o[u][:, None] * PLACES + _places(seed[u][:, None], k)
            early = points < top[o[u]][:, None]
            np.minimum.at(flat, place[early], points[early])
            x[u] = points[:, -1] + steps[:, -1]
            count[u] += size
        go = x < out.max(1)[o]
        o, e, w, low, high, seed, count, x = (v[go] for v in (o, e, w, low, high, seed, count, x))
        size = min(64, size * 2)
    return out


def bands_of(signature: np.ndarray) -> np.ndarray:
    """A 64-bit value for each band; the band's number is part of it."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _G, parts.shape[:2]).copy()
    for k in range(ROWS):
        out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, k])
    return out.view(np.int64)


def text_key(text: F.Column) -> F.Column:
    """128 bits that stand for the text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, key, n_bytes, bands (empty for texts without words), marks (32 bits of each band), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = held("words", WordHashes)
        for whole in batches:
            for batch in by_bytes(whole, "text", 1 << 19):
                bags = [np.unique(shingles(hashes.of(x)), return_counts=True) for x in batch.column("text").to_pylist()]
                sizes = [len(h) for h, _ in bags]
                signature = signatures(np.repeat(np.arange(len(bags)), sizes), np.concatenate([h for h, _ in bags]), np.concatenate([n for _, n in bags]), len(bags))
                bands, sketch = bands_of(signature), (mix64(signature.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8)
                rows = [b.tolist() if n else [] for b, n in zip(bands, sizes, strict=True)]
                marks = pa.array([b.tobytes() for b in bands.astype(np.uint32)], pa.binary())
                columns = [batch.column("doc_id"), batch.column("key"), batch.column("n_bytes"), pa.array(rows, pa.list_(pa.int64())), marks, pa.array([s.tobytes() for s in sketch], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "n_bytes", "bands", "marks", "sketch"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n_bytes"), "text")
    return keyed.mapInArrow(run, "doc_id long, key binary, n_bytes int, bands array<long>, marks binary, sketch binary")


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) of keys, those whose multisets overlap by ``threshold`` or more, with the similarity.

    The pairs of one ``a`` are dealt by salts; in each part its text comes first, as a row without ``b``, and the others follow."""
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"))
    members = salted.join(texts.select(F.col("key").alias("b"), "text"), "b").select("a", "salt", "b", "text")
    firsts = salted.select("a", "salt").distinct().join(texts.select(F.col("key").alias("a"), "text"), "a").select("a", "salt", F.lit(None).cast("binary").alias("b"), "text")
    dealt = members.unionByName(firsts).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = held("words", WordHashes)
        bag = np.empty(0, np.uint64)
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                rows = []
                for x, y, text in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text")), strict=True):
                    other = shingles(hashes.of(text))
                    if y is None:
                        bag = other
                    elif (similarity := weighted_jaccard(bag, other)) >= threshold:
                        rows.append((x, y, similarity))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.binary(), pa.float64()), strict=True)], names=["a", "b", "similarity"])

    return dealt.mapInArrow(run, "a binary, b binary, similarity double")


def components(links: DataFrame) -> DataFrame:
    """(key, component) for every key in ``links`` (a, b): the least key that it is connected with.

    A key takes the least label around it and then that label's own label, until none changes."""
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(ends.unionByName(ends.select("a", F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("component")), "labels")
    while True:
        near = edges.join(labels.select(F.col("key").alias("b"), "component"), "b").groupBy(F.col("a").alias("key")).agg(F.min("component").alias("next"), F.min(F.when(F.col("a") == F.col("b"), F.col("component"))).alias("was"))
        jump = labels.select(F.col("key").alias("next"), F.col("component").alias("further"))
        labels = materialize(near.join(jump, "next").select("key", F.col("further").alias("component"), (F.col("further") != F.col("was")).alias("changed")), "labels", instead_of=labels)
        if labels.filter("changed").isEmpty():
            discard(edges)
            return labels


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links between nodes."""
    of = lambda side: found.select(F.col("key").alias(side), F.col("component").alias(f"{side}_part"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b")).distinct()
    joined = components(between).select("key", F.col("component").alias("whole"))
    known = found.select("key", "component").unionByName(joined.select("key", F.col("key").alias("component"))).dropDuplicates(["key"])
    return materialize(known.join(joined.withColumnRenamed("key", "component"), "component", "left").select("key", F.coalesce("whole", "component").alias("component")), "components")


def _near(first: np.ndarray, second: np.ndarray, sketch: np.ndarray, marks: np.ndarray, band: int, part: np.ndarray, agree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (x, y, places that agree) of nodes of different parts whose sketches come near the threshold and whose first common band is this one.

    If ``first`` is ``second``, each pair comes once."""
    x, y, alike = [], [], []
    for n, k in enumerate(first.tolist()):
        others = second[n + 1 :] if second is first else second
        others = others[part[others] != part[k]]
        same = (sketch[others] == sketch[k]).sum(1)
        near = same >= agree
        others, same = others[near], same[near]
        here = (marks[others] == marks[k]).argmax(1) == band
        x.append(np.full(here.sum(), k))
        y.append(others[here])
        alike.append(same[here])
    return tuple(np.concatenate(v) if v else np.empty(0, np.int64) for v in (x, y, alike))


def _cell(group: pa.Table, agree: int) -> tuple[list[bytes], list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Keys and components of a cell's nodes and its near pairs."""
    keys, parts = group.column("key").to_pylist(), group.column("component").to_pylist()
    number = {p: k for k, p in enumerate(set(parts))}
    sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, PLACES)
    marks = np.frombuffer(b"".join(group.column("marks").to_pylist()), np.uint32).reshape(-1, BANDS)
    first = group.column("first").to_numpy()
    one = group.column("kind")[0].as_py() == 1 and group.column("i")[0] == group.column("j")[0]  # a block with itself
    a = np.arange(len(keys)) if one else np.flatnonzero(first)
    b = a if one else np.flatnonzero(~first)
    return keys, parts, *_near(a, b, sketch, marks, group.column("band")[0].as_py(), np.array([number[p] for p in parts]), agree)


def block_links(shared: DataFrame, found: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Verified links (a, b) between different components within buckets."""
    placed = shared.select("bucket", "band", "key", "weight").join(found.select("key", "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    placed = placed.withColumn("part", F.xxhash64("component"))
    parts = placed.groupBy("bucket", "part").agg(F.sum("weight").alias("n"))
    mixed = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max("n").alias("inner"), F.max_by("part", "n").alias("largest")).filter("parts > 1")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    mine = placed.join(mixed, "bucket").withColumns({"in": F.col("part") == F.col("largest"), "rows": blocks(F.col("inner")), "columns": blocks(F.col("n") - F.col("inner"))})
    mine = mine.withColumn("own", F.pmod(F.xxhash64("key", F.lit(1)), F.when(F.col("in"), F.col("rows")).otherwise(F.col("columns"))).cast("int"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda kind, i, j, first: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), first.alias("first"))
    own = F.col("own")
    # A node of the largest component meets all blocks outside it; the others meet those as well, and one another.
    inside = F.transform(every(F.col("columns")), lambda j: cell(0, own, j, F.lit(True)))
    across = F.transform(every(F.col("rows")), lambda i: cell(0, i, own, F.lit(False)))
    among = F.transform(every(F.col("columns")), lambda j: cell(1, F.least(own, j), F.greatest(own, j), own <= j))
    dealt = mine.withColumn("cell", F.explode(F.when(F.col("in"), inside).otherwise(F.concat(across, among)))).select("bucket", "band", "cell.*", "key", "component")
    dealt = dealt.join(nodes.select("key", "sketch", "marks"), "key")
    least = threshold - DEVIATIONS * (threshold * (1 - threshold) / PLACES) ** 0.5
    agree = int(np.floor((least + (1 - least) / 256) * PLACES))

    def candidates(group: pa.Table) -> pa.Table:
        """The rows of the nodes that have a near pair here."""
        *_, x, y, _ = _cell(group, agree)
        return group.take(pa.array(np.unique(np.concatenate([x, y]))))

    def verified(group: pa.Table) -> pa.Table:
        keys, parts, x, y, alike = _cell(group, agree)
        texts, hashes, bags, joined = group.column("text"), held("words", WordHashes), {}, {}

        def top(p: bytes) -> bytes:
            while p in joined:
                p = joined[p]
            return p

        def bag(k: int) -> np.ndarray:
            if k not in bags:
                bags[k] = shingles(hashes.of(texts[k].as_py()))
            return bags[k]

        a, b = [], []
        for k in np.argsort(-alike, kind="stable").tolist():
            p, q = top(parts[x[k]]), top(parts[y[k]])
            if p != q and weighted_jaccard(bag(int(x[k])), bag(int(y[k]))) >= threshold:
                joined[p] = q
                a.append(keys[x[k]])
                b.append(keys[y[k]])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    cells = ("bucket", "kind", "i", "j")
    near = dealt.groupBy(*cells).applyInArrow(candidates, dealt.schema)
    return near.join(texts, "key").groupBy(*cells).applyInArrow(verified, "a binary, b binary")


def classify(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, key and class_id for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(sign(docs), "signatures")
    nodes = signed.filter(F.size("bands") > 0).dropDuplicates(["key"])
    weight = F.greatest(F.lit(1), F.col("n_bytes") / NODE_BYTES).cast("int")
    placed = nodes.select("key", weight.alias("weight"), F.xxhash64("key").alias("order"), F.posexplode("bands").alias("band", "bucket"))
    sizes = materialize(placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("order").alias("least")).filter("n > 1").select("bucket", "least"), "buckets")
    shared = materialize(placed.join(sizes, "bucket").select("bucket", "band", "key", "weight", (F.col("order") == F.col("least")).alias("hub")), "shared", instead_of=sizes)
    hubs = shared.filter("hub").select("bucket", F.col("key").alias("a"))
    first = shared.filter("not hub").join(hubs, "bucket").select("a", F.col("key").alias("b")).distinct()
    keyed = docs.select(text_key(F.col("text")).alias("key"), "text")
    texts = materialize(keyed.join(shared.select("key"), "key", "left_semi").dropDuplicates(["key"]), "texts")
    found = components(verify(first, texts, threshold))
    links = materialize(block_links(shared, found, nodes, texts, threshold).distinct(), "links")
    if not links.isEmpty():
        found = merged(found, links)
    discard(shared, texts, links)
    rows = signed.select("doc_id", "key").join(found.select("key", "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    classes = rows.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    return rows.join(classes, "component").select("doc_id", "key", "component", "class_id")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class: one with the least doc_id, all columns as they are."""
    name = lambda doc_id: F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("null"))
    of = classify(docs.select("doc_id", "text"), threshold)
    best = of.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("component").agg(F.min("key").alias("__near_key"), F.min("doc_id").alias("least")).select("__near_key", name("least").alias("__near_id"))
    keyed = docs.withColumns({"__near_key": text_key(F.col("text")), "__near_id": name("doc_id")})
    # The rows of a key and id are together after the join, so repeated ones go without another exchange.
    return keyed.join(best, ["__near_key", "__near_id"], "left_semi").dropDuplicates(["__near_key", "__near_id"]).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: class of every document."""
    return classify(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
