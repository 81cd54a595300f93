"""Operator 13: periodic runs of words by the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of words with smallest period q (words q apart are identical), of at least ``max(6, 4 * q)`` words, that no neighbouring
word extends.  For a sequence of words the method takes these steps:

1. a suffix tree (Ukkonen); the deepest ancestor of each suffix that begins earlier gives the Lempel-Ziv blocks;
2. for each block and each length k, common extensions at the block's borders (Z functions) give squares that cover all leftmost ones;
3. the squares' places in the tree are marked; walks along suffix links mark their rotations too, until the vocabulary of squares is complete;
4. the leaves below a mark are all occurrences of its square; neighbouring occurrences of one length merge into runs.

Only squares with a primitive root are marked (there are at most n log n occurrences of these); of equal stretches the smallest period stays.

Every window of five words of such a run comes twice in it.  So the tree is built only for stretches in which all windows of five words come again
within the stretch; these are found with sorted hashes for many texts at once.  A hash that two windows share makes a stretch longer, never
shorter, so no run is lost.

A text's words are numbers as soon as they are split, in pieces of 1 MB; the tree holds some 600 bytes for each word of a repetitive stretch.
Spark deals the texts; texts don't depend on one another, and nothing is shuffled.

Defined results: null and empty texts have no words and no runs; repeated rows and ids are handled one by one; an empty table gives an empty
table; further columns are carried along, but a column that has the name of an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from linkweave.llm._text import _BLANK_BYTE, _C1, by_bytes, mix64, pieces
from linkweave.session import table

#: The least words of a run, and the least number of periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4

#: Words in the windows that must come again: with five, each window of a run of that size has a partner one period away.
WINDOW = 5

_MODULUS, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E687 % ((1 << 61) - 1)


class SuffixTree:
    """Of a list of small numbers; a sentinel greater than all of them ends it.

    ``depth`` is the length of a node's path, ``first`` its leftmost occurrence, ``edge`` finds children by ``node * sigma + symbol``."""

    def __init__(self, symbols: list[int]):
        self.sigma = sigma = max(symbols, default=-1) + 2
        self.s = s = [*symbols, sigma - 1]
        n = len(s)
        begin, end, link, depth, edge = [0], [0], [0], [0], {}
        leaf_of = [0] * n
        node = length = at = open_suffixes = 0
        for i, c in enumerate(s):
            waiting = 0
            open_suffixes += 1
            while open_suffixes:
                if not length:
                    at = i
                key = node * sigma + s[at]
                child = edge.get(key)
                start = i - open_suffixes + 1
                if child is None:
                    leaf_of[start] = edge[key] = len(begin)
                    begin.append(i)
                    end.append(n)
                    link.append(0)
                    depth.append(n - start)
                    if waiting:
                        link[waiting] = node
                    waiting = node
                else:
                    b = begin[child]
                    size = min(end[child], i + 1) - b
                    if length >= size:
                        at += size
                        length -= size
                        node = child
                        continue
                    if s[b + length] == c:
                        length += 1
                        if waiting:
                            link[waiting] = node
                        break
                    split = edge[key] = len(begin)
                    leaf_of[start] = split + 1
                    begin += (b, i)
                    end += (b + length, n)
                    link += (0, 0)
                    depth += (i - start, n - start)
                    edge[split * sigma + c] = split + 1
                    begin[child] = b + length
                    edge[split * sigma + s[b + length]] = child
                    if waiting:
                        link[waiting] = split
                    waiting = split
                open_suffixes -= 1
                if not node and length:
                    length -= 1
                    at = i - open_suffixes + 1
                elif node:
                    node = link[node]
        self.edge, self.link, self.depth, self.leaf_of = edge, link, depth, leaf_of
        self.first = [e - d for e, d in zip(end, depth, strict=True)]
        keys, children = np.fromiter(edge.keys(), np.int64, len(edge)), np.fromiter(edge.values(), np.int64, len(edge))
        above = np.zeros(len(begin), np.int64)
        above[children] = keys // sigma
        self.parent = above.tolist()

    def blocks(self) -> list[int]:
        """Where the Lempel-Ziv blocks begin: each is the longest text that begins earlier too, or a new symbol."""
        edge, depth, first, s, sigma, n = self.edge, self.depth, self.first, self.s, self.sigma, len(self.s) - 1
        starts, h = [], 0
        while h < n:
            starts.append(h)
            node = 0
            while h + depth[node] < n:
                child = edge[node * sigma + s[h + depth[node]]]
                if first[child] >= h:
                    break
                node = child
            h += max(1, depth[node])
        return starts

    def leaves(self) -> tuple[np.ndarray, list[int], list[int]]:
        """Suffixes in the order of the tree, and the range of each node in that order."""
        count = len(self.parent)
        above = np.array(self.parent[1:], np.int64)
        order = np.argsort(above, kind="stable")
        places = np.searchsorted(above[order], np.arange(count + 1)).tolist()
        children = (order + 1).tolist()
        suffix_of = [-1] * count
        for start, leaf in enumerate(self.leaf_of):
            suffix_of[leaf] = start
        low, high, out, stack = [0] * count, [0] * count, [], [0]
        while stack:
            node = stack.pop()
            if node < 0:
                high[~node] = len(out)
                continue
            low[node] = len(out)
            if suffix_of[node] >= 0:
                out.append(suffix_of[node])
                high[node] = len(out)
            else:
                stack.append(~node)
                stack.extend(children[places[node] : places[node + 1]])
        return np.array(out, np.int64), low, high


def z_function(s: list[int]) -> list[int]:
    """For each place the length of the longest common prefix with the whole list."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[i + k] == s[k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


@lru_cache(maxsize=4)
def _least_factors(size: int) -> list[int]:
    """Least prime factor of each number below ``size``."""
    least = np.arange(size)
    for p in range(2, int(size**0.5) + 1):
        if least[p] == p:
            part = least[p * p :: p]
            part[part == np.arange(p * p, size, p)] = p
    return least.tolist()


class _Primitive:
    """Tells whether a square's root is no power of a shorter text, with polynomial hashes."""

    def __init__(self, s: list[int]):
        value, power, self.values, self.powers = 0, 1, [0], [1]
        for c in s:
            value = (value * _BASE + c + 1) % _MODULUS
            power = power * _BASE % _MODULUS
            self.values.append(value)
            self.powers.append(power)
        size = 1024
        while size <= len(s):
            size *= 2
        self.least = _least_factors(size)

    def root(self, start: int, k: int) -> bool:
        values, rest = self.values, k
        while rest > 1:
            p = self.least[rest]
            while rest % p == 0:
                rest //= p
            q = k // p
            size = 2 * k - q
            power = self.powers[size]
            if (values[start + size] - values[start] * power) % _MODULUS == (values[start + 2 * k] - values[start + q] * power) % _MODULUS:
                return False
        return True


def leftmost_squares(s: list[int], starts: list[int]) -> Iterator[tuple[int, int]]:
    """(start, length of the root) of squares that cover every leftmost square: those whose centre is in a block and that touch one of its borders."""
    n = len(s)
    bounds = [*starts, n, n]
    for b in range(len(starts)):
        h, h1, h2 = bounds[b], bounds[b + 1], bounds[b + 2]
        size = h1 - h
        if h1 < n:
            forward = z_function(s[h1 : h1 + size] + [-1] + s[h1 - size : h1])[-size:]
            backward = z_function(s[max(0, h1 - 2 * size) : h1][::-1])
            c = s[h1]
            for k in range(1, size + 1):
                q = h1 - k
                if s[q] == c:
                    k1, k2 = forward[size - k], backward[k] if k < len(backward) else 0
                    if k1 + k2 >= k:
                        yield max(q - k2, q - k + 1), k
        most = min(h2 - h, n - h - 1)
        if h and most > 0:
            forward = z_function(s[h : h + 2 * most])
            before, after = s[max(0, h - most) : h][::-1], s[h : h + most][::-1]
            backward = z_function(before + [-1] + after)[-most:]
            c = s[h - 1]
            for k in range(1, most + 1):
                if s[h - 1 + k] == c:
                    k1, k2 = forward[k] if k < len(forward) else 0, backward[most - k]
                    if k1 and k1 + k2 >= k and (start := max(h - k2, h - k + 1)) + k <= h1:
                        yield start, k


def runs_of(symbols: list[int], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of small numbers, by start and then period."""
    n = len(symbols)
    if n < max(least_words, 2):
        return []
    tree = SuffixTree(symbols)
    s, sigma, edge, link, depth, first, parent = tree.s, tree.sigma, tree.edge, tree.link, tree.depth, tree.first, tree.parent
    primitive = _Primitive(symbols)
    by_start: dict[int, set[int]] = {}
    for start, k in leftmost_squares(symbols, tree.blocks()):
        if primitive.root(start, k):
            by_start.setdefault(start, set()).add(2 * k)
    size = n + 1
    marks: set[int] = set()  # node * size + length of the square
    for start, lengths in by_start.items():
        node = tree.leaf_of[start]
        for length in sorted(lengths, reverse=True):
            while depth[parent[node]] >= length:
                node = parent[node]
            if first[node] != start:
                break  # shorter ones begin earlier too: other squares cover them
            marks.add(node * size + length)
    for mark in list(marks):
        node, length = divmod(mark, size)
        while True:  # to the rotation by one symbol
            i = first[node]
            above = parent[node]
            at = link[above] if above else 0
            below = at
            while depth[below] < length - 1:
                at, below = below, edge[below * sigma + s[i + 1 + depth[below]]]
            if depth[below] == length - 1:
                node = edge.get(below * sigma + s[i], 0)
            else:
                node = below if s[first[below] + length - 1] == s[i] else 0
            if not node or node * size + length in marks:
                break
            marks.add(node * size + length)
    if not marks:
        return []
    suffixes, low, high = tree.leaves()
    nodes, lengths = np.divmod(np.fromiter(marks, np.int64, len(marks)), size)
    begin = np.array(low, np.int64)[nodes]
    counts = np.array(high, np.int64)[nodes] - begin
    total = np.cumsum(counts)
    at = np.repeat(begin - (total - counts), counts) + np.arange(total[-1])
    found = np.sort(np.repeat(lengths // 2, counts) * size + suffixes[at])
    heads = np.flatnonzero(np.concatenate([[True], np.diff(found) != 1]))
    period, start = np.divmod(found[heads], size)
    length = np.diff(np.append(heads, len(found))) - 1 + 2 * period
    keep = length >= np.maximum(least_words, least_periods * period)
    best: dict[tuple[int, int], int] = {}
    for a, b, q in zip(start[keep].tolist(), length[keep].tolist(), period[keep].tolist(), strict=True):
        best[a, b] = min(q, best.get((a, b), q))
    return sorted(((a, b, q) for (a, b), q in best.items()), key=lambda r: (r[0], r[2]))


def repetitive_stretches(ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, start, stop) of stretches in which every window of five words comes again; ``ends`` are the places in ``ids`` where texts end."""
    n = len(ids) - WINDOW + 1
    if n <= 0:
        return
    gram = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        gram = mix64(gram * _C1 + ids[k : k + n].astype(np.uint64))
    text = np.searchsorted(ends, np.arange(len(ids)), side="right")
    place = np.flatnonzero(text[:n] == text[WINDOW - 1 :])
    stretch = text[place]
    while len(place):
        keys = mix64(gram[place] ^ mix64(stretch.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        again = np.zeros(len(place), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        done = again.all()
        place, stretch = place[again], stretch[again]
        if not len(place):
            return
        breaks = (np.diff(place) != 1) | (np.diff(stretch) != 0)
        if done:
            heads = np.concatenate([[0], np.flatnonzero(breaks) + 1])
            stops = np.append(heads[1:], len(place)) - 1
            for a, b in zip(place[heads].tolist(), place[stops].tolist(), strict=True):
                yield int(text[a]), a, b + WINDOW
            return
        stretch = np.concatenate([[0], np.cumsum(breaks)])


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def numbered(texts: list[str | None]) -> tuple[_Words, list[np.ndarray]]:
    """Words of the texts as numbers, and the table of these."""
    words, out = _Words(), []
    for text in texts:
        parts = [np.empty(0, np.int64)]
        for piece in pieces((text or "").encode(), _BLANK_BYTE):
            split = piece.split()
            parts.append(np.fromiter(map(words.__getitem__, split), np.int64, len(split)))
        out.append(parts[1] if len(parts) == 2 else np.concatenate(parts))
    return words, out


def runs_of_texts(rows: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as numbers of words."""
    ends = np.cumsum([len(r) for r in rows])
    out: list[list[tuple[int, int, int]]] = [[] for _ in rows]
    if not len(rows):
        return out
    ids = np.concatenate(rows)
    for text, a, b in repetitive_stretches(ids, ends):
        base = int(ends[text]) - len(rows[text])
        out[text] += [(a - base + start, length, period) for start, length, period in runs_of(np.unique(ids[a:b], return_inverse=True)[1].tolist())]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapsed(ids: np.ndarray, runs: list[tuple[int, int, int]], words: list[bytes]) -> str:
    """The words joined by one space, without those that come after the first period of a run."""
    if runs:
        keep = np.ones(len(ids), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        ids = ids[keep]
    return b" ".join(map(words.__getitem__, ids.tolist())).decode()


RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def find(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds ``n_words``, ``runs`` (by start, then period; starts are numbers of words from 0) and ``collapsed``, the text without what repeats in runs."""
    new = [T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]
    names = {f.name for f in new} | (set() if keep_text else {text})
    kept = [f for f in df.schema.fields if f.name not in names]
    kind = to_arrow_type(RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, text):
                table_of, rows = numbered(batch.column(text).to_pylist())
                words, runs = list(table_of), runs_of_texts(rows)
                values = pa.array([[dict(zip(("start", "length", "period"), x, strict=True)) for x in r] for r in runs], kind)
                short = pa.array([collapsed(ids, r, words) for ids, r in zip(rows, runs, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array([len(r) for r in rows], pa.int64()), values, short], names=[f.name for f in [*kept, *new]])

    return df.mapInArrow(run, T.StructType([*kept, *new]))


def strongest(runs: Column) -> Column:
    """The run with the greatest ratio of length and period; ties go to the smallest start, then period. Null if there is none."""
    ahead = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(runs, F.get(runs, 0), lambda a, b: F.when(ahead(a, b), b).otherwise(a))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """The query's texts: with h the CRC-32 of the id, in texts with h % 10 = 0 the words from some place on are repeated with some period."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    g, n = F.floor(F.col("__h") / 10), F.size("__words")
    a = F.col("__a")
    p = 1 + F.floor((n - a) / (3 + F.col("__g") % 8))
    tail = F.transform(F.slice("__words", a + 1, F.greatest(n - a, F.lit(0))), lambda w, i: F.get("__words", (a + i % F.col("__p")).cast("int")))
    made = F.array_join(F.concat(F.slice("__words", F.lit(1), a), tail), " ")
    return (
        docs.select("doc_id", "text", crc.alias("__h"))
        .withColumns({"__g": g, "__words": F.when(F.col("__h") % 10 == 0, words)})
        .withColumn("__a", (F.col("__g") % F.greatest(n, F.lit(1))).cast("int"))
        .withColumn("__p", p)
        .select("doc_id", F.when(n > 0, made).otherwise(F.col("text")).alias("text"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the runs of every document, the strongest one, and digests of all runs and of the collapsed text."""
    found = find(with_periodic_tails(table(spark, sf_dir, "documents")), keep_text=False)
    best = strongest(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
