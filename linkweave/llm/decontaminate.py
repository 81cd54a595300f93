"""Operator 4: benchmark decontamination with SimHash windows.

Words are runs of letters and digits in lower case; shingles are five words.  Against an item of n words stand the
windows of n words of a text; a text of fewer words stands as a whole, as one window, if it has enough shingles for the
threshold.  Both get a 64-bit SimHash of their shingles, weighted by their counts.  The items of a size have a multi-index: for each of four
blocks of 16 bits, a table from block values to items.  Two fingerprints within 20 bits agree in one block but for 5 bits, so looking up
all values within 5 bits of each block of a window finds all items within the radius.  What is found is verified
by the exact weighted Jaccard similarity of the shingles, 0.8 or more.

The radius alone would miss pairs near the threshold, the more the more often shingles repeat (counts weigh squared in the cosine that
the distance follows).  So windows beyond it are verified as well if they hold enough shingles of the item: with m and n shingles
and a similarity of t, t (m + n) / (1 + t) at least are common.  An inverted table from shingles to items gives these windows.  This bound is exact, so no pair is missed.

A window that shares no shingle with an item of its size has similarity 0; such windows get no fingerprint.  No step goes over all items: tables lead to
the items that a text has something of.

The benchmark goes to all tasks in blocks of a bounded size: one pass over the documents for each block.  Texts are worked on where
they lie, each as a whole, without a shuffle.

Defined results: null, empty and wordless texts and items match nothing; items of fewer than five words have one shingle, all their
words; of several windows the most similar counts, on ties the first; each item is reported at most once for a text, in order of its
id, equal ids with different texts by the best; repeated rows are all reported; a column with the name of the output is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm._text import TermHashes, add_column, found_in, held, mix64, shingles, weighted_jaccard
from linkweave.session import table

BITS, BLOCKS, RADIUS, THRESHOLD = 64, 4, 20, 0.8
#: Bytes of item text that a task holds at once.
ITEM_BYTES = 8 << 20
KIND = "array<struct<item_id: long, similarity: double, start_word: long, n_words: long>>"

#: Differing bits that one block of two fingerprints within the radius has at most.
BLOCK_BITS = RADIUS // BLOCKS
_POPCOUNT = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)

#: All changes of a block by BLOCK_BITS bits or fewer.
_CHANGES = np.flatnonzero(_POPCOUNT <= BLOCK_BITS).astype(np.uint16)


def _signs(hashed: np.ndarray) -> np.ndarray:
    """+1 or -1 for every bit of every shingle."""
    bits = np.unpackbits(mix64(hashed + np.uint64(1)).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    """Of sums of signs: blocks of 16 bits, a row for each fingerprint."""
    return np.packbits(sums > 0, axis=1).view(np.uint16).reshape(-1, BLOCKS)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges of ``counts`` numbers from ``starts`` on."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class Postings:
    """A sorted table of keys, each with its members."""

    def __init__(self, keys: np.ndarray, members: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, counts = np.unique(keys, return_counts=True)
        self.members, self.ends = members[order], np.concatenate([[0], np.cumsum(counts)])

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members of the keys at these places, and for each the number of the place that it comes from."""
        counts = self.ends[at + 1] - self.ends[at]
        return self.members[_ranges(self.ends[at], counts)], np.repeat(np.arange(len(at)), counts)


class MultiIndex:
    """Fingerprints by the values of their blocks."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.tables = [Postings(prints[:, k], np.arange(len(prints))) for k in range(BLOCKS)]

    def within(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (number in ``asked``, number in the index) of fingerprints that are at most RADIUS bits apart."""
        pairs = []
        for k, table in enumerate(self.tables):
            values, of_row = np.unique(asked[:, k], return_inverse=True)
            rows_of = Postings(of_row, np.arange(len(asked)))
            for first in range(0, len(values), 256):  # so that the temporary tables stay small
                some = values[first : first + 256]
                # the neighbours of each value in the table: by its keys or by the changes of a block, whichever are fewer
                if len(table.keys) <= len(_CHANGES):
                    value, key = np.nonzero(_POPCOUNT[some[:, None] ^ table.keys[None, :]] <= BLOCK_BITS)
                else:
                    at = found_in((some[:, None] ^ _CHANGES[None, :]).ravel(), table.keys)
                    value, key = np.flatnonzero(at >= 0) // len(_CHANGES), at[at >= 0]
                members, of_key = table.of(key)
                rows, of_member = rows_of.of(first + value[of_key])
                pairs.append(rows * len(self.prints) + members[of_member])
        row, member = np.divmod(np.unique(np.concatenate(pairs)), len(self.prints))
        close = _POPCOUNT[asked[row] ^ self.prints[member]].sum(1, dtype=np.int32) <= RADIUS
        return row[close], member[close]


class Index:
    """Items of a benchmark: their shingles, and a multi-index of fingerprints for each number of words."""

    def __init__(self, items: list[tuple[int, str]]):
        hashes = TermHashes()
        counted = [(item_id, hashes.of(text)) for item_id, text in items]
        counted = [(item_id, words) for item_id, words in counted if len(words)]
        self.ids, self.words = [x[0] for x in counted], np.array([len(x[1]) for x in counted], np.int64)
        self.shingles = [shingles(words) for _, words in counted]
        #: for each width of shingles, a table from shingles to items
        self.known: dict[int, Postings] = {}
        for width in np.unique(np.minimum(5, self.words)).tolist():
            mine = [(k, np.unique(s)) for k, s in enumerate(self.shingles) if min(5, self.words[k]) == width]
            self.known[width] = Postings(np.concatenate([s for _, s in mine]), np.repeat([k for k, _ in mine], [len(s) for _, s in mine]))
        self.sizes: dict[int, tuple[np.ndarray, MultiIndex]] = {}
        for size in np.unique(self.words).tolist():
            members = np.flatnonzero(self.words == size)
            self.sizes[size] = (members, MultiIndex(_fingerprints(np.stack([_signs(self.shingles[k]).sum(0) for k in members]))))

    def scan(self, words: np.ndarray, threshold: float = THRESHOLD) -> list[dict]:
        best: dict[int, dict] = {}
        for width, known in self.known.items():
            if len(words) < width:
                continue
            text = shingles(words, width)
            at = found_in(text, known.keys)
            places = np.flatnonzero(at >= 0)
            if not len(places):
                continue
            items, of_place = known.of(at[places])
            found: set[tuple[int, int]] = set()
            sizes = self.words[items]
            for size in np.unique(sizes).tolist():
                span = self._span(text, size, width, threshold)
                if span:
                    shared = np.unique(places[of_place[sizes == size]])
                    found |= self._near_prints(text, shared, size, span)
                    found |= self._with_enough(text, items[sizes == size], places[of_place[sizes == size]], span, threshold)
            for k, start in sorted(found):
                span = self._span(text, int(self.words[k]), width, threshold)
                similarity = weighted_jaccard(text[start : start + span], self.shingles[k])
                if similarity >= threshold and (self.ids[k] not in best or similarity > best[self.ids[k]]["similarity"]):
                    best[self.ids[k]] = {"item_id": self.ids[k], "similarity": similarity, "start_word": start, "n_words": span + width - 1}
        return [best[k] for k in sorted(best)]

    @staticmethod
    def _span(text: np.ndarray, size: int, width: int, threshold: float) -> int:
        """Shingles in a window for items of this size; 0 if the text is too short to come near one."""
        span = size - width + 1
        return min(span, len(text)) if len(text) >= threshold * span else 0

    def _near_prints(self, text: np.ndarray, shared: np.ndarray, size: int, span: int) -> set[tuple[int, int]]:
        """(item, start) of the windows with one of the places ``shared`` and a fingerprint within the radius."""
        last = len(text) - span
        near = np.zeros(last + 2, np.int32)
        np.add.at(near, np.clip(shared - span + 1, 0, last + 1), 1)
        np.add.at(near, np.clip(shared + 1, 0, last + 1), -1)
        starts = np.flatnonzero(np.cumsum(near)[: last + 1] > 0)
        members, index = self.sizes[size]
        found = set()
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            for part in (run[cut : cut + 4096] for cut in range(0, len(run), 4096)):
                sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(_signs(text[part[0] : part[-1] + span]), 0, dtype=np.int32)])
                row, member = index.within(_fingerprints(sums[span:] - sums[:-span]))
                found.update(zip(members[member].tolist(), part[row].tolist(), strict=True))
        return found

    def _with_enough(self, text: np.ndarray, items: np.ndarray, places: np.ndarray, span: int, threshold: float) -> set[tuple[int, int]]:
        """(item, start) of the windows that hold enough shingles of the item for the threshold."""
        last, found = len(text) - span, set()
        order = np.argsort(items, kind="stable")
        items, places = items[order], places[order]
        begins = np.flatnonzero(np.diff(items, prepend=-1))
        for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(items)], strict=True):
            k = int(items[begin])
            need = threshold * (span + len(self.shingles[k])) / (1 + threshold) - 1e-6
            if end - begin >= need:
                mine = np.sort(places[begin:end])
                starts = np.arange(max(0, mine[0] - span + 1), min(last, mine[-1]) + 1)
                held = np.searchsorted(mine, starts + span) - np.searchsorted(mine, starts)
                found.update((k, w) for w in starts[held >= need].tolist())
        return found


def annotate(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "matches", threshold: float = THRESHOLD, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Adds the benchmark items (``item_id``, ``text``) found in each text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).dropDuplicates()
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-int(size) // item_bytes))
    names = [f"__matches_{k}" for k in range(blocks)]
    for k, name in enumerate(names):
        rows = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()]
        block = docs.sparkSession.sparkContext.broadcast(rows)

        def prepare(block=block) -> Callable[[str | None], list[dict]]:
            hashes, index = held("terms", TermHashes), Index(block.value)
            return lambda value: index.scan(hashes.of(value), threshold)

        docs = add_column(docs, text, name, KIND, prepare)
    return docs.withColumn(out, F.col(names[0]) if blocks == 1 else F.flatten(F.array(*names))).drop(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: a row for every document and benchmark item found in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return annotate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.inline("matches"))
