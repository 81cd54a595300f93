"""Operator 12: cross-tokenizer alignment, relational.

``align`` takes texts with the tokens of two tokenizers, as lists of (id, bytes).  Tokens are posexploded; a window sums their lengths to the byte
where each ends; an equi-join on text and end finds where both tokenizers end a token; a running count of these cuts numbers the groups; a join on
text and group, with overlapping byte ranges, gives the links.

A corpus isn't aligned text by text.  There are places where both tokenizers always end a token: before a space or line feed that follows a visible
character, around a single line feed between visible ones, and between ASCII letters, digits and other signs where no piece of the second vocabulary
holds the two characters side by side (``cut_table``, worked out from that vocabulary; if a piece crosses a space or a line feed, a whole text is
one segment).  So texts are cut into segments there, and ``align`` runs once for each distinct segment of the corpus.  Texts
are put together from their segments: they are dealt to groups of about ``GROUP_BYTES`` with a table of the distinct segments of each group, which
are joined with the aligned ones; each group then meets its segments in one task.  In how many texts a pair of ids is linked is counted per
group, summed over the corpus and joined back to the groups.

Defined results: a text that is null or empty, or whose tokens don't give back a space and the text (a text with U+2581), has no tokens, groups or
links, and its digest column is empty.  Repeated rows and ids are handled one by one, and count as texts of their own; an empty table gives an empty
table; further columns are left out.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkweave.llm._text import by_bytes, held
from linkweave.llm.bpe import default_tokenizer, piece_table
from linkweave.session import discard, materialize, table

#: Text bytes of a group, whose texts and distinct segments a task holds at once.
GROUP_BYTES = 16 << 20



def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# ---------------------------------------------------------------- alignment of texts with their tokens


def token_ends(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, pos, id, start, end) of the tokens of each text, in bytes."""
    one = df.select(key, F.posexplode(tokens).alias("pos", "token")).select(key, "pos", "token.id", "token.size")
    end = F.sum("size").over(Window.partitionBy(key).orderBy("pos"))
    return one.withColumn("end", end).select(key, "pos", "id", (F.col("end") - F.col("size")).alias("start"), "end")


def with_groups(side: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Numbers the groups: how many cuts come before a token."""
    cuts = other.select(key, "end", F.lit(1).alias("cut"))
    before = Window.partitionBy(key).orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    return side.join(cuts, [key, "end"], "left").withColumn("group", F.coalesce(F.sum("cut").over(before), F.lit(0))).drop("cut")


def align(df: DataFrame, key: str = "key", first: str = "a", second: str = "b") -> DataFrame:
    """(key, group, a_pos, a_id, a_start, a_end, b_pos, b_id, b_start, b_end): all pairs of tokens whose byte ranges overlap.

    ``first`` and ``second`` are array<struct<id, size>> whose sizes are positive; ``key`` is unique."""
    a, b = token_ends(df, key, first), token_ends(df, key, second)
    named = lambda t, n: t.select(key, "group", *(F.col(c).alias(f"{n}_{c}") for c in ("pos", "id", "start", "end")))
    left, right = named(with_groups(a, b, key), "a"), named(with_groups(b, a, key), "b")
    return left.join(right, [key, "group"]).filter((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")))


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the jobs inside."""
    names = {"co_partition": "spark.sql.requireAllClusterKeysForCoPartition", "clean_up": "spark.sql.classic.shuffleDependency.fileCleanup.enabled"}
    before = {k: spark.conf.get(names[k], None) for k in values}
    for k, value in values.items():
        spark.conf.set(names[k], value)
    try:
        yield
    finally:
        for k, value in before.items():
            spark.conf.unset(names[k]) if value is None else spark.conf.set(names[k], value)


def co_partitioned(spark: SparkSession):
    """Tables that are dealt by the text stay so in joins by text and end, or text and group."""
    return settings(spark, co_partition="false")


# ---------------------------------------------------------------- tokens of segments


_SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def cut_table(pieces: list[str]) -> np.ndarray:
    """Whether both tokenizers always end a token between two bytes, at 256 times the first plus the second."""
    kind = np.full(256, 3)  # 0 letters, 1 digits, 2 white space, 3 other signs
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")):
        kind[[ord(c) for c in chars]] = k
    kind[_SPACES] = 2
    ascii_ = np.arange(256) < 128
    cut = (kind[:, None] != kind) & (kind[:, None] != 2) & (kind != 2) & ascii_[:, None] & ascii_
    cut[ord("'")] = False  # 's and the like are tokens of the first tokenizer
    for piece in pieces:
        for x, y in itertools.pairwise(piece):
            if x < "\x80" and y < "\x80":
                cut[ord(x), ord(y)] = False
    cut[:, [0x20, 0x0A]] = ~_SPACES[:, None]
    return cut.ravel()


def cut_places(text: np.ndarray, starts: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Where segments begin in the bytes of some texts, which begin with a space each at ``starts``."""
    out = np.zeros(len(text) + 1, bool)
    if len(text):
        out[1:-1] = cut[(text[:-1].astype(np.uint16) << 8) | text[1:]]
    # white space of two or three bytes: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000
    wide = np.flatnonzero((text == 0xC2) | ((text >= 0xE1) & (text <= 0xE3)))
    wide = wide[wide + 1 < len(text)]
    lead, second, third = text[wide], text[wide + 1], text[np.minimum(wide + 2, len(text) - 1)]
    two = (lead == 0xC2) & ((second == 0x85) | (second == 0xA0))
    three = ((lead == 0xE1) & (second == 0x9A) & (third == 0x80)) | ((lead == 0xE2) & (second == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF)))
    three |= ((lead == 0xE2) & (second == 0x81) & (third == 0x9F)) | ((lead == 0xE3) & (second == 0x80) & (third == 0x80))
    first, after = wide[two | three], np.where(two, wide + 2, wide + 3)[two | three]
    out[after] = False
    feeds = np.flatnonzero(text == 0x0A)
    feeds = feeds[(feeds > 0) & (feeds + 1 < len(text))]
    feeds = feeds[~_SPACES[text[feeds - 1]] & ~_SPACES[text[feeds + 1]] & ~np.isin(feeds, after) & ~np.isin(feeds + 1, first)]
    out[feeds + 1] = True
    out[starts] = True
    out[-1] = False
    return np.flatnonzero(out)


class Tokenizers:
    """Both tokenizers, and the bytes of their ids."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True
        self.second = SentencePieceProcessor(model_file=second)
        size = self.second.get_piece_size()
        pieces = self.second.id_to_piece(list(range(size)))
        self.is_byte = [bool(re.fullmatch("<0x[0-9A-F]{2}>", p)) and self.second.is_byte(i) for i, p in enumerate(pieces)]
        self.pieces = (pa.array(piece_table(first), pa.large_binary()), pa.array([bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in zip(pieces, self.is_byte, strict=True)], pa.large_binary()))
        self.sizes = tuple(pc.binary_length(p).to_numpy() for p in self.pieces)
        plain = [p for p, byte in zip(pieces, self.is_byte, strict=True) if not byte]
        #: No piece crosses a line feed, or a space after something else.
        self.cuts_hold = not any("\n" in p or re.search("[^▁]▁", p) for p in plain)
        self.cut_table = cut_table(plain)

    def encode(self, segments: list[str], whole: bool) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of segments by both; ``whole``: each is a space and a text."""
        a = [e.ids for e in self.first.encode_batch_fast(segments, add_special_tokens=False)]
        if whole:
            return a, self.second.encode([s[1:] for s in segments], num_threads=1)
        # a line feed before the segment keeps the added space away from it
        return a, [ids[2:] for ids in self.second.encode(["\n" + s for s in segments], num_threads=1)]


def tokenizers(first: str, second: str) -> Tokenizers:
    return held(("alignment", first, second), lambda: Tokenizers(first, second))


_TOKENS = pa.list_(pa.struct([("id", pa.int32()), ("size", pa.int32())]))


def tokenized(segments: DataFrame, first: str, second: str, whole: bool) -> DataFrame:
    """(segment, ok, a, b): tokens of distinct segments; none where they don't give back the segment."""

    def side(ids: list[list[int]], which: int, both: Tokenizers) -> tuple[pa.Array, pa.Array, pa.Array]:
        ends = np.cumsum([0, *map(len, ids)])
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, ends[-1])
        lists = lambda x: pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), x)
        joined = pc.binary_join(lists(both.pieces[which].take(pa.array(flat))), pa.scalar(b"", pa.large_binary()))
        return flat, ends, joined

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(first, second)
        for large in batches:
            for batch in by_bytes(large, "segment", 1 << 18):
                texts = batch.column("segment")
                encoded = [side(ids, k, both) for k, ids in enumerate(both.encode(texts.to_pylist(), whole))]
                plain = texts.cast(pa.large_string()).cast(pa.large_binary())
                ok = pc.and_(*(pc.equal(joined, plain) for *_, joined in encoded)).to_numpy(zero_copy_only=False)
                columns = []
                for k, (flat, ends, _) in enumerate(encoded):
                    counts = np.where(ok, np.diff(ends), 0)
                    keep = np.repeat(ok, np.diff(ends))
                    values = pa.StructArray.from_arrays([pa.array(flat[keep]), pa.array(both.sizes[k][flat[keep]].astype(np.int32))], names=["id", "size"])
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), values))
                yield pa.RecordBatch.from_arrays([texts, pa.array(ok), *columns], names=["segment", "ok", "a", "b"])

    kind = "array<struct<id:int,size:int>>"
    return segments.mapInArrow(run, f"segment string, ok boolean, a {kind}, b {kind}")


def aligned(tokens: DataFrame, width: int) -> DataFrame:
    """(segment, ok, links) of distinct segments with their tokens; ``links`` as ``pack_links`` has them, with ids of ``width`` bytes."""
    spark = tokens.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), pack_links(batch.column("links"), width)], names=["key", "links"])

    with co_partitioned(spark):
        dealt = tokens.select("key", "a", "b").filter(F.size("a") > 0).repartition(parts, "key")
        links = align(dealt).groupBy("key").agg(F.collect_list(F.struct("group", "a_pos", "b_pos", "a_id", "b_id")).alias("links"))
        return materialize(tokens.select("key", "segment", "ok").join(links.mapInArrow(packed, "key long, links binary"), "key", "left").drop("key"), "align-segments")


#: Bits of a link: it begins a group, a token of the first tokenizer, one of the second; it is the last one.
_GROUP, _FIRST, _SECOND, _LAST = 1, 2, 4, 8


def pack_links(lists: pa.ListArray, width: int) -> pa.BinaryArray:
    """Links (group, a_pos, b_pos, a_id, b_id) of each row in few bytes: a byte of bits for each link in order, ids of the first tokenizer's tokens, then of the second's."""
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    flat = lists.flatten()
    group, a_pos, b_pos, a_id, b_id = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5))
    order = np.lexsort((b_pos, a_pos, group, row))  # with growing a_pos, b_pos grows too
    group, a_pos, b_pos, a_id, b_id = (x[order] for x in (group, a_pos, b_pos, a_id, b_id))
    new = lambda x: np.concatenate([[True], (row[1:] != row[:-1]) | (x[1:] != x[:-1])])[: len(row)]
    firsts, seconds = new(a_pos), new(b_pos)
    bits = _GROUP * new(group) + _FIRST * firsts + _SECOND * seconds
    begins = np.cumsum(counts) - counts
    bits[(begins + counts - 1)[counts > 0]] |= _LAST
    n_a, n_b = (np.bincount(row[x], minlength=len(counts)) for x in (firsts, seconds))
    sizes = counts + width * (n_a + n_b)
    ends = np.cumsum(sizes)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    at = ends - sizes
    out[np.repeat(at - begins, counts) + np.arange(len(row))] = bits
    for ids, n, before in ((a_id[firsts], n_a, counts), (b_id[seconds], n_b, counts + width * n_a)):
        where = np.repeat(at + before - width * (np.cumsum(n) - n), n) + width * np.arange(len(ids))
        for k in range(width):
            out[where + k] = (ids >> (8 * k)) & 255
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(out)])


class Links:
    """What ``pack_links`` has packed, for all rows one after the other; a null row has no links."""

    def __init__(self, packed: pa.BinaryArray, width: int):
        packed = pa.concat_arrays([packed])
        offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64) if len(packed) else np.zeros(1, np.int64)
        data = np.frombuffer(packed.buffers()[2], np.uint8) if packed.buffers()[2] is not None else np.empty(0, np.uint8)
        at, full = offsets[:-1], np.diff(offsets) > 0
        last = np.flatnonzero(data & _LAST)
        self.counts = np.zeros(len(at), np.int64)
        self.counts[full] = last[np.searchsorted(last, at[full])] - at[full] + 1
        self.begins = np.cumsum(self.counts) - self.counts
        bits = data[np.repeat(at - self.begins, self.counts) + np.arange(self.counts.sum())]
        self.groups, self.firsts, self.seconds = ((bits & b) > 0 for b in (_GROUP, _FIRST, _SECOND))
        bounds = np.append(self.begins, len(bits))
        self.n_groups, self.n_a, self.n_b = (_sums(x, bounds) for x in (self.groups, self.firsts, self.seconds))
        ids = []
        for n, before in ((self.n_a, self.counts), (self.n_b, self.counts + width * self.n_a)):
            where = np.repeat(at + before - width * (np.cumsum(n) - n), n) + width * np.arange(n.sum())
            ids.append(sum(data[where + k].astype(np.int64) << (8 * k) for k in range(width)))
        self.a, self.b = ids

    def pairs(self) -> np.ndarray:
        """Of each link, 2^32 times the first id plus the second."""
        return (self.a[np.cumsum(self.firsts) - 1] << 32) | self.b[np.cumsum(self.seconds) - 1]

    def texts(self) -> list[bytes]:
        """Of each row, its groups: ids of the first tokenizer, those of the second, group after group."""
        number = np.cumsum(self.groups) - 1
        who = np.concatenate([2 * number[self.firsts], 2 * number[self.seconds] + 1])
        place = np.argsort(who, kind="stable")
        ids = pa.array(np.concatenate([self.a, self.b])[place]).cast(pa.string())
        bounds = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=2 * int(self.groups.sum())))])
        halves = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), ids), ",")
        groups = pc.binary_join_element_wise(halves.take(pa.array(np.arange(0, len(halves), 2))), halves.take(pa.array(np.arange(1, len(halves), 2))), "|")
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *self.n_groups]), pa.int32()), groups), ";").cast(pa.binary()).to_pylist()


# ---------------------------------------------------------------- texts as lists of segments


def _packed(codes: np.ndarray) -> bytes:
    """Numbers byte by byte, all low bytes first: the high ones are mostly zero and compress to nothing."""
    return codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(codes: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers, and where each text's begin."""
    rows = [np.ascontiguousarray(np.frombuffer(x or b"", np.uint8).reshape(4, -1).T).view("<u4").ravel() for x in codes]
    return np.concatenate([np.empty(0, "<u4"), *rows]).astype(np.int64), np.cumsum([0, *map(len, rows)])


def segments_of(texts: pa.StringArray, cut: np.ndarray | None) -> tuple[pa.StringArray, np.ndarray]:
    """Segments of a space and each text, one after the other, and how many each text has; whole texts without ``cut``."""
    full = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
    spaced = pc.binary_join_element_wise(pa.scalar(" "), pc.if_else(full, texts, pa.scalar("")), pa.scalar("")).filter(full)
    ends = np.frombuffer(spaced.buffers()[1], np.int32)[spaced.offset : spaced.offset + len(spaced) + 1] if len(spaced) else np.zeros(1, np.int32)
    data = np.frombuffer(spaced.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(spaced) else np.empty(0, np.uint8)
    starts = ends[:-1] - ends[0]
    places = starts.astype(np.int64) if cut is None else cut_places(data, starts, cut)
    counts = np.zeros(len(texts), np.int64)
    counts[full.to_numpy(zero_copy_only=False)] = np.diff(np.searchsorted(places, np.append(starts, len(data))))
    offsets = np.append(places, len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(places), pa.py_buffer(offsets), pa.py_buffer(data)), counts


_CODED = "g long, kind int, place int, doc_id long, segment string, codes binary"


def coded(docs: DataFrame, cut: np.ndarray | None, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Groups of texts: a row for each text (kind 0) with the numbers of its segments, and one for each distinct segment of the group (kind 1)."""

    def flush(g: int, ids: list[pa.Array], parts: list[pa.StringArray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        doc_ids, words = pa.concat_arrays(ids), pa.concat_arrays(parts).dictionary_encode()
        numbers = words.indices.to_numpy(zero_copy_only=False)
        common = np.argsort(-np.bincount(numbers, minlength=len(words.dictionary)), kind="stable")
        rank = np.empty(len(common), np.uint32)
        rank[common] = np.arange(len(common))
        codes = [_packed(x) for x in np.split(rank[numbers], np.cumsum(np.concatenate(counts))[:-1])]
        blank = lambda kind, n: pa.nulls(n, kind)
        make = lambda n, kind, *columns: pa.RecordBatch.from_arrays([pa.array(np.full(n, g)), pa.array(np.full(n, kind, np.int32)), pa.array(np.arange(n, dtype=np.int32)), *columns], names=["g", "kind", "place", "doc_id", "segment", "codes"])
        yield make(len(codes), 0, doc_ids, blank(pa.string(), len(codes)), pa.array(codes, pa.binary()))
        dictionary = words.dictionary.take(pa.array(common))
        for at in range(0, len(common), 50_000):
            yield make(len(common), 1, blank(pa.int64(), len(common)), dictionary, blank(pa.binary(), len(common))).slice(at, 50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, ids, parts, counts, size = TaskContext.get().partitionId() << 32, [], [], [], 0
        for large in batches:
            for batch in by_bytes(large, "text"):
                words, each = segments_of(batch.column("text"), cut)
                ids.append(batch.column("doc_id"))
                parts.append(words)
                counts.append(each)
                size += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
                if size >= group_bytes:
                    yield from flush(g, ids, parts, counts)
                    g, ids, parts, counts, size = g + 1, [], [], [], 0
        if ids:
            yield from flush(g, ids, parts, counts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _CODED)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive values between ``ends``."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[ends])


def _texts_with(sizes: np.ndarray, codes: np.ndarray, each: np.ndarray, local: np.ndarray, n_pairs: int) -> np.ndarray:
    """In how many texts each pair is linked; texts have ``sizes`` segments each, segment k has ``each[k]`` of the pairs in ``local``."""
    counts, starts, ends = np.zeros(n_pairs, np.int64), np.cumsum(each) - each, np.cumsum(sizes)
    at = text = 0
    step = max(1, (4 << 20) // max(1, n_pairs))  # texts whose marks are held at once
    while text < len(sizes):
        stop = min(text + step, max(text + 1, int(np.searchsorted(ends, at + (1 << 18), side="right"))))
        here = codes[at : ends[stop - 1]]
        who = np.repeat(np.arange(stop - text), sizes[text:stop])
        n = each[here]
        total = np.cumsum(n)
        pair = local[np.repeat(starts[here] - (total - n), n) + np.arange(total[-1] if len(total) else 0)]
        key = np.repeat(who, n) * n_pairs + pair
        if (stop - text) * n_pairs > 8 * len(key):
            counts += np.bincount(np.unique(key) % n_pairs, minlength=n_pairs) if len(key) else 0
        else:
            marks = np.zeros((stop - text) * n_pairs, np.uint8)
            marks[key] = 1
            counts += marks.reshape(stop - text, n_pairs).sum(axis=0, dtype=np.int64)
        at, text = int(ends[stop - 1]), stop
    return counts


_COUNTED = "g long, kind int, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, pair long, texts long"


def _count(entries: pa.Table, rows: pa.Table, width: int) -> pa.Table:
    """Of a group: its texts with their numbers (kind 0), which pairs each segment has (kind 1), and in how many texts each pair is linked (kind 2)."""
    names = [f.split()[0] for f in _COUNTED.split(", ")]
    kinds = dict(zip(names, [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.binary(), pa.int64(), pa.int64()], strict=True))
    g = rows.column("g")[0].as_py() if rows.num_rows else 0
    entries, rows = entries.sort_by("place").combine_chunks(), rows.sort_by("place").combine_chunks()
    codes, ends = _unpacked(rows.column("codes").to_pylist())
    ok = entries.column("ok").combine_chunks().to_numpy(zero_copy_only=False).astype(bool) if entries.num_rows else np.empty(0, bool)
    good = (_sums(~ok[codes], ends) == 0) & (np.diff(ends) > 0)
    links = Links(entries.column("links").combine_chunks() if entries.num_rows else pa.array([], pa.binary()), width)
    each = links.counts
    pairs, local = np.unique(links.pairs(), return_inverse=True)
    texts = links.texts()
    digests, listed = [], codes.tolist()
    for a, b, use in zip(ends.tolist(), ends[1:].tolist(), good.tolist(), strict=False):
        digests.append(hashlib.sha256(b";".join(map(texts.__getitem__, listed[a:b]))).hexdigest() if use else "")
    counts = _texts_with(np.where(good, np.diff(ends), 0), codes[np.repeat(good, np.diff(ends))], each, local, len(pairs))

    def part(kind: int, n: int, **columns: object) -> pa.Table:
        columns |= {"g": np.full(n, g), "kind": np.full(n, kind, np.int32), "place": np.arange(n, dtype=np.int32)}
        return pa.table({c: pa.array(columns[c], kinds[c]) if c in columns and not isinstance(columns[c], pa.ChunkedArray) else columns.get(c, pa.nulls(n, kinds[c])) for c in names})

    sums = {c: np.where(good, _sums(x[codes], ends), 0) for c, x in (("n_a", links.n_a), ("n_b", links.n_b), ("n_groups", links.n_groups), ("n_links", each))}
    table_of = [np.concatenate([[len(each)], each, local]).astype("<u4").tobytes()]
    return pa.concat_tables([part(0, len(good), doc_id=rows.column("doc_id"), groups_sha256=digests, **sums), part(1, 1, codes=table_of), part(2, len(pairs), pair=pairs, texts=counts)])


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _finish(values: pa.Table, rows: pa.Table) -> pa.Table:
    """The group's texts with the sums over their links."""
    values, rows = values.sort_by("place").combine_chunks(), rows.combine_chunks()
    of = lambda kind: rows.filter(pc.equal(rows.column("kind"), kind)).sort_by("place").combine_chunks()
    table_of, coded_rows, rows = np.frombuffer(of(1).column("codes")[0].as_py(), "<u4").astype(np.int64), of(3), of(0)
    size = table_of[0]
    each, local = table_of[1 : size + 1], table_of[size + 1 :]
    bounds = np.cumsum([0, *each])
    codes, ends = _unpacked(coded_rows.column("codes").to_pylist())
    used = rows.column("n_a").combine_chunks().to_numpy(zero_copy_only=False) > 0
    out = {c: rows.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    for name, column in (("n_best", "best"), ("count_sum", "texts")):
        of_pair = values.column(column).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
        out[name] = pa.array(np.where(used, _sums(_sums(of_pair[local], bounds)[codes], ends), 0))
    return pa.table(out | {"groups_sha256": rows.column("groups_sha256")})


def _again(df: DataFrame) -> DataFrame:
    """A second reading of a table, for a join with itself."""
    return df.sparkSession.read.schema(df.schema).parquet(df.scratch_path)


def link_sums(docs: DataFrame, first: str | None = None, second: str | None = None, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """For each (doc_id, text): numbers of tokens, groups and links, sums over its links, digest of the groups."""
    first, second = first or default_tokenizer(), second or default_pieces()
    # Shuffle files go as soon as a stage's table is there, so that they don't lie beside those of the next stage.
    with settings(docs.sparkSession, clean_up="true"):
        return _link_sums(docs, first, second, group_bytes)


def _link_sums(docs: DataFrame, first: str, second: str, group_bytes: int) -> DataFrame:
    both = Tokenizers(first, second)
    whole = not both.cuts_hold
    groups = materialize(coded(docs, None if whole else both.cut_table, group_bytes), "align-coded")
    entries = groups.filter("kind = 1").select("g", "place", "segment")
    tokens = materialize(tokenized(entries.select("segment").distinct(), first, second, whole).withColumn("key", F.monotonically_increasing_id()), "align-tokens")
    width = 2 if max(map(len, both.sizes)) <= 1 << 16 else 4
    known = aligned(tokens, width)
    discard(tokens)
    found = entries.join(known, "segment").select("g", "place", "ok", "links")
    texts = _again(groups).filter("kind = 0").select("g", "place", "doc_id", "codes")
    counted = materialize(found.groupBy("g").cogroup(texts.groupBy("g")).applyInArrow(lambda have, rows: _count(have, rows, width), _COUNTED), "align-counted")
    discard(known)
    rows = counted.filter("kind = 2").select("g", "place", "pair", "texts")
    totals = rows.groupBy("pair").agg(F.sum("texts").alias("texts")).withColumn("a", F.shiftright("pair", 32))
    most = totals.groupBy("a").agg(F.max("texts").alias("most"))
    totals = materialize(totals.join(most, "a").select("pair", "texts", (F.col("texts") == F.col("most")).cast("int").alias("best")), "align-pairs")
    values = rows.select("g", "place", "pair").join(totals, "pair").select("g", "place", "texts", "best")
    texts = _again(groups).filter("kind = 0").select("g", F.lit(3).alias("kind"), "place", "codes")
    texts = _again(counted).filter("kind < 2").select("g", "kind", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes").unionByName(texts, allowMissingColumns=True)
    return values.groupBy("g").cogroup(texts.groupBy("g")).applyInArrow(_finish, _RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: alignment of the byte-level and the piece tokenizer over all documents."""
    return link_sums(table(spark, sf_dir, "documents").select("doc_id", "text"))
