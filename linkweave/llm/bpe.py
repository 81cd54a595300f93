"""Operator 1: BPE encoding and decoding through a distinct-word table.

Spark splits every text into words with the tokenizer's own pre-tokenisation pattern.  Each Python
worker keeps a distinct-word table.  The tokenizer's model encodes a word when the table doesn't hold it; the ids
of all words of a text are then joined back by position (gathers over an Arrow dictionary's indices).  Decoding joins ids with the id-to-piece table, whose
size is the vocabulary's, and puts the pieces' bytes together.

That table belongs to a worker, not to the cluster.  A table of the whole corpus has to be joined with every word occurrence, which
moves more bytes than the documents have (README: figures); the worker's table gives the same ids, needs no shuffle, has a
bounded size and is rebuilt when an executor is lost.  ``encode_by_table`` and ``decode_by_table`` are the form with cluster-wide tables: each distinct
word of the corpus is encoded once, occurrences are joined with the table and put back by position, and ids are joined with the piece table.

Defined results: null text counts as empty (no ids, empty decoded text); repeated rows and ids are
encoded one by one; an empty table gives an empty table; further columns are carried along, but a
column that has the name of an output column is replaced.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.llm._text import by_bytes, by_length, held
from linkweave.session import materialize, table

#: Words in a worker's table, and characters of them; beyond either, the half that was met most often stays.
TABLE_WORDS, TABLE_CHARS = 100_000, 3 << 20

#: Pre-tokenisation pattern of the byte-level vocabulary (fixed value), for Java's regex with Unicode classes.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def special_ids(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}


def split_words(text: Column, specials: list[str]) -> Column:
    """array<string> of the pre-tokenised words; special tokens in the text are words of their own."""
    import re

    java_quote = [re.sub(r"([^\w])", r"\\\1", s) for s in specials]
    text = F.coalesce(text, F.lit(""))
    words = lambda s: F.regexp_extract_all(s, F.lit(PATTERN), F.lit(0))
    if not java_quote:
        return words(text)
    # A NUL-free marker is not needed: the parts between specials and the specials themselves alternate.
    either = "|".join(sorted(java_quote, key=len, reverse=True))
    parts = F.split(text, either, -1)
    found = F.regexp_extract_all(text, F.lit(f"({either})"), F.lit(1))
    with_specials = F.flatten(F.transform(parts, lambda s, i: F.concat(F.when(i > 0, F.array(F.element_at(found, i))).otherwise(F.array().cast("array<string>")), words(s))))
    return F.when(F.size(parts) == 1, words(text)).otherwise(with_specials)


class WordTable:
    """Distinct words: their ids, one after the other, and where each word's begin.

    A Python worker keeps it from task to task of a stage.  When it is full, the half of the words that was met most often stays."""

    def __init__(self, path: str, most: int):
        self.path = path
        self.alphabet = str.maketrans({b: c for c, b in byte_alphabet().items()})
        self.special = special_ids(path)
        self.most = most
        self.slots: dict[str, int] = {}
        self.chars = 0
        self.ids = np.empty(1 << 16, np.uint32)
        self.offsets = np.zeros(1 << 14, np.int64)
        self.met = np.zeros(1 << 14, np.int64)

    @functools.cached_property
    def model(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path).model

    @functools.cached_property
    def pieces(self) -> pa.Array:
        """The id-to-piece table."""
        return pa.array(piece_table(self.path), pa.large_binary())

    def encode_word(self, word: str) -> list[int]:
        """The merges of one pre-tokenised word by the tokenizer's own model."""
        if word in self.special:
            return [self.special[word]]
        return [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.alphabet))]

    def _shrink(self) -> None:
        words = list(self.slots)
        ordered = np.argsort(-self.met[: len(words)], kind="stable")[: self.most // 2]
        sizes = np.cumsum([len(words[k]) for k in ordered.tolist()])
        stay = np.sort(ordered[sizes <= TABLE_CHARS // 2])
        self.chars = int(sizes[len(stay) - 1]) if len(stay) else 0
        lengths = self.offsets[stay + 1] - self.offsets[stay]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        self.ids = self.ids[np.repeat(self.offsets[stay] - (ends - lengths), lengths) + np.arange(total)]
        self.offsets[1 : len(stay) + 1] = ends
        self.met[: len(stay)] = self.met[stay]
        self.met[len(stay) :] = 0
        self.slots = {words[k]: i for i, k in enumerate(stay.tolist())}

    def slots_of(self, words: list[str]) -> np.ndarray:
        if len(self.slots) > self.most or self.chars > TABLE_CHARS:
            self._shrink()
        get = self.slots.get
        out = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            first = len(self.slots)
            new = [words[k] for k in missing.tolist()]
            self.chars += sum(map(len, new))
            encoded = [self.encode_word(w) for w in new]
            lengths = np.fromiter(map(len, encoded), np.int64, len(new))
            begin, end = self.offsets[first], self.offsets[first] + lengths.sum()
            if end > len(self.ids):
                self.ids = np.concatenate([self.ids[:begin], np.empty(max(end, 2 * len(self.ids)) - begin, np.uint32)])
            if first + len(new) >= len(self.offsets):
                more = max(2 * len(self.offsets), first + len(new) + 1)
                self.offsets = np.concatenate([self.offsets[: first + 1], np.zeros(more - first - 1, np.int64)])
                self.met = np.concatenate([self.met, np.zeros(more - len(self.met), np.int64)])
            self.ids[begin:end] = np.fromiter(chain.from_iterable(encoded), np.uint32, end - begin)
            self.offsets[first + 1 : first + 1 + len(new)] = begin + np.cumsum(lengths)
            out[missing] = np.arange(first, first + len(new))
            self.slots.update(zip(new, range(first, first + len(new)), strict=True))
        return out

    def join(self, words: pa.ListArray) -> list[np.ndarray]:
        """Ids of each row's words, joined back by position."""
        encoded = words.flatten().dictionary_encode()
        indices = encoded.indices.to_numpy(zero_copy_only=False)
        known = self.slots_of(encoded.dictionary.to_numpy(zero_copy_only=False).tolist())  # to_pylist goes over an Arrow scalar for each word
        self.met[known] += np.bincount(indices, minlength=len(known))
        slots = known[indices]
        lengths = self.offsets[slots + 1] - self.offsets[slots]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.offsets[slots] - (ends - lengths), lengths) + np.arange(total)]
        word_ends = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))
        token_ends = np.concatenate([[0], ends])[word_ends]
        return np.split(ids, token_ends[:-1]) if len(token_ends) else []


def word_table(path: str, most: int = TABLE_WORDS) -> WordTable:
    """The worker's table."""
    return held(("bpe", path, most), lambda: WordTable(path, most))


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on, in order."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _with_columns(batch: pa.RecordBatch, drop: set[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [c for c in batch.schema.names if c not in drop and c not in new]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new.values()], names=[*kept, *new])


def _schema(df: DataFrame, drop: set[str], new: list[T.StructField]) -> T.StructType:
    names = {f.name for f in new}
    return T.StructType([f for f in df.schema.fields if f.name not in drop and f.name not in names] + new)


def encode_into(df: DataFrame, fields: list[T.StructField], finish: Callable[[pa.RecordBatch, list[np.ndarray]], dict[str, pa.Array]], text: str = "text", tokenizer: str | None = None, keep_text: bool = True, table_words: int = TABLE_WORDS) -> DataFrame:
    """Adds ``fields``, which ``finish`` makes from rows and their ids."""
    path = tokenizer or default_tokenizer()
    words = "__words"
    source = df.withColumn(words, split_words(F.col(text), list(special_ids(path))))
    drop = {words}
    if not keep_text:
        source = source.drop(text)
        drop.add(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_table(path, table_words)
        for whole in batches:
            for batch in by_length(whole, words):
                yield _with_columns(batch, drop, finish(batch, known.join(batch.column(words))))

    return source.mapInArrow(run, _schema(df, drop, fields))


def encode(df: DataFrame, text: str = "text", out: str = "ids_le", tokenizer: str | None = None, end_id: int | None = None, keep_text: bool = True, table_words: int = TABLE_WORDS) -> DataFrame:
    """Adds ``out``: the ids as little-endian unsigned 32-bit integers, in one binary value.

    ``ids_array`` turns that column into array<int>.  ``end_id`` is appended to every text when given.
    """
    end = np.array([] if end_id is None else [end_id], "<u4").tobytes()

    def finish(_: pa.RecordBatch, ids: list[np.ndarray]) -> dict[str, pa.Array]:
        return {out: pa.array([x.astype("<u4").tobytes() + end for x in ids], pa.binary())}

    return encode_into(df, [T.StructField(out, T.BinaryType())], finish, text, tokenizer, keep_text, table_words)


def ids_array(ids: Column) -> Column:
    """array<int> from the binary form of ids (for ids below 2**31)."""
    parts = F.regexp_extract_all(F.hex(ids), F.lit("(..)(..)(..)(..)"), F.lit(0))
    byte = lambda x, k: F.substring(x, 2 * k + 1, 2)
    return F.transform(parts, lambda x: F.conv(F.concat(byte(x, 3), byte(x, 2), byte(x, 1), byte(x, 0)), 16, 10).cast("int"))


def piece_table(path: str) -> list[bytes]:
    """Bytes of every id."""
    back = byte_alphabet()
    with open(path, encoding="utf-8") as f:
        saved = json.load(f)
    pieces = [b""] * (1 + max([*saved["model"]["vocab"].values(), *(t["id"] for t in saved.get("added_tokens", []))]))
    for piece, i in saved["model"]["vocab"].items():
        pieces[i] = bytes(back[c] for c in piece)
    for t in saved.get("added_tokens", []):
        pieces[t["id"]] = t["content"].encode()
    return pieces


def decode(df: DataFrame, ids: str = "ids_le", out: str = "decoded", tokenizer: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Adds ``out``: the text of the ids, special tokens included; bytes that aren't UTF-8 become U+FFFD.

    The join with the piece table is a gather, as the ids are its row numbers."""
    path = tokenizer or default_tokenizer()
    drop = set() if keep_ids else {ids}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = word_table(path).pieces  # of the same table, as workers change between encoding and decoding
        for whole in batches:
            for batch in by_bytes(whole, ids):
                rows = [np.frombuffer(x or b"", "<u4") for x in batch.column(ids).to_pylist()]
                ends = np.cumsum([0, *map(len, rows)])
                found = pieces.take(pa.array(np.concatenate(rows)))
                joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), found), pa.scalar(b"", pa.large_binary()))
                try:
                    texts = joined.cast(pa.large_string()).cast(pa.string())
                except pa.ArrowInvalid:
                    texts = pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())
                yield _with_columns(batch, drop, {out: texts})

    return df.mapInArrow(run, _schema(df, drop, [T.StructField(out, T.StringType())]))


def encode_by_table(df: DataFrame, text: str = "text", out: str = "ids_le", tokenizer: str | None = None) -> DataFrame:
    """``encode`` with one distinct-word table for the corpus: the occurrences of its words are joined with it and put back by position."""
    path = tokenizer or default_tokenizer()
    kept = [c for c in df.columns if c != out]
    rows = materialize(df.select(*kept).withColumns({"__words": split_words(F.col(text), list(special_ids(path))), "__row": F.monotonically_increasing_id()}), "bpe-words")
    placed = rows.select("__row", F.posexplode("__words").alias("at", "word"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of = WordTable(path, 0)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array([table_of.encode_word(w) for w in batch.column("word").to_pylist()], pa.list_(pa.int64()))], names=["word", "ids"])

    encoded = placed.select("word").distinct().mapInArrow(run, "word string, ids array<bigint>")
    joined = placed.join(encoded, "word").groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("__placed"))
    little = lambda i: F.unhex(F.regexp_replace(F.lpad(F.hex(i), 8, "0"), "(..)(..)(..)(..)", "$4$3$2$1"))
    ids = F.transform(F.flatten(F.transform("__placed", lambda x: x["ids"])), little)
    put = F.coalesce(F.aggregate(ids, F.lit("").cast("binary"), lambda a, x: F.concat(a, x)), F.lit("").cast("binary"))
    return rows.join(joined, "__row", "left").select(*kept, put.alias(out))


def decode_by_table(df: DataFrame, ids: str = "ids_le", out: str = "decoded", tokenizer: str | None = None) -> DataFrame:
    """``decode`` of a table with unique ``doc_id`` by a join of the ids with the id-to-piece table."""
    spark = df.sparkSession
    pieces = spark.createDataFrame(enumerate(piece_table(tokenizer or default_tokenizer())), "id int, piece binary")
    placed = df.select("doc_id", F.posexplode(ids_array(F.col(ids))).alias("at", "id"))
    texts = placed.join(pieces, "id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("__placed"))
    text = F.coalesce(F.aggregate("__placed", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["piece"])), F.lit("").cast("binary"))
    return df.join(texts, "doc_id", "left").select(*(c for c in df.columns if c != out), text.cast("string").alias(out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: digests of ids and of decoded text for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode(encode(docs, keep_text=False))
    return both.select(
        "doc_id",
        F.expr("octet_length(ids_le) div 4").cast("long").alias("n_tokens"),
        F.sha2(F.col("ids_le"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
