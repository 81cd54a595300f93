import hashlib
import struct

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkweave.llm import bpe

TEXTS = ["", None, "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "it's  x\n\n y\t\t", "!!<|endoftext|>!!  ", "日本語 テスト　全角  x", "\x1c\x1d a\x85b\xa0c", "é̂ ñ ٣٤ ½ ²", "same", "same", "long word " * 5000]


def test_ids_and_text_equal_the_library(spark):
    lib = Tokenizer.from_file(bpe.default_tokenizer())
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    both = bpe.decode(bpe.encode(df)).withColumn("ids", bpe.ids_array(F.col("ids_le")))
    for row in both.collect():
        ids = lib.encode(TEXTS[row.doc_id] or "", add_special_tokens=False).ids
        assert row.ids == ids
        assert row.ids_le == struct.pack(f"<{len(ids)}I", *ids)
        assert row.decoded == lib.decode(ids, skip_special_tokens=False)
        assert row.text == TEXTS[row.doc_id]


def test_table_that_starts_anew_gives_the_same_ids(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    small = {r.doc_id: r.ids_le for r in bpe.encode(df, table_words=3).collect()}
    assert small == {r.doc_id: r.ids_le for r in bpe.encode(df).collect()}


def test_table_of_few_characters_gives_the_same_ids(spark, monkeypatch):
    table = bpe.WordTable(bpe.default_tokenizer(), 100)
    lib = Tokenizer.from_file(bpe.default_tokenizer())
    monkeypatch.setattr(bpe, "TABLE_CHARS", 30)
    for words in (["abc", "de" * 40], ["abc", "x"], ["y", "de" * 40, "abc"], [], ["z"]):
        import pyarrow as pa

        got = table.join(pa.array([words, words[:1]], pa.list_(pa.string())))
        assert [x.tolist() for x in got] == [[i for w in ws for i in lib.encode(w, add_special_tokens=False).ids] for ws in (words, words[:1])]


def test_cluster_wide_tables_give_the_same_ids_and_texts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    want = {r.doc_id: (r.ids_le, r.decoded) for r in bpe.decode(bpe.encode(df)).collect()}
    assert {r.doc_id: (r.ids_le, r.decoded) for r in bpe.decode_by_table(bpe.encode_by_table(df)).collect()} == want


def test_end_id_clashing_names_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x", b"old", None)], "doc_id long, text string, ids_le binary, lang string")
    got = bpe.encode(df, end_id=2).collect()[0]
    assert got.ids_le[-4:] == struct.pack("<I", 2) and got.lang is None
    assert bpe.decode(bpe.encode(df.limit(0))).collect() == []


def test_ids_without_a_text_become_replacement_characters(spark):
    lib = Tokenizer.from_file(bpe.default_tokenizer())
    broken = lib.encode("日", add_special_tokens=False).ids[:1]
    df = spark.createDataFrame([(1, struct.pack("<I", *broken)), (2, None)], "k long, ids_le binary")
    assert [r.decoded for r in bpe.decode(df).orderBy("k").collect()] == [lib.decode(broken, skip_special_tokens=False), ""]


def test_query_digests(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    lib = Tokenizer.from_file(bpe.default_tokenizer())
    rows = bpe.query(spark, str(tmp_path)).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        ids = lib.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
