import struct
import zlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkweave.llm import bpe, records

ROWS = [(7, "seven words"), (3, None), (5, ""), (3, "again three"), (3, "again three"), (None, "no id"), (11, "long text " * 3000), (-4, "negative\nline")]


def expected(rows):
    lib = Tokenizer.from_file(bpe.default_tokenizer())
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    out, start = [], 0
    for k, text in ordered:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((k, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def write(spark, path, rows, **options):
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, start string")
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_query_equals_brute_force(spark, tmp_path):
    got = records.query(spark, write(spark, tmp_path, ROWS)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(ROWS)


def test_empty_table(spark, tmp_path):
    assert records.query(spark, write(spark, tmp_path, [])).collect() == []


def test_round_trip_index_and_shuffled_read(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text number {i} " * (i % 7)) for i in range(300)], "doc_id long, text string")
    path = f"file://{tmp_path}/records"
    records.write_records(df, path)
    everything = {r.doc_id: r.ids_le for r in records.scan(spark, path, "ids").collect()}
    assert everything == {r.doc_id: r.ids_le for r in bpe.encode(df, end_id=2).collect()}
    shuffled = records.read_shuffled(spark, path, seed=5).collect()
    assert {r.doc_id: r.ids_le for r in shuffled} == everything
    assert [r.doc_id for r in shuffled] != sorted(everything) and [r.doc_id for r in shuffled] == [r.doc_id for r in records.read_shuffled(spark, path, seed=5).collect()]
    some = records.read_index(spark, path).filter(F.col("doc_id") % 50 == 0)
    assert {r.doc_id for r in records.read_at(spark, path, some).collect()} == {0, 50, 100, 150, 200, 250}
    decoded = bpe.decode(records.read_at(spark, path, some).withColumn("ids_le", F.expr("substring(ids_le, 1, octet_length(ids_le) - 4)")))
    assert all(r.decoded == f"text number {r.doc_id} " * (r.doc_id % 7) for r in decoded.collect())


def test_wide_ids_and_damage():
    import numpy as np

    for ids in ([], [1, 65535], [70000, 3]):
        payload = records.pack(9, np.array(ids, "<u4"))
        data = records.frame(payload) + b"\n"
        back, end = records.unframe(data, 0)
        assert end == len(data) and records.unpack(back)[0] == 9 and records.unpack(back)[1].tolist() == ids
        for k in range(len(data)):
            broken = bytearray(data)
            broken[k] ^= 1
            with pytest.raises((ValueError, struct.error)):
                records.unframe(bytes(broken), 0)


def test_words_met_before_are_not_encoded_again():
    """150,000 distinct words, twice: the table that the operator asks for keeps them all."""
    table, asked = bpe.WordTable(bpe.default_tokenizer(), records.TABLE_WORDS), []
    table.encode_word = lambda word: asked.append(word) or [1]
    for _ in range(2):
        for first in range(0, 150_000, 15_000):
            table.slots_of([f"w{k}" for k in range(first, first + 15_000)])
    assert len(asked) == 150_000
