"""Operator 6: token ids as length-delimited binary records with masked checksums and an offset index.

File format.  A file is a run of records, each framed as

    u64 length | u32 masked CRC-32 of the length | payload | u32 masked CRC-32 of the payload | 0x0A

little-endian.  The first record of a file is its header: ``LWREC1`` and the file's number as u32.  The
payload of every other record is: u8 flags (1: the document has no id; 2: ids take four bytes instead
of two) | i64 document id | ids.  The mask rotates the checksum right by 15 bits and adds a constant, so
that the checksum of data that holds checksums stays sound.

Documents are dealt to files by ranges of their id and of the first characters of their text, and sorted by id and text, so the file numbers give the
global ascending order (null ids first; rows with one id by their text: even one id's rows can be dealt to several files).  Spark's own text writer puts
the raw bytes out (a record's last byte is the writer's line separator), hence its commit protocol holds and any
store works that Spark can write to.  The offset index is a separate parquet table with a row for each record:
file, number of the record, document id, offset, length and number of ids.  ``read_at`` reads
records through it in any order.

Defined results: null text has no ids but the end id; repeated rows are all written; an empty table gives
no records; columns besides id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.llm import bpe
from linkweave.session import scratch_path, table

#: Input bytes (as the scan counts them) for one output file.
BYTES_PER_FILE = 16 << 20
#: Id that ends every document.
END_ID = 2
#: Words in a worker's table.  With half as many, as ``bpe`` keeps for itself, 1.6 times as many words were encoded (6,000 documents, gone through twice).
TABLE_WORDS = 2 * bpe.TABLE_WORDS
#: Added to the rotated checksum (fixed value of this framing).
MASK_DELTA = 0xA282EAD8
MAGIC = b"LWREC1"
_HEAD = struct.Struct("<QI")
_FIXED = struct.Struct("<Bq")
RECORD = "file_no long, ordinal long, doc_id long, byte_offset long, byte_length long, n_tokens long"


def masked(data: bytes | memoryview) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A framed record without its last byte 0x0A, which the writer adds."""
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes | memoryview, at: int) -> tuple[memoryview, int]:
    """The payload of the record at offset ``at`` and the offset after it; both checksums are verified."""
    view = memoryview(data)
    length, crc = _HEAD.unpack_from(view, at)
    if masked(view[at : at + 8]) != crc:
        raise ValueError(f"record at {at}: its length is damaged")
    start = at + _HEAD.size
    payload, (crc,) = view[start : start + length], struct.unpack_from("<I", view, start + length)
    if masked(payload) != crc or view[start + length + 4] != 0x0A:
        raise ValueError(f"record at {at}: its data are damaged")
    return payload, start + length + 5


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return _FIXED.pack((doc_id is None) + 2 * wide, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack(payload: memoryview) -> tuple[int | None, np.ndarray]:
    flags, doc_id = _FIXED.unpack_from(payload)
    return (None if flags & 1 else doc_id), np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=_FIXED.size)


def header_of(number: Column) -> Column:
    """The framed header, with its last byte, of the file whose number is given as eight hexadecimal digits.

    Its checksum is worked out in SQL, bit by bit as in ``masked``."""
    little = F.unhex(F.concat(*(F.substring(number, k, 2) for k in (7, 5, 3, 1))))
    payload = F.concat(F.lit(MAGIC), little)
    crc = F.crc32(payload)
    mask = F.shiftright(crc, 15).bitwiseOR(F.shiftleft(crc, 17)).bitwiseAND(0xFFFFFFFF) + F.lit(MASK_DELTA)
    crc_hex = F.lpad(F.hex(mask.bitwiseAND(0xFFFFFFFF)), 8, "0")
    length = struct.pack("<Q", len(MAGIC) + 4)
    return F.concat(F.lit(length + struct.pack("<I", masked(length))), payload, F.unhex(F.concat(*(F.substring(crc_hex, k, 2) for k in (7, 5, 3, 1)))), F.lit(b"\n"))


def file_count(df: DataFrame, bytes_per_file: int) -> int:
    """Grows with the input: its size by the plan's statistics, and Spark's shuffle partitions at least."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    floor = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(floor, -(-size // bytes_per_file)) if size < 1 << 60 else floor


def write_records(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int | None = END_ID, bytes_per_file: int = BYTES_PER_FILE) -> None:
    """Encode ``docs`` and write record files to ``path/data`` and the offset index to ``path/index``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = docs.repartitionByRange(file_count(docs, bytes_per_file), "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    end = np.array([] if end_id is None else [end_id], np.uint32)

    def finish(batch: pa.RecordBatch, ids: list[np.ndarray]) -> dict[str, pa.Array]:
        return {"record": pa.array([frame(pack(k, np.concatenate([x, end]))) for k, x in zip(batch.column("doc_id").to_pylist(), ids, strict=True)], pa.binary())}

    records = bpe.encode_into(ordered, [T.StructField("record", T.BinaryType())], finish, tokenizer=tokenizer, keep_text=False, table_words=TABLE_WORDS)
    # Only the first record of a partition follows a header; the partition's number is the file's.
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    number = F.lpad(F.hex(F.spark_partition_id()), 8, "0")
    records = records.select(F.when(first, F.concat(header_of(number), F.col("record"))).otherwise(F.col("record")).alias("record"))
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none").text(f"{path}/data")
    scan(spark, path, "index").drop("ids_crc32", "local_start").write.parquet(f"{path}/index")


def scan(spark: SparkSession, path: str, want: str = "digest") -> DataFrame:
    """Every record of the files at ``path``, verified: RECORD's columns with local_start (ids of the file before the record) and,
    as ``want`` says, ids_crc32 ('digest', else 0) or ids_le ('ids')."""
    extra = ", local_start long, " + ("ids_le binary" if want == "ids" else "ids_crc32 long")
    names = [c.split()[0] for c in (RECORD + extra).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_buffer()
                header, at = unframe(data, 0)
                if bytes(header[: len(MAGIC)]) != MAGIC:
                    raise ValueError("not a record file")
                (file_no,) = struct.unpack_from("<I", header, len(MAGIC))
                rows, ordinal, start = [], 0, 0
                while at < len(memoryview(data)):
                    payload, after = unframe(data, at)
                    doc_id, ids = unpack(payload)
                    last = {"digest": lambda i: zlib.crc32(i.astype("<u4").tobytes()), "ids": lambda i: i.astype("<u4").tobytes(), "index": lambda i: 0}[want](ids)
                    rows.append((file_no, ordinal, doc_id, at, after - at, len(ids), start, last))
                    ordinal, start, at = ordinal + 1, start + len(ids), after
                    if len(rows) == 2048:
                        yield _rows(rows, names, want)
                        rows = []
                if rows:
                    yield _rows(rows, names, want)

    files = spark.read.format("binaryFile").load(f"{path}/data").filter(F.col("length") > 0).select("content")
    return files.mapInArrow(run, RECORD + extra)


def _rows(rows: list[tuple], names: list[str], want: str) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.binary() if want == "ids" else pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).parquet(f"{path}/index")


def file_starts(index: DataFrame) -> DataFrame:
    """(file_no, file_start): ids in the files before.  Two levels of running sums, so that one task sees a row for
    1,024 files only."""
    totals = index.groupBy("file_no").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.expr("file_no div 1024"))
    blocks = totals.groupBy("block").agg(F.sum("n").alias("block_n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("block_n").over(before), F.lit(0)).alias("block_start"))
    inside = Window.partitionBy("block").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("inner_start", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return totals.join(blocks, "block").select("file_no", (F.col("block_start") + F.col("inner_start")).alias("file_start"))


def read_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The records that ``wanted`` (rows of the index, in any selection) points to: file_no, ordinal, doc_id, ids_le.

    Each file is opened once; its wanted offsets are at most as many as its records."""
    where = wanted.groupBy("file_no").agg(F.collect_list(F.struct("byte_offset", "ordinal")).alias("wanted"))
    files = spark.read.format("binaryFile").load(f"{path}/data").filter(F.col("length") > 0)
    # The header's number is at a fixed place: frame head 12 bytes, magic 6 bytes, u32.
    number = F.substring(F.col("content"), 19, 4)
    at = lambda k: F.conv(F.hex(F.substring(number, k, 1)), 16, 10).cast("long") * (256 ** (k - 1))
    files = files.select("content", (at(1) + at(2) + at(3) + at(4)).alias("file_no"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_no, content, offsets in zip(batch.column("file_no").to_pylist(), batch.column("content"), batch.column("wanted").to_pylist(), strict=True):
                data, rows = content.as_buffer(), []
                for x in sorted(offsets, key=lambda o: o["byte_offset"]):
                    doc_id, ids = unpack(unframe(data, x["byte_offset"])[0])
                    rows.append((file_no, x["ordinal"], doc_id, ids.astype("<u4").tobytes()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file_no", "ordinal", "doc_id", "ids_le"])

    return files.join(where, "file_no").select("file_no", "content", "wanted").mapInArrow(run, "file_no long, ordinal long, doc_id long, ids_le binary")


def read_shuffled(spark: SparkSession, path: str, seed: int = 0) -> DataFrame:
    """All records in a pseudo-random order that ``seed`` fixes."""
    order = F.xxhash64(F.lit(seed), "file_no", "ordinal")
    return read_at(spark, path, read_index(spark, path)).orderBy(order)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: write the files, then read them back: start, length and checksum of every document's ids."""
    path = scratch_path(spark, "records")
    write_records(table(spark, sf_dir, "documents"), path)
    return scan(spark, path).join(file_starts(read_index(spark, path)), "file_no").select("doc_id", (F.col("file_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
