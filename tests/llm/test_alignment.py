"""Operator 12 against brute force over whole texts with the libraries' own encoders."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from linkweave.llm import alignment, bpe

TEXTS = [
    None, "", " ", "   ", "a", "the cat", " the  cat ", "a\nb", "a\n\nb", "\na", "a\n", "a \n b", "a\t b", "a \tb\t\tc", "x\r\n y\r\nz", "naïve café", "日本語 テスト　全角", "emoji 👩‍👩‍👧 x", "a▁b", "<|endoftext|> <s> </s> <unk> <0x0A>",
    "it's we're I'll 1234567 3.14", "\x00 nul\x00", "a b  c\x85d", "don't stop\n\n\n  indented\n\tcode", "same", "same", "ab" * 3000 + " " + "word " * 500 + "$$$ &&& ***", "\x1c\x1d a",
]


def brute(texts):
    """Rows of the contract, straight from its words."""
    first = Tokenizer.from_file(bpe.default_tokenizer())
    first.encode_special_tokens = True
    pieces = bpe.piece_table(bpe.default_tokenizer())
    second = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def piece(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()

    done = []
    for text in texts:
        a = [(i, pieces[i]) for i in first.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(i, piece(i)) for i in second.encode(text or "")]
        if not text or b"".join(x for _, x in a) != (" " + text).encode() or b"".join(x for _, x in b) != (" " + text).encode():
            done.append(None)
            continue
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, links, start = [], [], 0
        ends = [{e: k for k, (*_, e) in enumerate(s)} for s in spans]
        here = [0, 0]
        for cut in cuts:
            parts = [s[h : e[cut] + 1] for s, h, e in zip(spans, here, ends, strict=True)]
            here = [e[cut] + 1 for e in ends]
            groups.append("|".join(",".join(str(i) for i, *_ in p) for p in parts))
            links += [(x[0], y[0]) for x in parts[0] for y in parts[1] if x[1] < y[2] and y[1] < x[2]]
            start = cut
        assert start == len((" " + text).encode())
        done.append((len(a), len(b), groups, links))
    counts = Counter(p for d in done if d for p in set(d[3]))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(n, most.get(a, 0))
    out = []
    for d in done:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = d
            out.append((n_a, n_b, len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("group_bytes", [1 << 24, 60])
def test_awkward_texts(spark, group_bytes):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, segment string")
    got = {r.doc_id: tuple(r)[1:] for r in alignment.link_sums(df, group_bytes=group_bytes).collect()}
    assert [got[i] for i in range(len(TEXTS))] == brute(TEXTS)


def test_whole_texts_as_segments_give_the_same(spark, monkeypatch):
    texts = [t for t in TEXTS if t is None or len(t) < 100]
    original = alignment.Tokenizers.__init__

    def pessimist(self, *paths):
        original(self, *paths)
        self.cuts_hold = False

    monkeypatch.setattr(alignment.Tokenizers, "__init__", pessimist)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in alignment.link_sums(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_empty_table_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert alignment.link_sums(df.limit(0)).collect() == []
    got = [tuple(r) for r in alignment.link_sums(df).collect()]
    assert sorted(got, key=str) == sorted([(i, *r) for i, r in zip([1, 1, None], brute(["a b", "a b", None]), strict=True)], key=str)


def test_links_of_two_segmentations(spark):
    df = spark.sql("SELECT 7L key, array(named_struct('id', 1, 'size', 3), named_struct('id', 2, 'size', 1), named_struct('id', 3, 'size', 2)) a, array(named_struct('id', 8, 'size', 2), named_struct('id', 9, 'size', 2), named_struct('id', 8, 'size', 2)) b")
    got = alignment.align(df).select("group", "a_id", "b_id", "a_start", "a_end", "b_start", "b_end").orderBy("a_start", "b_start").collect()
    assert [tuple(r) for r in got] == [(0, 1, 8, 0, 3, 0, 2), (0, 1, 9, 0, 3, 2, 4), (0, 2, 9, 3, 4, 2, 4), (1, 3, 8, 4, 6, 4, 6)]


def test_joins_of_segments_need_one_shuffle_of_each_side(spark):
    df = spark.range(10).select(F.col("id").alias("key"), F.expr("array(named_struct('id', 1, 'size', 2))").alias("a"), F.expr("array(named_struct('id', 2, 'size', 2))").alias("b"))
    with alignment.co_partitioned(spark):
        plan = alignment.align(df.repartition(4, "key"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(key") == plan.count("REPARTITION_BY_NUM")


def test_query_equals_brute_force_on_a_whole_table(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: tuple(r)[1:] for r in alignment.query(spark, path).collect()}
    assert [got[d.doc_id] for d in docs] == brute([d.text for d in docs]) and len(got) == len(docs)
