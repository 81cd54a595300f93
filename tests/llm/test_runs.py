"""Operator 13 against brute force, on sequences, on awkward texts and on a whole table."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkweave.llm import runs


def brute(words):
    """Every period, every maximal stretch; of equal stretches the smallest period."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((a, b, q) for (a, b), q in out.items()), key=lambda r: (r[0], r[2]))


def numbers(words):
    return np.unique(np.array(words), return_inverse=True)[1].tolist() if len(words) else []


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(300):
        k = rnd.choice([1, 2, 2, 3, 4])
        s = [rnd.randrange(k) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            base = [rnd.randrange(k + 1) for _ in range(rnd.randint(1, 8))]
            at = rnd.randint(0, len(s))
            s[at:at] = base * rnd.randint(3, 7) + base[: rnd.randint(0, len(base))]
        assert runs.runs_of(numbers(s)) == brute(s)
        assert runs.runs_of_texts([np.array(s[:5]), np.array(s), np.array(s)])[1:] == [brute(s)] * 2


@given(st.lists(st.integers(0, 2), max_size=80))
@settings(max_examples=200, deadline=None)
def test_any_sequence(s):
    assert runs.runs_of(numbers(s)) == brute(s)


def test_long_repetitive_texts_take_linear_time():
    for s in ([0] * 60_000, [i % 9_000 for i in range(60_000)], [bin(i).count("1") % 2 for i in range(60_000)]):
        start = time.time()
        found = runs.runs_of(s)
        assert time.time() - start < 10
        assert found == ([] if max(s) == 1 else [(0, 60_000, max(s) + 1)])


TEXTS = [None, "", " \n\t", "one", "a a a a a", "a a a a a a", "x\n" + "a b " * 4 + "a c", "a a " * 6, "ä ö\x0b" * 5, "a a a a a a", "w " * 3000 + "v " * 3000, " ".join(f"w{i}" for i in range(5000)) * 2]


def expected(doc_id, text, changed=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if changed and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute(words)
    dropped = {i for a, b, q in found for i in range(a + q, a + b)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    lines = "".join(f"{a},{b},{q}\n" for a, b, q in found)
    short = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, short)))


def test_awkward_texts_repeated_rows_and_clashing_names(spark):
    rows = [(i, t, "old") for i, t in enumerate(TEXTS)] + [(9, "a a a a a a", "old"), (None, "b b b b b b", "old")]
    got = runs.find(spark.createDataFrame(rows, "doc_id long, text string, runs string")).collect()
    assert len(got) == len(rows)
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        assert r.n_words == len(words) and [tuple(x) for x in r.runs] == brute(words)
    assert runs.find(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_on_awkward_texts(spark, tmp_path):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(60)] + [(None, "b b b b b b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in runs.query(spark, str(tmp_path)).collect()}
    assert {r for r in got if r[0] is not None} == {expected(*r) for r in rows[:-1]}
    assert any(r[1] for r in got if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0)


def test_query_equals_brute_force_on_a_whole_table(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in runs.query(spark, path).collect()}
    assert len(got) == len(docs)
    for d in docs:
        if len(d.text) < 20_000:
            assert got[d.doc_id] == expected(d.doc_id, d.text)


def test_strongest_prefers_ratio_then_start_then_period(spark):
    df = spark.sql("SELECT array(named_struct('start', 0L, 'length', 8L, 'period', 2L), named_struct('start', 3L, 'length', 9L, 'period', 2L), named_struct('start', 4L, 'length', 27L, 'period', 6L)) r")
    assert tuple(df.select(runs.strongest(F.col("r")).alias("b")).first().b) == (3, 9, 2)
