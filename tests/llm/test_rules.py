import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkweave.llm import rules

LINE = "one two three four five six seven"
TEXTS = [None, "", " \n\t ", "a", "a b c d e", "a b c d e a b c d e", f"{LINE}\n{LINE}\n\n \n{LINE} x", "x " * 3000, "w " * 40 + "### $$ %", "b b b b b b", "é\x0bü\x0cñ\r| <b>", LINE, LINE, "a b c d e f g a b c d e f h " * 3, "nb\xa0sp ace"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_counts_equal_brute_force(spark):
    for r in rules.judge(frame(spark, TEXTS)).collect():
        base = brute(TEXTS[r.doc_id])
        assert tuple(r[c] for c in rules.BASE) == base, TEXTS[r.doc_id]
        assert r.base_failed == (base[0] < 10 or 100 * base[4] > 20 * base[0])
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)


def test_counts_on_generated_texts(spark):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.text(st.sampled_from("ab |\n\té"), max_size=60), min_size=1, max_size=40))
    def check(texts):
        for r in rules.measure(frame(spark, texts)).collect():
            assert tuple(r[c] for c in rules.BASE) == brute(texts[r.doc_id])

    check()


def test_expectation_maximisation_equals_numpy(spark):
    rng = np.random.default_rng(3)
    some = rules.RULES[:4]
    truth = rng.random(500) < 0.7
    right = rng.random((500, 4)) < [0.9, 0.8, 0.7, 0.95]
    votes = np.where(right, truth[:, None], ~truth[:, None]).astype(float)
    votes[rng.random((500, 4)) < 0.2] = np.nan
    rows = [tuple(None if np.isnan(v) else int(v) for v in row) for row in votes]
    got = rules.estimate(spark.createDataFrame(rows, ", ".join(f"{r.name} int" for r in some)), some, 10)
    prior, good, bad = 0.8, np.full(4, 0.8), np.full(4, 0.8)
    for _ in range(10):
        a = prior * np.prod(np.where(np.isnan(votes), 1, np.where(votes == 1, good, 1 - good)), 1)
        b = (1 - prior) * np.prod(np.where(np.isnan(votes), 1, np.where(votes == 0, bad, 1 - bad)), 1)
        p, cast = a / (a + b), ~np.isnan(votes)
        prior = np.clip(p.mean(), 0.01, 0.99)
        good = np.clip(((p[:, None] * (votes == 1)).sum(0) + 4) / ((p[:, None] * cast).sum(0) + 5), 0.5, 0.999)
        bad = np.clip((((1 - p)[:, None] * (votes == 0)).sum(0) + 4) / (((1 - p)[:, None] * cast).sum(0) + 5), 0.5, 0.999)
    assert np.allclose(got.prior, prior) and np.allclose(got.on_good, good) and np.allclose(got.on_bad, bad)
    assert ((p > 0.5) == truth).mean() > 0.85


def test_empty_table_and_clashing_names(spark):
    df = frame(spark, TEXTS).withColumn("kept", F.lit("x")).withColumn("symbols", F.lit(1)).withColumn("n_words", F.lit(None).cast("int"))
    (row,) = rules.judge(df.filter("doc_id = 5")).collect()
    assert row.n_words == 10 and row.kept is False
    assert rules.judge(df.limit(0)).collect() == []


def test_plan_is_native(spark):
    plan = rules.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_good_documents_are_kept(spark):
    path = "/root/testdata/sf0.01"
    got = rules.query(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    assert all(r.kept for r in got if r.quality == 1)
    assert sum(not r.kept for r in got if r.quality == 0) >= 0.9 * sum(r.quality == 0 for r in got)
