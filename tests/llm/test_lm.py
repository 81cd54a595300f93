import math
import zlib
from collections import Counter

import numpy as np

from linkweave.llm import lm

TEXTS = [None, "", "The the THE", "É é a\x0bb\x1cc", "x", "x"] + [f"the cat number {i} sat on mat {i % 7} . and then it was" for i in range(60)]


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def write(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, score string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_base_score_equals_brute_force_and_model_is_better(spark, tmp_path):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "an unknown id", None)]
    train = Counter(w for i, t, _ in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens(t))
    n, v = sum(train.values()), len(train)
    got = lm.query(spark, write(spark, tmp_path, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        mine = tokens(TEXTS[r.doc_id] if r.doc_id is not None else "an unknown id")
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(mine), sum(w in train for w in mine), n)
        assert math.isclose(r.base_score, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in mine), rel_tol=1e-9)


def test_model_is_better_than_counts_on_held_out_documents(spark):
    got = [r for r in lm.query(spark, "/root/testdata/sf0.001").collect() if r.held_out]
    assert got and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_small_head_gives_the_same_counts(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    counts = lm.count_words(docs)
    results = []
    for head in (5, 1000):
        v = lm.vocabulary(counts, head)
        p = lm.Parameters.start(lm.unigram(v))
        results.append({r.doc_id: (r.n_known, round(r.base_score, 9)) for r in lm.score(docs, counts, v, p).collect()})
    assert results[0] == results[1]


def test_probabilities_of_a_context_sum_to_one(spark):
    docs = spark.createDataFrame([(0, "a b c a b zz yy xx"), (1, "a c b q")], "doc_id long, text string")
    counts = lm.count_words(docs)
    v = lm.vocabulary(counts)
    p = lm.Parameters.start(lm.unigram(v))
    log = p.log_normaliser()
    for before, further in ((lm.START, lm.START), (0, 3), (lm.OWN, 1)):
        scores = (p.near[before] + p.far[further]) @ p.out.T + p.bias - log[before, further]
        assert abs(np.exp(scores.astype(float)).sum() - 1) < 1e-4
    for c in range(lm.OWN, lm.CLASSES):
        mine = [n for w, n in ((r.word, r.n) for r in counts.collect()) if bytes(w) not in v.words[: lm.OWN] and w and lm.ending(bytes(w)) == c]
        assert sum((n + 1) for n in mine) + 1 == v.class_tokens[c] + v.class_words[c] + 1


def test_empty_table(spark, tmp_path):
    assert lm.query(spark, write(spark, tmp_path, [])).collect() == []


def fitted(docs):
    counts = lm.count_words(docs)
    v = lm.vocabulary(counts)
    part = lm.F.coalesce(lm.F.expr("crc32(cast(cast(doc_id as string) as binary)) div 7"), lm.F.lit(0))
    return counts, v, lm.train(docs, v, part)


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    learnt = [fitted(docs.repartition(n, "text"))[2].flat() for n in (1, 64)]
    assert np.array_equal(*learnt)


def test_score_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)
    counts, v, p = fitted(docs)
    held = {bytes(r.word): r.n for r in counts.collect()}
    kinds = {w: k for k, w in enumerate(v.words[: lm.OWN])}
    of = lambda w: kinds.get(w, lm.ending(w) if w else lm.OWN)
    for r in lm.score(docs, counts, v, p).collect():
        before = further = lm.START
        total = 0.0
        for w in tokens(TEXTS[r.doc_id]):
            scores = ((p.near[before] + p.far[further]) @ p.out.T + p.bias).astype(np.float64)
            c = of(w)
            total += (scores[c] - np.log(np.exp(scores).sum())) / np.log(10)
            if w not in kinds:
                mine = [n for x, n in held.items() if x not in kinds and of(x) == c]
                total += math.log10((held.get(w, 0) + 1) / (sum(mine) + len(mine) + 1))
            before, further = c, before
        assert math.isclose(r.score, total, rel_tol=1e-4, abs_tol=1e-4)
