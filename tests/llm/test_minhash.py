import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from linkweave.llm import minhash

rng = random.Random(5)
WORDS = [f"w{i}" for i in range(3000)]


def edited(words, changes):
    out = list(words)
    for k in rng.sample(range(len(out)), changes):
        out[k] = rng.choice(WORDS)
    return out


def corpus():
    """Copies, near copies of one hub that are far from each other, chains, a repeated passage, clean texts, edge texts."""
    rows = []
    hub = rng.choices(WORDS, k=400)
    rows += [" ".join(edited(hub, 7)) for _ in range(25)] + [" ".join(hub)]
    chain = rng.choices(WORDS, k=300)
    for _ in range(6):
        rows.append(" ".join(chain))
        chain = edited(chain, 5)
    passage = rng.choices(WORDS, k=60)
    rows += [" ".join(rng.choices(WORDS, k=80) + passage) for _ in range(20)]
    rows += [" ".join(rng.choices(WORDS, k=rng.randint(1, 200))) for _ in range(60)]
    rows += ["x y " * 200, "x y " * 190, "x y " * 90, "", None, " ", "a b", "a b", "a  b", "one", "é", rows[0], rows[30], " ".join(WORDS * 5)]
    return rows


def bag(text):
    w = (text or "").encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a and b else 0.0


def brute(rows):
    bags, part = [bag(x) for x in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i] or "") == (rows[j] or "") or similarity(bags[i], bags[j]) >= minhash.THRESHOLD:
                part = [part[j] if p == part[i] else p for p in part]
    return {i: min(k for k in range(len(rows)) if part[k] == part[i]) for i in range(len(rows))}


def test_classes_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("key", F.lit("x")).repartition(3)
    assert {r.doc_id: r.class_id for r in minhash.classify(df).collect()} == brute(rows)


def test_signature_agrees_as_often_as_the_similarity():
    r = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        element = r.integers(0, 2**63, 50, dtype=np.uint64)
        a = r.integers(0, 9, 50)
        b = np.where(r.random(50) < 0.6, a, r.integers(0, 9, 50))
        i, j = np.flatnonzero(a), np.flatnonzero(b)
        s = minhash.signatures(np.repeat([0, 1], [len(i), len(j)]), np.concatenate([element[i], element[j]]), np.concatenate([a[i], b[j]]), 2)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.06


def test_signature_depends_on_the_text_alone():
    r = np.random.default_rng(2)
    element, weight = r.integers(0, 2**63, 80, dtype=np.uint64), r.integers(1, 30, 80)
    alone = minhash.signatures(np.zeros(80, int), element, weight, 1)
    many = minhash.signatures(np.repeat([0, 1, 2], [80, 3, 80]), np.concatenate([element, element[:3], element]), np.concatenate([weight, [1, 1, 1], weight]), 3)
    assert (alone[0] == many[0]).all() and (alone[0] == many[2]).all() and (minhash.signatures(np.zeros(0, int), element[:0], weight[:0], 2) == minhash._NEVER).all()


def test_keep_one_with_clashing_columns(spark):
    rows = [(2, "a b c d e f g h", "q", 1), (1, "a b c d e f g h", None, 2), (7, "other words in this text here", "z", 3)]
    names = "key class_id component hub a b bands sketch bucket text_key order n".split()
    df = spark.createDataFrame([(*r[:2], *[str(r[3])] * len(names)) for r in rows], ["doc_id", "text", *names])
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 7]


def test_blocks_of_mixed_buckets(spark, monkeypatch):
    """Small blocks: many cells; texts that share a long passage fall into common buckets without being near copies."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    passage = rng.choices(WORDS, k=150)
    rows = [" ".join(rng.choices(WORDS, k=60) + passage) for _ in range(40)] + [" ".join(edited(passage, 3)) for _ in range(15)] + [" ".join(edited(passage, k % 9)) for k in range(30)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.class_id for r in minhash.classify(df).collect()} == brute(rows)


def test_keep_one_keeps_columns_null_ids_repeated_rows(spark):
    rows = [(5, "a b c d e f g h", "q"), (3, "a b c d e f g h", None), (3, "a b c d e f g h", None), (None, "no id", "z"), (None, "no id", "z"), (9, None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket string")
    assert sorted(map(str, map(tuple, minhash.keep_one(df).collect()))) == sorted(map(str, [(3, "a b c d e f g h", None), (None, "no id", "z"), (9, None, "e")]))
    assert minhash.keep_one(df.limit(0)).collect() == [] and minhash.classify(df.limit(0)).collect() == []
