import random
import time

import numpy as np

from linkweave.llm import decontaminate
from linkweave.llm._text import TermHashes, shingles, weighted_jaccard

rng = random.Random(4)
VOCABULARY = [f"w{i}" for i in range(400)]
ITEMS = [(i, " ".join(rng.choices(VOCABULARY, k=rng.randint(14, 59)))) for i in range(30)] + [(30, "only four words here"), (31, "of of of of of of of of"), (32, None), (33, ""), (3, "another text under the id three that has words enough for it")]


def brute(text):
    hashes, out = TermHashes(), {}
    words = hashes.of(text)
    for item_id, item in ITEMS:
        w = hashes.of(item)
        if not len(w):
            continue
        width = min(5, len(w))
        for i in range(len(words) - len(w) + 1):
            s = weighted_jaccard(shingles(words[i : i + len(w)], width), shingles(w))
            if s >= decontaminate.THRESHOLD:
                out[item_id] = max(s, out.get(item_id, 0))
    return out


def texts():
    out = [None, "", "w1", "of " * 300]
    for k, (_, item) in enumerate(ITEMS):
        words = (item or "").split()
        before, after = rng.choices(VOCABULARY, k=k), rng.choices(VOCABULARY, k=40)
        out.append(" ".join([*before, *words, *after]))
        out.append(" ".join([*before, *(w.upper() + "," for w in words), *after, *words]))
        if len(words) > 30:
            near = list(words)
            near[0] = near[-1] = "changed"
            out.append(" ".join([*before, *near, *after]))
            middle = list(words)
            middle[15] = "changed"
            out.append(" ".join([*before, *middle, *after]))
    out.append(" ".join(rng.choices(VOCABULARY, k=900)))
    return out


def test_equals_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for item_bytes in (decontaminate.ITEM_BYTES, 1000):
        got = decontaminate.annotate(df, items, item_bytes=item_bytes).collect()
        assert len(got) == len(rows)
        for r in got:
            assert {m.item_id: round(m.similarity, 9) for m in r.matches} == {k: round(v, 9) for k, v in brute(rows[r.doc_id]).items()}


def test_blocks_find_all_within_the_radius():
    r = np.random.default_rng(1)
    for _ in range(2000):
        a = r.integers(0, 1 << 16, 4).astype(np.uint16)
        bits = np.unpackbits(a.view(np.uint8))
        flip = r.choice(64, r.integers(0, decontaminate.RADIUS + 1), replace=False)
        bits[flip] ^= 1
        b = np.packbits(bits).view(np.uint16)
        assert (decontaminate._POPCOUNT[a ^ b] <= decontaminate.RADIUS // decontaminate.BLOCKS).any()


def test_multi_index_finds_all_within_the_radius_and_no_others():
    r = np.random.default_rng(3)
    for items in (1, 40, 60_000):  # the last: more block values than changes of a block
        prints = r.integers(0, 1 << 16, (items, 4)).astype(np.uint16)
        bits = np.unpackbits(prints[r.integers(0, items, 12)].view(np.uint8), axis=1)
        bits ^= r.random(bits.shape) < r.random((12, 1)) * 0.4
        asked = np.packbits(bits, axis=1).view(np.uint16)
        want = {(i, j) for i in range(12) for j in np.flatnonzero(decontaminate._POPCOUNT[asked[i] ^ prints].sum(1) <= decontaminate.RADIUS).tolist()}
        row, member = decontaminate.MultiIndex(prints).within(asked)
        assert set(zip(row.tolist(), member.tolist(), strict=True)) == want and len(row) == len(want)


def test_time_does_not_follow_the_number_of_items():
    text = TermHashes().of(" ".join(rng.choices(VOCABULARY, k=1200)))
    own = (0, " ".join(rng.choices(VOCABULARY, k=30)))
    few = decontaminate.Index([own, *((k, " ".join(rng.choices(VOCABULARY, k=30))) for k in range(1, 100))])
    many = decontaminate.Index([own, *((k, " ".join(rng.choices(VOCABULARY, k=30))) for k in range(1, 5000))])
    took = []
    for index in (few, many):
        start = time.process_time()
        for _ in range(5):
            assert index.scan(text) == []
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0] + 1


def test_very_long_text():
    hashes = TermHashes()
    words = [*rng.choices(VOCABULARY, k=300_000), *ITEMS[7][1].split(), *rng.choices(VOCABULARY, k=5000)]
    [found] = [m for m in decontaminate.Index([(k, t) for k, t in ITEMS if t]).scan(hashes.of(" ".join(words))) if m["item_id"] == 7]
    assert found["similarity"] == 1.0 and found["start_word"] == 300_000


def test_empty_tables_and_clashing_name(spark):
    df = spark.createDataFrame([(1, ITEMS[0][1], 5), (1, ITEMS[0][1], None)], "doc_id long, text string, matches int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert [[m.item_id for m in r.matches] for r in decontaminate.annotate(df, items).collect()] == [[0], [0]]
    assert [r.matches for r in decontaminate.annotate(df, items.limit(0)).collect()] == [[], []]
    assert decontaminate.annotate(df.limit(0), items).collect() == []


def test_query_on_generated_documents(spark):
    path = "/root/testdata/sf0.01"
    items = spark.read.parquet(f"{path}/benchmark.parquet").collect()
    want = {(d.doc_id, i.item_id) for d in spark.read.parquet(f"{path}/documents.parquet").collect() for i in items if i.text in (d.text or "")}
    got = {(r.doc_id, r.item_id) for r in decontaminate.query(spark, path).collect()}
    assert want and got >= want and len(got) <= len(want) + 5


def test_texts_shorter_than_an_item():
    words = [f"s{i}" for i in range(30)]
    index, hashes = decontaminate.Index([(1, " ".join(words))]), TermHashes()
    [found] = index.scan(hashes.of(" ".join(words[:-2])))
    assert found == {"item_id": 1, "similarity": 24 / 26, "start_word": 0, "n_words": 28}
    for a in range(8):
        for b in range(23, 31):
            text = hashes.of(" ".join(words[a:b]))
            similarity = weighted_jaccard(shingles(text), shingles(hashes.of(" ".join(words))))
            want = [(1, similarity)] if similarity >= decontaminate.THRESHOLD else []
            assert [(m["item_id"], m["similarity"]) for m in index.scan(text)] == want
    assert index.scan(hashes.of("s0 s1 s2")) == [] == index.scan(hashes.of(""))


def test_repeated_shingles_beyond_the_radius():
    """One shingle of count 5 replaced by another: similarity 0.8, but often more than 20 bits apart."""
    hashes, far = TermHashes(), 0
    for k in range(60):
        common = [f"r{k}x{i}" for i in range(76)]
        item, text = ([*common, *[f"{word}{k}"] * 9] for word in ("left", "right"))
        a, b = shingles(hashes.of(" ".join(item))), shingles(hashes.of(" ".join(text)))
        assert weighted_jaccard(a, b) == 0.8
        prints = decontaminate._fingerprints(np.stack([decontaminate._signs(x).sum(0) for x in (a, b)]))
        far += int(decontaminate._POPCOUNT[prints[0] ^ prints[1]].sum()) > decontaminate.RADIUS
        assert [m["similarity"] for m in decontaminate.Index([(k, " ".join(item))]).scan(hashes.of(" ".join(text)))] == [0.8]
    assert far
