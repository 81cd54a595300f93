import numpy as np
from pyspark.sql import functions as F

from linkweave.llm import langid

EN = ["the cat sat on the mat", "this is the house that jack built", "where there is a will there is a way", "the weather is nice today"]
DE = ["der hund und die katze schlafen", "das ist ein schönes haus", "ich weiß nicht was soll es bedeuten", "heute ist das wetter schön"]


def brute_force(train, texts):
    """Plain sums over n-grams of one text at a time."""
    langs = sorted({x for _, x in train})
    counts = np.zeros((langid.BUCKETS, len(langs)))
    for text, x in train:
        for hashed, _ in langid.grams([text]):
            for h in hashed:
                counts[h, langs.index(x)] += 1
    log_p = np.log((counts + langid.SMOOTHING) / (counts + langid.SMOOTHING).sum(0))
    prior = np.log(np.array([sum(x == y for _, y in train) for x in langs]) / len(train))
    out = []
    for text in texts:
        if not text or not any(c.isalpha() for c in text):
            out.append(("und", 0.0))
            continue
        total = prior.copy()
        for hashed, _ in langid.grams([text]):
            total = total + log_p[hashed].sum(0)
        p = np.exp(total - total.max())
        out.append((langs[p.argmax()], p.max() / p.sum()))
    return out


def test_equals_brute_force(spark):
    train = [(t, "en") for t in EN] + [(t, "de") for t in DE] + [(EN[0], "en")]
    texts = ["the house", "das haus", "", None, "123 ...", "ähm", "the house", "x " * 40000, "İstanbul ǅ"]
    model = langid.fit(spark.createDataFrame([*train, ("nothing", None), (None, "de")], "text string, lang string"))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(rows, model).collect()}
    for i, (label, score) in enumerate(brute_force([*train, (None, "de")], texts)):
        assert got[i][0] == label and abs(got[i][1] - score) < 1e-3, (texts[i], got[i], label, score)


def test_nothing_to_learn_from_and_clashing_names(spark):
    model = langid.fit(spark.createDataFrame([], "text string, lang string"))
    rows = spark.createDataFrame([(1, "words", "x", 5.0)], "doc_id long, text string, lang_pred string, score double")
    (got,) = langid.predict(rows, model).collect()
    assert got.asDict() == {"doc_id": 1, "text": "words", "lang_pred": "und", "score": 0.0}
    assert langid.predict(rows.limit(0), model).collect() == []


def test_held_out_documents_change_nothing(spark, tmp_path):
    rows = [(i, (EN if i % 2 else DE)[i % 4], "en" if i % 2 else "de", "s") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df.write.parquet(str(tmp_path / "a/documents.parquet"))
    held = langid.held_out()
    df.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).write.parquet(str(tmp_path / "b/documents.parquet"))
    a, b = (sorted(map(tuple, langid.query(spark, str(tmp_path / x)).collect())) for x in "ab")
    assert a == b and any(r[1] for r in a)


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.001"
    got = langid.query(spark, path).filter("held_out").join(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
