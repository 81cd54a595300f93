import numpy as np

from linkweave.llm import quality
from linkweave.llm._text import WordHashes


def test_statistics_of_edge_texts():
    hashes = WordHashes()
    for text in (None, "", " ", "\n\n", "a", "x" * 100_000, "word " * 50_000, "é ü ß\n" * 9):
        row = quality.statistics_of(text, hashes)
        assert len(row) == len(quality.STATISTICS) and np.isfinite(row).all()
    named = dict(zip(quality.STATISTICS, quality.statistics_of("AB cd\nAB cd\n##", hashes), strict=True))
    assert named["repeated_lines"] == 1 - 2 / 3 and named["caps_words"] == 2 / 5 and named["unique_words"] == 3 / 5


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        size = int(rng.integers(1, 12))
        n, at = rng.integers(1, 6, size).astype(float), np.sort(rng.random(size))
        ones = np.array([rng.integers(0, k + 1) for k in n], float)
        centres, levels = quality.isotonic(at, ones, n)
        assert (np.diff(levels) > 0).all()
        # max over starts of min over ends of the mean: the known closed form of the isotonic fit
        fit = [max(min(ones[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, size)) for i in range(k + 1)) for k in range(size)]
        assert sorted(set(np.round(fit, 9))) == sorted(set(np.round(levels, 9)))


def test_normal_equations_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, len(quality.STATISTICS)))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y, strict=True)] + [(x[0].tolist(), None)], "stats array<double>, label int").repartition(5)
    model = quality.fit(df)
    z = quality._fourier((x - x.mean(0)) / x.std(0))
    weights = np.linalg.solve(z.T @ z + quality.PENALTY * 300 * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(z @ weights, model.ridge(x), atol=1e-6)
    scores = model.score(x)
    assert ((scores >= 0) & (scores <= 1)).all() and ((scores >= 0.5) == y).mean() > 0.9


def test_one_kind_of_label_no_labels_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "en", 3.0), (2, None, None, None), (2, "", "de", 1.0)], "doc_id long, text string, lang string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score_documents(docs, none).collect()] == [0.5] * 3
    ones = spark.createDataFrame([(1, 1), (2, 1), (3, None)], "doc_id long, quality int")
    assert {r.score for r in quality.score_documents(docs, ones).collect()} <= {0.5, 1.0}
    assert quality.score_documents(docs.limit(0), ones).collect() == []


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    got = quality.query(spark, path).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.quality == r.predicted for r in got) >= 0.95 * len(got)
    assert quality.query(spark, path).count() == spark.read.parquet(f"{path}/documents.parquet").count()
