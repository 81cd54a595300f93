"""Operator 5: quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

One pass over the texts gives a row of statistics for each document (a narrow table in the shared folder).  The
statistics of the labelled rows are standardised and mapped to random Fourier features, which approximate a
Gaussian kernel.  Every task adds up its part of the normal equations; Spark sums the parts; the driver solves a system whose
size is the number of features.  Ridge scores of the labelled rows are then counted in a fixed number of bins, the
pool-adjacent-violators method makes the share of label 1 monotone over the bins, and scores are read off between the blocks.

Defined results: null text counts as empty; every row gets a score, also empty texts and repeated rows; rows
with null label aren't learnt from, and neither are rows without an id; where an id occurs in several rows or labels, each row counts with each label of its id; with labels of one kind only, or none, every score is the share of label 1 (0.5 without labels);
other columns are never read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.llm._text import WordHashes, by_bytes, held, shingles
from linkweave.session import materialize, table

#: Random features, width of the kernel in standardised units, ridge penalty for each labelled row.
FEATURES, WIDTH, PENALTY = 256, 6.0, 1e-4
#: Bins in which the scores of labelled rows are counted for the calibration.
BINS = 2048
SEED = 20

_SYMBOLS = b"#*$%&|<>"
_ENDS = b".,;:!?"

STATISTICS = (
    "log_chars log_words word_mean word_std word_max unique_words repeated_pairs repeated_windows log_lines line_mean short_lines "
    "repeated_lines upper caps_words title_words digits spaces symbols ends exclaims other_ascii non_ascii entropy word_entropy symbol_words ended_words longest_run word_collision"
).split()

_RUN = re.compile(r"(.)\1{3,}", re.S)


def statistics_of(text: str | None, hashes: WordHashes) -> list[float]:
    """STATISTICS of one whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    n_bytes, words = max(1, len(raw)), raw.split()
    n = max(1, len(words))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = lambda chars: float(sum(counts[c] for c in chars)) / n_bytes
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    hashed = hashes.of(text)
    of_word = np.unique(hashed, return_counts=True)[1] if len(hashed) else np.ones(1, np.int64)
    repeated = lambda width: (1 - len(np.unique(s)) / len(s)) if len(s := shingles(hashed, width)) else 0.0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    p, q = counts[counts > 0] / n_bytes, of_word / n
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        float(lengths.mean()),
        float(lengths.std()),
        float(np.log1p(lengths.max())),
        len(of_word) / n,
        repeated(2),
        repeated(5),
        np.log1p(len(lines)),
        np.log1p(len(raw) / k),
        sum(len(x) < 20 for x in lines) / k,
        1 - len(set(lines)) / k if lines else 0.0,
        float(counts[65:91].sum()) / n_bytes,
        sum(map(bytes.isupper, words)) / n,
        sum(map(bytes.istitle, words)) / n,
        float(counts[48:58].sum()) / n_bytes,
        share(b" \t\n\r"),
        share(_SYMBOLS),
        share(_ENDS),
        share(b"!"),
        float(counts[33:127].sum() - counts[48:58].sum() - counts[65:91].sum() - counts[97:123].sum()) / n_bytes,
        float(counts[128:].sum()) / n_bytes,
        float(-(p * np.log2(p)).sum()),
        float(-(q * np.log2(q)).sum()) / np.log2(n + 1),
        sum(w[-1] in _SYMBOLS for w in words) / n,
        sum(w[-1] in _ENDS for w in words) / n,
        float(np.log1p(max((len(m[0]) for m in _RUN.finditer(text)), default=0))),
        float((q * q).sum()),
    ]


def statistics(docs: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """Replaces the column ``text`` by ``out``, an array of STATISTICS."""
    kept = [f for f in docs.schema.fields if f.name not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = held("words", WordHashes)
        for whole in batches:
            for batch in by_bytes(whole, text):
                rows = [statistics_of(x, hashes) for x in batch.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(rows, pa.list_(pa.float64()))], names=[*(f.name for f in kept), out])

    return docs.select(*(f.name for f in kept), text).mapInArrow(run, docs.select(*(f.name for f in kept)).withColumn(out, F.array().cast("array<double>")).schema)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    #: calibration: ridge scores and probabilities at the centres of the blocks
    centres: np.ndarray
    levels: np.ndarray
    share: float

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return _fourier((stats - self.mean) / self.scale) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(stats), self.share)
        raw = self.ridge(stats)
        # A small share of the raw score keeps the order within a level; it never crosses one half by itself.
        level = np.interp(raw, self.centres, self.levels)
        order = 1 / (1 + np.exp(-4 * (raw - 0.5)))
        mixed = 0.999 * level + 0.001 * order
        return np.clip(np.where((level >= 0.5) == (mixed >= 0.5), mixed, level), 0.0, 1.0)


@functools.cache
def _draws(size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.normal(0, 1 / WIDTH, (size, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)


def _fourier(x: np.ndarray) -> np.ndarray:
    directions, phases = _draws(x.shape[1])
    x = np.clip(x, -8, 8)
    # Beside the random features: a constant and the statistics themselves, so that far points have a trend.
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(x @ directions + phases), np.ones((len(x), 1)), x / 8])


def _stack(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, len(STATISTICS))


def fit(labelled: DataFrame, stats: str = "stats", label: str = "label") -> Model:
    """Learn from all rows of ``labelled``: an array of statistics and a label 0 or 1."""
    rows = labelled.select(F.col(stats).alias("stats"), F.col(label).cast("double").alias("label")).filter(F.col("label").isNotNull())
    at = [F.col("stats")[k] for k in range(len(STATISTICS))]
    first = rows.agg(F.count("*").alias("n"), F.avg("label").alias("share"), *(F.avg(x).alias(f"m{k}") for k, x in enumerate(at)), *(F.stddev_pop(x).alias(f"s{k}") for k, x in enumerate(at))).first()
    empty = np.empty(0)
    if not first["n"] or first["share"] in (0.0, 1.0):
        return Model(empty, empty, empty, empty, empty, 0.5 if not first["n"] else first["share"])
    mean = np.array([first[f"m{k}"] for k in range(len(at))])
    scale = np.array([first[f"s{k}"] for k in range(len(at))])
    scale[scale < 1e-9] = 1.0
    size = FEATURES + 1 + len(at)
    upper = np.triu_indices(size)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("quality")
        gram, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            z = _fourier((_stack(batch.column("stats")) - mean) / scale)
            gram += z.T @ z
            right += z.T @ batch.column("label").to_numpy()
        values = np.concatenate([gram[upper], right])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], names=["cell", "value"])

    summed = rows.mapInArrow(equations, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).orderBy("cell").toPandas()["value"].to_numpy()
    gram = np.zeros((size, size))
    gram[upper] = summed[: len(upper[0])]
    gram = gram + gram.T - np.diag(np.diag(gram))
    weights = np.linalg.solve(gram + PENALTY * first["n"] * np.eye(size), summed[len(upper[0]) :])
    model = Model(mean, scale, weights, empty, empty, first["share"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.ridge(_stack(batch.column("stats")))
            cell = np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(raw), batch.column("label")], names=["bin", "raw", "label"])

    bins = rows.mapInArrow(count, "bin long, raw double, label double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("raw").alias("raw"), F.sum("label").alias("ones")).orderBy("bin").toPandas()
    model.centres, model.levels = isotonic(bins["raw"].to_numpy(), bins["ones"].to_numpy(), bins["n"].to_numpy())
    return model


def isotonic(at: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points in ascending order: centre and level of every block."""
    blocks: list[list[float]] = []
    for x, one, count in zip(at, ones, n, strict=True):
        blocks.append([x * count, one, count])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            x2, one2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + x2, blocks[-1][1] + one2, blocks[-1][2] + n2]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def predict(rows: DataFrame, model: Model, stats: str = "stats", score: str = "score") -> DataFrame:
    """Replaces the statistics by the calibrated probability of label 1."""
    kept = [f for f in rows.schema.fields if f.name not in (stats, score)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(model.score(_stack(batch.column(stats))))], names=[*(f.name for f in kept), score])

    return rows.mapInArrow(run, rows.select(*(f.name for f in kept)).withColumn(score, F.lit(0.0)).schema)


def score_texts(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds (or replaces) the score of each text in one pass, with all columns kept; a slice of texts goes through the model at once."""
    kept = [f for f in docs.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = held("words", WordHashes)
        for whole in batches:
            for batch in by_bytes(whole, text):
                scores = model.score(np.array([statistics_of(x, hashes) for x in batch.column(text).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(scores, pa.float64())], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``; learns from ``labels`` (doc_id, quality) outside the held-out third."""
    stats = materialize(statistics(docs.select("doc_id", "text")), "quality-stats")
    labels = labels.select("doc_id", F.col("quality").alias("label")).filter(F.col("label").isNotNull() & ~held_out())
    model = fit(stats.join(labels, "doc_id"))
    return predict(stats, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: quality score of every document."""
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
