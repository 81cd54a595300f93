"""Operator 8: language identification with multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, every run of characters that aren't letters becomes one space, and its n-grams of one
to three characters are hashed into 2**15 buckets.  Training counts buckets for each language in
numpy, per task, and Spark sums the counts; the model is the matrix of log-probabilities (languages x buckets), which goes to
all tasks.  Scoring gathers the matrix' columns at a text's n-grams and sums them for a whole slice of texts
at once.

Defined results: null text and text without a letter are ``und`` with score 0, and so is every text when there
is nothing to learn from; rows with null language are not learnt from; on equal posteriors
the language that comes first by name wins; repeated rows count as often as they occur; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.llm._text import by_bytes, held
from linkweave.session import table

UNDETERMINED = "und"
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Text bytes that are worked on at once; a code point takes some ten numbers meanwhile.
SLICE = 1 << 19
#: Added to every bucket's count.
SMOOTHING = 0.5

_letters: np.ndarray | None = None


def is_letter() -> np.ndarray:
    """True at the code points of letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: hashed n-grams of all texts, and the number of the text that each comes from.

    A text is framed by spaces, so that n-grams see where words begin and end, and never span two texts."""
    lowered = [f" {x.lower()} " if x else "" for x in texts]
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(lowered)), lengths)
    letter = is_letter()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    starts = np.cumsum(lengths) - lengths
    keep[starts[lengths > 0]] = True
    codes = np.where(letter, codes, 32)[keep].astype(np.uint32)
    owner = owner[keep]
    mixed = np.zeros(len(codes), np.uint32)
    for n in ORDERS:
        if len(codes) < n:
            return
        size = len(codes) - n + 1
        mixed = (mixed[:size] ^ codes[n - 1 :]) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        inside = owner[:size] == owner[n - 1 :]
        yield ((mixed[inside] * np.uint32(0x85EBCA77)) >> np.uint32(17)).astype(np.int32), owner[:size][inside]


@dataclass
class Model:
    languages: list[str]
    #: buckets x languages, natural logarithms
    log_probability: np.ndarray
    log_prior: np.ndarray


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from all rows with a language.  What reaches the driver has at most BUCKETS rows for each language."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter(F.col("lang").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("languages")
        sums: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for whole in batches:
            for batch in by_bytes(whole, "text", SLICE):
                langs = batch.column("lang").to_pylist()
                names = sorted(set(langs))
                number = np.array([names.index(x) for x in langs])
                for x in langs:
                    docs_of[x] = docs_of.get(x, 0) + 1
                for hashed, owner in grams(batch.column("text").to_pylist()):
                    counts = np.bincount(number[owner] * BUCKETS + hashed, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                    for k, x in enumerate(names):
                        sums[x] = sums[x] + counts[k] if x in sums else counts[k].astype(np.int64)
        for x, n in docs_of.items():
            mine = sums.get(x, np.zeros(BUCKETS, np.int64))
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(mine[at], n), pa.int64())], names=["lang", "bucket", "n"]
            )

    summed = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(summed["lang"].unique())
    counts = np.zeros((BUCKETS, len(languages)))
    prior = np.zeros(len(languages))
    for k, x in enumerate(languages):
        mine = summed[summed["lang"] == x]
        prior[k] = mine.loc[mine["bucket"] < 0, "n"].sum()
        mine = mine[mine["bucket"] >= 0]
        counts[mine["bucket"].to_numpy(), k] = mine["n"].to_numpy()
    smoothed = counts + SMOOTHING
    return Model(languages, np.log(smoothed / smoothed.sum(0)).astype(np.float32) if languages else counts, np.log(prior / prior.sum()) if languages else prior)


def predict(docs: DataFrame, model: Model, text: str = "text", label: str = "lang_pred", score: str = "score", fit: str | None = None) -> DataFrame:
    """Adds the predicted language and its posterior probability; columns of these names are replaced.

    With ``fit``, also how much likelier the text's n-grams are on average (as a logarithm, at most 1 either way for each n-gram, so that
    a bucket shared by chance decides nothing) in that language than if all buckets were equally likely; texts of a language that wasn't
    learnt are below 0."""
    kept = [f for f in docs.schema.fields if f.name not in (label, score, fit)]
    schema = T.StructType([*kept, T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType()), *([T.StructField(fit, T.DoubleType())] if fit else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("languages")
        names = np.array([*model.languages, UNDETERMINED], object)
        bounded = np.clip(model.log_probability + np.float32(np.log(BUCKETS)), -1, 1) if fit else None
        for whole in batches:
            for batch in by_bytes(whole, text, SLICE):
                texts, n = batch.column(text).to_pylist(), batch.num_rows
                known = np.fromiter((bool(x) and any(map(str.isalpha, x)) for x in texts), bool, n)
                best, sure, fits, grams_of = np.full(n, len(model.languages)), np.zeros(n), np.zeros(n), np.zeros(n)
                if model.languages:
                    total, over = np.tile(model.log_prior, (n, 1)), np.zeros((n, len(model.languages)))
                    for hashed, owner in grams(texts):
                        if len(owner):
                            begins = np.flatnonzero(np.diff(owner, prepend=-1))
                            total[owner[begins]] += np.add.reduceat(model.log_probability[hashed], begins, axis=0, dtype=np.float64)
                            if fit:
                                over[owner[begins]] += np.add.reduceat(bounded[hashed], begins, axis=0, dtype=np.float64)
                            grams_of[owner[begins]] += np.diff(begins, append=len(owner))
                    top = total.max(1, keepdims=True)
                    posterior = np.exp(total - top) / np.exp(total - top).sum(1, keepdims=True)
                    best[known] = posterior.argmax(1)[known]
                    sure[known] = posterior.max(1)[known]
                    fits = np.where(known, over[np.arange(n), posterior.argmax(1)] / np.maximum(1, grams_of), 0.0)
                more = [pa.array(fits, pa.float64())] if fit else []
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(names[best], pa.string()), pa.array(sure, pa.float64()), *more], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def learn(docs: DataFrame) -> Model:
    """The model from the documents that aren't held out (a null id counts as not held out)."""
    return fit(docs.filter(~F.coalesce(held_out(), F.lit(False))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: language of every document; a third of them is never learnt from."""
    docs = table(spark, sf_dir, "documents")
    scored = predict(docs.select("doc_id", "text"), learn(docs))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
