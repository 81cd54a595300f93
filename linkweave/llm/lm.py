"""Operator 7: LM scoring with a log-bilinear neural model, trained with noise-contrastive estimation.

Tokens are words (runs without the characters 0x20 and 0x09-0x0D, A-Z in lower case) and an end after each text.

Counts.  Tasks count words in bounded tables, Spark sums them: a table of all training words in the shared folder.  The
most frequent words (as many as fit in HEAD by whole steps of their counts, of 64 bytes at most, so their size is bounded) go to all tasks; a text's other words are joined with the
count table, summed for each text.  Frequent words thus never meet in a join, and every count is exact.

Model.  The most frequent words are classes of their own; all others fall into classes by their last two bytes.  The class of
a token is predicted from the classes of the two tokens before: the sum of a vector for each of them, times the vector of the class, plus its bias (log-bilinear).  Training is
noise-contrastive against the unigram distribution of classes: in each round every task runs over its own part of the training texts in mini-batches from
the shared parameters, and Spark averages what the tasks have learnt, weighted by their tokens.  The rounds go over disjoint parts and together over all training texts once.
Parts are dealt by a hash of the document, in its order, and their number follows from the number of tokens, so what is learnt does not depend on files or partitions and
no part is too small to learn from.
Scoring is normalised: matrix products over all pairs of context classes give the normaliser of each context.
Inside its class, a word has the probability (c + 1) / (n + v + 1), n and v being the class's training tokens and words; one share is left for words never seen, so all
probabilities of a context sum to one.

Defined results: null text is empty, with the end as its only token; without training texts N and V are 0 and classes are equally likely; a null doc_id is not held out;
repeated rows are scored and counted each; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm._text import by_bytes, held
from linkweave.session import materialize, table

#: Words whose counts every task holds, and their longest length in bytes.
HEAD, HEAD_BYTES = 200_000, 64
#: Frequent words with a class of their own; classes of the other words; size of the vectors.
OWN, ENDINGS, SIZE = 480, 32, 16
CLASSES = OWN + ENDINGS
#: The context before a text's first token.
START = CLASSES
ROUNDS, BATCH, NOISE, RATE = 2, 1024, 32, 0.15
#: Training tokens in a part.
PART_TOKENS = 2_000_000
#: Words in a task's table of counts before it is put out.
COUNTED = 250_000
END = b""


def ending(word: bytes) -> int:
    """Class of a word without a class of its own."""
    return OWN + (word[-1] * 31 + (word[-2] if len(word) > 1 else 0)) % ENDINGS


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) of all tokens of the column ``text``; the end is the empty word."""

    def put(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("lm")
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update((text or "").encode().lower().split())
                counts[END] += 1
                if len(counts) > COUNTED:
                    yield put(counts)
                    counts = Counter()
        if counts:
            yield put(counts)

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    tokens: int
    distinct: int
    words: list[bytes]
    counts: np.ndarray
    #: tokens and words of each class in training
    class_tokens: np.ndarray
    class_words: np.ndarray

    def classes(self) -> np.ndarray:
        """Class of every head word."""
        return np.array([k if k < OWN else ending(w) if w else OWN for k, w in enumerate(self.words)], np.int32)


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """What tasks need of the table of counts: sums, the head and totals of the classes."""
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    # A histogram of counts, in steps of 1/64 of a doubling, tells from where on all words fit in the head; only those are gathered.
    short = counts.filter(F.octet_length("word") <= HEAD_BYTES).withColumn("step", F.floor(F.log2("n") * 64))
    steps = sorted(((r["step"], r["count"]) for r in short.groupBy("step").count().collect()), reverse=True)
    fits = [step for (step, _), sum_ in zip(steps, np.cumsum([c for _, c in steps]), strict=True) if sum_ <= head]
    top = short.filter(F.col("step") >= F.lit(min(fits) if fits else 1 << 40)).select("word", "n").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    words = top.column("word").to_pylist()
    own = set(words[:OWN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            kinds = np.array([-1 if w in own else ending(w) if w else OWN for w in batch.column("word").to_pylist()])
            mine = kinds >= 0
            np.add.at(n, kinds[mine], batch.column("n").to_numpy()[mine])
            np.add.at(v, kinds[mine], 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES), pa.int32()), pa.array(n), pa.array(v)], names=["class", "n", "v"])

    sums = counts.mapInArrow(run, "class int, n long, v long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toPandas()
    class_tokens, class_words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    class_tokens[sums["class"]], class_words[sums["class"]] = sums["n"], sums["v"]
    head_counts = top.column("n").to_numpy().astype(np.int64)
    class_tokens[: min(OWN, len(words))] = head_counts[:OWN]
    class_words[: min(OWN, len(words))] = 1
    return Vocabulary(int(total["n"] or 0), int(total["v"]), words, head_counts, class_tokens, class_words)


class Tokens:
    """Turns texts into head places and classes; a task's view of the vocabulary."""

    def __init__(self, words: list[bytes], classes: np.ndarray):
        self.place = dict(zip(words, range(len(words)), strict=True))
        self.classes = np.append(classes, -1)

    def of(self, texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, their places in the head (-1: none), their classes, and the number of tokens of each text."""
        words: list[bytes] = []
        lengths = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            mine = (text or "").encode().lower().split()
            words += mine
            words.append(END)
            lengths[k] = len(mine) + 1
        get = self.place.get
        places = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        classes = self.classes[places]
        unknown = np.flatnonzero(classes < 0)
        classes[unknown] = [ending(words[k]) if words[k] else OWN for k in unknown.tolist()]
        return words, places, classes, lengths


def contexts(classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the token before and of the one before that."""
    starts = np.cumsum(lengths) - lengths
    before = np.concatenate([[START], classes[:-1]])
    before[starts] = START
    further = np.concatenate([[START], before[:-1]])
    further[starts] = START
    return before, further


@dataclass
class Parameters:
    near: np.ndarray  # vectors of the token before
    far: np.ndarray  # vectors of the token before that
    out: np.ndarray  # vectors of the predicted class
    bias: np.ndarray

    @classmethod
    def start(cls, unigram: np.ndarray) -> Parameters:
        rng = np.random.default_rng(7)
        draw = lambda n: rng.normal(0, 0.1, (n, SIZE)).astype(np.float32)
        return cls(draw(CLASSES + 1), draw(CLASSES + 1), draw(CLASSES), np.log(unigram).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.near.ravel(), self.far.ravel(), self.out.ravel(), self.bias])

    @classmethod
    def of_flat(cls, x: np.ndarray) -> Parameters:
        a, b = (CLASSES + 1) * SIZE, CLASSES * SIZE
        near, far, out, bias = np.split(x.astype(np.float32), [a, 2 * a, 2 * a + b])
        return cls(near.reshape(-1, SIZE), far.reshape(-1, SIZE), out.reshape(-1, SIZE), bias)

    def log_normaliser(self) -> np.ndarray:
        """Natural logarithm of the sum over classes for every context: (before, further)."""
        out = np.empty((CLASSES + 1, CLASSES + 1), np.float32)
        for k in range(CLASSES + 1):
            scores = (self.near[k] + self.far) @ self.out.T + self.bias
            top = scores.max(1)
            out[k] = top + np.log(np.exp(scores - top[:, None]).sum(1))
        return out


class Trainer:
    """Noise-contrastive steps with Adagrad; the noise of a mini-batch is shared by its tokens."""

    def __init__(self, parameters: Parameters, unigram: np.ndarray, seed: int):
        self.p = parameters
        self.squares = [np.full_like(x, 0.1) for x in (parameters.near, parameters.far, parameters.out, parameters.bias)]
        self.noise = np.log(NOISE * unigram).astype(np.float32)
        self.cumulated = np.cumsum(unigram)
        self.rng = np.random.default_rng(seed)

    def _step(self, x: np.ndarray, squares: np.ndarray, at: np.ndarray, gradient: np.ndarray) -> None:
        order = np.argsort(at, kind="stable")
        rows = at[order]
        begins = np.flatnonzero(np.diff(rows, prepend=-1))
        total = np.add.reduceat(gradient[order], begins, axis=0)
        rows = rows[begins]
        squares[rows] += total * total
        x[rows] -= RATE * total / np.sqrt(squares[rows])

    def learn(self, word: np.ndarray, before: np.ndarray, further: np.ndarray) -> None:
        p = self.p
        for i in range(0, len(word), BATCH):
            w, a, b = word[i : i + BATCH], before[i : i + BATCH], further[i : i + BATCH]
            noise = np.minimum(np.searchsorted(self.cumulated, self.rng.random(NOISE)), CLASSES - 1)
            h = p.near[a] + p.far[b]
            right = np.einsum("ij,ij->i", h, p.out[w]) + p.bias[w] - self.noise[w]
            wrong = h @ p.out[noise].T + p.bias[noise] - self.noise[noise]
            g_right = -1 / (1 + np.exp(np.clip(right, -30, 30)))
            g_wrong = 1 / (1 + np.exp(-np.clip(wrong, -30, 30)))
            scale = np.float32(1 / 32)
            g_right, g_wrong = g_right * scale, g_wrong * scale
            g_h = g_right[:, None] * p.out[w] + g_wrong @ p.out[noise]
            at = np.concatenate([w, noise])
            g_out = np.concatenate([g_right[:, None] * h, g_wrong.T @ h])
            g_bias = np.concatenate([g_right, g_wrong.sum(0)])
            self._step(p.out, self.squares[2], at, g_out)
            self._step(p.bias, self.squares[3], at, g_bias)
            self._step(p.near, self.squares[0], a, g_h)
            self._step(p.far, self.squares[1], b, g_h)


def unigram(v: Vocabulary) -> np.ndarray:
    """Share of each class; next to nothing for own classes that no word has taken."""
    n = v.class_tokens + 1.0
    n[len(v.words) : OWN] = 1e-6
    return n / n.sum()


def train(texts: DataFrame, v: Vocabulary, part: Column, rounds: int = ROUNDS) -> Parameters:
    """``part``: a number for each row of ``texts``; round k goes over those whose number is k modulo ``rounds``."""
    spark = texts.sparkSession
    shared = Parameters.start(unigram(v))
    frequent = unigram(v)
    head = spark.sparkContext.broadcast((v.words, v.classes()))
    for k in range(rounds):
        start = shared.flat()

        def run(batches: Iterator[pa.RecordBatch], start: np.ndarray = start, k: int = k) -> Iterator[pa.RecordBatch]:
            held("lm")
            tokens, trainer, seen = Tokens(*head.value), Trainer(Parameters.of_flat(start), frequent, k), 0
            for whole in batches:
                for batch in by_bytes(whole, "text"):
                    _, _, classes, lengths = tokens.of(batch.column("text").to_pylist())
                    trainer.learn(classes, *contexts(classes, lengths))
                    seen += len(classes)
            if seen:
                values = np.append(trainer.p.flat().astype(np.float64), 1.0) * seen
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], names=["cell", "value"])

        mine = texts.filter(F.pmod(part, F.lit(rounds)) == k).select("text", F.xxhash64("doc_id", "text").alias("order"))
        dealt = mine.repartition(max(1, v.tokens // rounds // PART_TOKENS), "order").sortWithinPartitions("order").select("text")
        sums = dealt.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
        summed = sums.orderBy("cell").toPandas()["value"].to_numpy()
        if len(summed):
            shared = Parameters.of_flat(summed[:-1] / summed[-1])
    head.unpersist()
    return shared


def score(docs: DataFrame, counts: DataFrame, v: Vocabulary, parameters: Parameters) -> DataFrame:
    """doc_id -> n_tokens, n_known, train_tokens, base_score, score; other columns of ``docs`` but the text are kept."""
    spark = docs.sparkSession
    kept = [f for f in docs.schema.fields if f.name != "text"]
    names = [f.name for f in kept]
    shared = spark.sparkContext.broadcast((v.words, v.classes(), v.counts, parameters, parameters.log_normaliser()))
    # Sums over a class's words and the share of words never seen, as a logarithm
    inside = np.log10(v.class_tokens + v.class_words + 1.0)
    inside[:OWN] = 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("lm")
        words_of, classes_of, counts_of, p, normaliser = shared.value
        tokens = Tokens(words_of, classes_of)
        log_count = np.append(np.log10(counts_of + 1.0), 0.0)
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                words, places, classes, lengths = tokens.of(batch.column("text").to_pylist())
                before, further = contexts(classes, lengths)
                logs = np.empty(len(words), np.float64)
                for i in range(0, len(words), 1 << 16):
                    j = slice(i, i + (1 << 16))
                    logs[j] = np.einsum("ij,ij->i", p.near[before[j]] + p.far[further[j]], p.out[classes[j]]) + p.bias[classes[j]] - normaliser[before[j], further[j]]
                known = places >= 0
                common = log_count[places] * known
                # A word of its own class has all of the class's probability.
                model = logs / np.log(10) - inside[classes] + np.where(classes >= OWN, common, 0.0)
                begins = np.cumsum(lengths) - lengths
                sums = [np.add.reduceat(x, begins) for x in (known.astype(np.int64), common, model)]
                tail_words, tail_n = [], []
                missing = np.flatnonzero(~known)
                ends = np.searchsorted(missing, np.cumsum(lengths))
                first = 0
                for end in ends.tolist():
                    rare = Counter(words[k] for k in missing[first:end].tolist())
                    tail_words.append(list(rare))
                    tail_n.append(list(rare.values()))
                    first = end
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), pa.array(lengths), *map(pa.array, sums), pa.array(tail_words, pa.list_(pa.binary())), pa.array(tail_n, pa.list_(pa.int64()))],
                    names=[*names, "n_tokens", "head_known", "head_log", "model", "words", "ns"],
                )

    schema = docs.select(*names).withColumns({"n_tokens": F.lit(0).cast("long"), "head_known": F.lit(0).cast("long"), "head_log": F.lit(0.0), "model": F.lit(0.0), "words": F.array().cast("array<binary>"), "ns": F.array().cast("array<bigint>")}).schema
    parts = materialize(docs.select(*names, "text").mapInArrow(run, schema).withColumn("__row", F.monotonically_increasing_id()), "lm-parts")
    tail = parts.select("__row", F.inline(F.arrays_zip("words", "ns"))).withColumnRenamed("words", "word")
    joined = tail.join(counts, "word").groupBy("__row").agg(F.sum("ns").alias("tail_known"), F.sum(F.col("ns") * F.log10(F.col("n") + 1.0)).alias("tail_log"))
    # A word that only the text has, not the training, adds the logarithm of 1.
    at_all = float(np.log10(v.tokens + v.distinct + 1.0))
    value = lambda c: F.coalesce(F.col(c), F.lit(0))
    return parts.drop("words", "ns").join(joined, "__row", "left").select(
        *names,
        "n_tokens",
        (F.col("head_known") + value("tail_known")).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("head_log") + value("tail_log") - F.col("n_tokens") * F.lit(at_all)).alias("base_score"),
        (F.col("model") + value("tail_log")).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: log10 probability of every document, by counts alone and by the model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out())
    training = docs.filter(~F.col("held_out"))
    counts = materialize(count_words(training), "lm-counts")
    v = vocabulary(counts)
    part = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) div 7"), F.lit(0))
    return score(docs, counts, v, train(training, v, part))
