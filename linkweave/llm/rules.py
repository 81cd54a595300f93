"""Operator 10: quality rules as weak supervision, in DataFrame functions only.

Each rule looks at one count or ratio of a text and votes good (1), bad (0) or abstains (null).  Texts with the same votes
are counted together, which leaves a table of at most 3 ** rules patterns however many texts there are.  On this table
expectation-maximisation estimates how often each rule is right about good and about bad texts, and the
share of good texts; a text's verdict is its posterior probability under these estimates, not the conjunction of the
rules.  A plain base filter comes before: it fails texts with few words or with much repetition.

Every expression works within its row, so the only shuffle is that of the patterns' counts.

Defined results: null and empty text have no words and fail the base filter; with no text at all the estimates stay
at their start; a text on which all rules abstain has the share of good texts as its posterior; repeated rows count each;
columns that have the name of an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.session import materialize, table

#: The white space that separates words: 0x20 and 0x09-0x0D.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Base filter: fewest words; most percent of words in repeated windows.
MIN_WORDS, MAX_REPEATED = 10, 20
ROUNDS = 12

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_distinct_words", "n_lines", "n_capitals", "n_alnum")


def _repeated(windows: Column) -> Column:
    """Of an array of window hashes: the number of words covered by windows that occur twice or more."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # A single field keeps the sorted array from being worked out anew for every element.
    twice = F.aggregate(
        F.array(placed),
        F.array().cast("array<int>"),
        lambda _, p: F.array_sort(
            F.transform(
                F.filter(p, lambda x, k: ((k > 0) & (F.get(p, k - 1)["h"] == x["h"])) | (F.get(p, k + 1)["h"] == x["h"])),
                lambda x: x["i"],
            )
        ),
    )
    covered = F.aggregate(
        twice,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
    )["n"]
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(covered)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds BASE and MORE, all long, counted over the whole text."""
    names = [c for c in docs.columns if c not in (*BASE, *MORE)]
    whole = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(whole, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    df = docs.select(*names, words.alias("__words"), lines.alias("__lines"), whole.alias("__whole"))
    w = F.col("__words")
    windows = F.when(F.size(w) < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))
    )
    df = df.withColumn("__windows", windows)
    size = lambda c: F.size(c).cast("long")
    length = lambda c: F.char_length(c).cast("long")
    without = lambda chars: length("__whole") - length(F.translate("__whole", chars, ""))
    return df.select(
        *names,
        size("__words").alias("n_words"),
        (length("__whole") - without(BLANKS)).alias("word_chars"),
        without(SYMBOLS).alias("n_symbols"),
        (size("__lines") - size(F.array_distinct("__lines"))).alias("n_dup_lines"),
        _repeated(F.col("__windows")).alias("n_repeat_words"),
        size(F.array_distinct("__words")).alias("n_distinct_words"),
        size("__lines").alias("n_lines"),
        length(F.regexp_replace("__whole", r"\P{Lu}+", "")).alias("n_capitals"),
        length(F.regexp_replace("__whole", r"[^\p{L}\p{N}]+", "")).alias("n_alnum"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains."""

    name: str
    bad: str
    good: str

    def vote(self) -> Column:
        return F.expr(f"cast(case when {self.bad} then 0 when {self.good} then 1 end as int)")


#: Integer arithmetic throughout, so that every engine gives the same votes.  That a fault is absent is no evidence of
#: a good text, so rules that look for a fault abstain otherwise.
RULES = (
    Rule("length", "false", "n_words >= 50"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words", "false"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("many_symbols", "4 * n_symbols > n_words", "false"),
    Rule("alphanumeric", "4 * n_alnum < 3 * word_chars", "100 * n_alnum >= 92 * word_chars"),
    Rule("lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines", "false"),
    Rule("windows", "100 * n_repeat_words > 15 * n_words", "false"),
    Rule("variety", "n_words >= 20 and 5 * n_distinct_words < n_words", "n_words >= 20 and 5 * n_distinct_words >= 2 * n_words"),
    Rule("capitals", "10 * n_capitals > 4 * n_alnum", "false"),
)


@dataclass
class Estimates:
    """Share of good texts and, for each rule, how often its vote is right about good and about bad texts."""

    prior: float = 0.8
    on_good: list[float] = field(default_factory=list)
    on_bad: list[float] = field(default_factory=list)

    @classmethod
    def start(cls, rules: tuple[Rule, ...]) -> Estimates:
        return cls(0.8, [0.8] * len(rules), [0.8] * len(rules))

    def posterior(self, votes: list[Column]) -> Column:
        """Probability that a text with these votes is good."""
        product = lambda sure, first: reduce(lambda a, b: a * b, sure, F.lit(first))
        good = product([F.when(v.isNull(), 1.0).when(v == 1, a).otherwise(1 - a) for v, a in zip(votes, self.on_good, strict=True)], self.prior)
        bad = product([F.when(v.isNull(), 1.0).when(v == 0, b).otherwise(1 - b) for v, b in zip(votes, self.on_bad, strict=True)], 1 - self.prior)
        return good / (good + bad)


def estimate(votes: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS) -> Estimates:
    """Expectation-maximisation over the patterns of all rows of ``votes`` (a column for each rule)."""
    names = [r.name for r in rules]
    patterns = materialize(votes.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1), "rule-patterns")
    now = Estimates.start(rules)
    columns = [F.col(x) for x in names]
    # Sums are smoothed by a few imagined votes that are right, which keeps a rule from turning round and shares off 0 and 1.
    for _ in range(rounds):
        p = now.posterior(columns)
        sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("good")]
        for k, c in enumerate(columns):
            sums += [
                F.sum(F.when(c.isNotNull(), F.col("n") * F.col("p"))).alias(f"g{k}"),
                F.sum(F.when(c == 1, F.col("n") * F.col("p"))).alias(f"gr{k}"),
                F.sum(F.when(c.isNotNull(), F.col("n") * (1 - F.col("p")))).alias(f"b{k}"),
                F.sum(F.when(c == 0, F.col("n") * (1 - F.col("p")))).alias(f"br{k}"),
            ]
        row = patterns.withColumn("p", p).agg(*sums).first()
        if not row["n"]:
            return now
        ratio = lambda right, of: ((right or 0.0) + 4.0) / ((of or 0.0) + 5.0)
        now = Estimates(
            min(0.99, max(0.01, row["good"] / row["n"])),
            [min(0.999, max(0.5, ratio(row[f"gr{k}"], row[f"g{k}"]))) for k in range(len(rules))],
            [min(0.999, max(0.5, ratio(row[f"br{k}"], row[f"b{k}"]))) for k in range(len(rules))],
        )
    return now


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS) -> DataFrame:
    """Replaces the text by BASE, MORE, the votes, posterior, base_failed and kept."""
    names = [r.name for r in rules]
    keep = [c for c in docs.columns if c not in (text, *BASE, *MORE, *names, "posterior", "base_failed", "kept")]
    counts = materialize(measure(docs.select(*keep, F.col(text).alias("__text")), "__text").drop("__text"), "rule-counts")
    voted = counts.select("*", *(r.vote().alias(r.name) for r in rules))
    posterior = estimate(voted.select(*names), rules, rounds).posterior([F.col(x) for x in names])
    judged = voted.withColumn("posterior", posterior).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: counts, base filter and verdict for every document."""
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *BASE, "base_failed", "kept", F.round("posterior", 6).alias("posterior"))
