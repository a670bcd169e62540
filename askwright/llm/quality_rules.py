"""Quality by weak supervision: rules vote, their accuracies are estimated without labels, a posterior decides.

Each rule looks at one side of a text (length, signs, repeated lines, ...) and votes good or bad, or abstains where its side
tells nothing.  Rules that must all pass would drop a text for one weak sign; here the votes are weighed.  A latent quality
(good or bad) explains them: given the quality, rules err independently, each at its own rates.  Expectation-maximisation
fits the share of good texts and each rule's rates; a text's probability of being good follows from its votes.

A vote counts only among the texts that a rule votes on, so to abstain is no evidence.  Rates carry pseudo-counts (FAITH) that
say what a rule is meant to mean, so that the two qualities cannot change places, and a bad vote never speaks for quality.

How it runs: one pass in Python counts what the rules need and is written as a small table without texts.  Votes are native
expressions over it.  The votes of all documents are counted by pattern: R rules have at most 3^R patterns, 59,049 here,
whatever the corpus; that table is all that the driver takes, and the expectations over it are those over all documents.
Posteriors are native expressions again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askwright.llm.common import materialize, slices

LEAST_WORDS, MOST_REPEATED = 20, 30  # the base: fewer words, or a greater percentage of words in repeated windows, fail
WINDOW = 8
SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
CONTINUED = bytes(range(0x80, 0xC0))  # bytes that go on with a sign begun before
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_top", "n_short", "n_capitals", "n_ends"]


@dataclass(frozen=True)
class Rule:
    """Conditions in SQL over COUNTS.  Where both or neither hold, the rule abstains."""

    name: str
    good: str
    bad: str


RULES = [
    Rule("length", "n_words >= 50", "n_words < 25"),
    Rule("symbols", "100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("lines", "n_lines >= 3 AND n_dup_lines = 0", "n_lines >= 3 AND 2 * n_dup_lines > n_lines"),
    Rule("windows", "n_words >= 40 AND 50 * n_repeat_words <= n_words", "10 * n_repeat_words > 3 * n_words"),
    Rule("commonest", "n_words >= 40 AND 10 * n_top <= n_words", "n_words >= 20 AND 5 * n_top > n_words"),
    Rule("short_words", "n_words >= 20 AND 5 * n_short >= n_words AND 4 * n_short <= 3 * n_words", "n_words >= 20 AND 20 * n_short < n_words"),
    Rule("capitals", "20 * n_capitals <= n_words", "n_words >= 10 AND 10 * n_capitals > 3 * n_words"),
    Rule("word_length", "word_chars >= 3 * n_words AND word_chars <= 8 * n_words", "2 * word_chars < 5 * n_words OR word_chars > 12 * n_words"),
    Rule("variety", "n_words BETWEEN 20 AND 2000 AND 10 * n_distinct >= 4 * n_words", "n_words BETWEEN 20 AND 2000 AND 5 * n_distinct < n_words"),
    Rule("sentences", "50 * n_ends >= n_words AND 4 * n_ends <= n_words", "n_words >= 60 AND 200 * n_ends < n_words OR n_words >= 20 AND 2 * n_ends > n_words"),
]


def repeated_words(numbers: np.ndarray, window: int = WINDOW) -> int:
    """How many words stand in windows that occur twice or more; numbers has one number for each distinct word.

    Windows are numbered by doubling (pairs of words, pairs of pairs, ...): equal numbers are equal windows, without hashing.
    """
    size = 1
    while size < window:
        if len(numbers) <= size:
            return 0
        pairs = numbers[:-size].astype(np.int64) * (int(numbers.max()) + 1) + numbers[size:]
        distinct, numbers = np.unique(pairs, return_inverse=True)
        size *= 2
        if len(distinct) == len(numbers):  # all differ, so all longer windows do
            return 0
    again = np.flatnonzero(np.bincount(numbers)[numbers] > 1)
    edges = np.zeros(len(numbers) + window, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def counts_of(text: bytes) -> list[int]:
    """COUNTS of a text in UTF-8."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    number: dict[bytes, int] = {}
    numbers = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    times = np.bincount(numbers) if words else np.zeros(1, np.int64)
    distinct = list(number)
    marked = lambda has: int(sum(int(n) for w, n in zip(distinct, times) if has(w)))
    return [
        len(words),
        len(text.translate(None, SPACE + CONTINUED)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(numbers) if len(words) > WINDOW else 0,
        len(lines),
        len(distinct),
        int(times.max()),
        marked(lambda w: len(w) <= 4 and w.isalpha()),
        marked(lambda w: len(w) > 1 and w.isupper()),
        marked(lambda w: w[-1] in b".!?"),
    ]


def _measure(batches):
    for batch in batches:
        for part in slices(batch, 1):
            found = np.array([counts_of(t or b"") for t in part.column(1).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(found[:, k]) for k in range(len(COUNTS)))], ["doc_id", *COUNTS])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every row; a null text has no words.  Long texts are read whole."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_measure, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS))


def votes(rules: list[Rule] = RULES) -> list[Column]:
    """1 (good), -1 (bad) or 0 (abstains) for each rule."""
    return [(F.expr(rule.good).cast("int") - F.expr(rule.bad).cast("int")).alias(rule.name) for rule in rules]


def patterns(counts: DataFrame, rules: list[Rule] = RULES) -> tuple[np.ndarray, np.ndarray]:
    """Patterns of votes and how many rows have each: at most 3^R rows."""
    if 3 ** len(rules) > 1 << 21:
        raise ValueError("at most 13 rules: their patterns are fitted on the driver")
    found = counts.select(votes(rules)).groupBy(*[r.name for r in rules]).agg(F.count(F.lit(1)).alias("__rows")).toPandas()
    found = found.sort_values([r.name for r in rules], kind="stable")
    return found[[r.name for r in rules]].to_numpy(np.int8), found["__rows"].to_numpy(np.float64)


@dataclass(frozen=True)
class Model:
    """share: of good texts; rates[k] of rule k: how often it votes good on good texts, and on bad texts, where it votes."""

    share: float
    rates: np.ndarray

    def weights(self) -> np.ndarray:
        """Log odds that a good and a bad vote of each rule add."""
        good, bad = self.rates[:, 0], self.rates[:, 1]
        return np.stack([np.log(good / bad), np.log((1 - good) / (1 - bad))], axis=1)

    def odds(self, pattern: np.ndarray) -> np.ndarray:
        weight = self.weights()
        return np.log(self.share / (1 - self.share)) + (pattern == 1) @ weight[:, 0] + (pattern == -1) @ weight[:, 1]


#: Pseudo-votes of each rule: good and bad ones on good texts, good and bad ones on bad texts.  A rule is taken to be right about
#: good texts 49 times of 50; a bad text has one fault of several, so most rules are content with it.
FAITH = np.array([[98.0, 2.0], [14.0, 6.0]])
SHARE_FAITH = (17.0, 3.0)
ROUNDS, STILL = 500, 1e-9


def fit(pattern: np.ndarray, rows: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over patterns and their counts; the start is what FAITH says."""
    good_votes, bad_votes = (pattern == 1).astype(np.float64), (pattern == -1).astype(np.float64)
    start = FAITH[:, 0] / FAITH.sum(axis=1)
    model, last = Model(SHARE_FAITH[0] / sum(SHARE_FAITH), np.tile(start, (pattern.shape[1], 1))), -np.inf
    for _ in range(rounds):
        odds = model.odds(pattern)
        quality = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        rates = np.empty_like(model.rates)
        for side, weight in ((0, rows * quality), (1, rows * (1 - quality))):
            good, bad = weight @ good_votes + FAITH[side, 0], weight @ bad_votes + FAITH[side, 1]
            rates[:, side] = good / (good + bad)
        worse = rates[:, 0] < rates[:, 1]  # a bad vote would speak for quality: such a rule says nothing
        rates[worse] = rates[worse].mean(axis=1, keepdims=True)
        share = (rows @ quality + SHARE_FAITH[0]) / (rows.sum() + sum(SHARE_FAITH))
        model = Model(float(share), rates)
        now = log_posterior(model, pattern, rows)
        if abs(now - last) <= STILL * max(1.0, abs(now)):
            break
        last = now
    return model


def log_posterior(model: Model, pattern: np.ndarray, rows: np.ndarray) -> float:
    """What fit() climbs: the log-likelihood of all votes and of the pseudo-votes."""
    side = [np.log(s) + (pattern == 1) @ np.log(model.rates[:, k]) + (pattern == -1) @ np.log(1 - model.rates[:, k]) for k, s in ((0, model.share), (1, 1 - model.share))]
    faith = sum(FAITH[k, 0] * np.log(model.rates[:, k]).sum() + FAITH[k, 1] * np.log(1 - model.rates[:, k]).sum() for k in (0, 1))
    return float(rows @ np.logaddexp(*side) + faith + SHARE_FAITH[0] * np.log(model.share) + SHARE_FAITH[1] * np.log(1 - model.share))


def posterior(model: Model, rules: list[Rule] = RULES) -> Column:
    """The probability that a text is good, given its votes."""
    weight = model.weights()
    odds = F.lit(float(np.log(model.share / (1 - model.share))))
    for vote, (good, bad) in zip(votes(rules), weight):
        odds = odds + F.when(vote == 1, F.lit(float(good))).when(vote == -1, F.lit(float(bad))).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judge(docs: DataFrame, rules: list[Rule] = RULES, least: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, COUNTS, base_failed, p_good (the posterior), kept.

    A row is kept if the base does not fail it and its p_good is at least `least`.  Null and empty texts have no words and
    fail the base.  Repeated rows and null ids are judged like others.  An empty table gives an empty result; other columns
    are ignored, whatever their names.
    """
    counts = materialize(measure(docs), "quality-counts")
    model = fit(*patterns(counts, rules))
    told = counts.select("*", base_failed().alias("base_failed"), posterior(model, rules).alias("p_good"))
    return told.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))


def report(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", *COUNTS[:5], "base_failed", "kept", "p_good")
