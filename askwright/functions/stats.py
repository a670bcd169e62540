"""Column functions for measurement: intervals, paired tests, sample sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.959963984540054


def wilson(k: Column, n: Column, upper: bool) -> Column:
    """Bound of the Wilson interval of k out of n; nothing measured: 0 or 1."""
    k, n = k.cast("double"), n.cast("double")
    p = k / n
    centre = p + Z * Z / (2 * n)
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    bound = (centre + half if upper else centre - half) / (1 + Z * Z / n)
    return F.when(n <= 0, 1.0 if upper else 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), bound)))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c discordant pairs; logarithms keep large counts in range."""
    n, k = b + c, F.least(b, c)
    n, k = n.cast("double"), k.cast("long")
    first = F.struct((-n * F.log(F.lit(2.0))).alias("log"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))

    def step(acc: Column, i: Column) -> Column:  # from i - 1 to i: times (n - i + 1) / i
        log = acc["log"] + F.log((n - i + 1) / i)
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.expr("cast(array() as array<bigint>)"))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(steps, first, step)["sum"]))


def tickets_needed(p: Column, most: int = 5000) -> Column:
    """Least number of tickets, all of them right, whose upper bound of error is at most p."""
    enough = F.filter(F.sequence(F.lit(1), F.lit(most)), lambda n: (Z * Z / (n + Z * Z)) <= p)
    return F.element_at(enough, 1)


def expected_list(raw: Column) -> Column:
    """Labels of a cell: null is unlabelled, a none-word is the empty list, else distinct ids by '|' in order."""
    parts = F.array_distinct(F.filter(F.transform(F.split(raw, r"\|"), lambda x: F.trim(x)), lambda x: x != ""))
    word = F.lower(F.trim(raw))
    return F.when(raw.isNull() | (word == ""), F.lit(None)).when(word.isin("none", "aucune", "aucun", "no", "-", "n/a", "na"), F.expr("cast(array() as array<string>)")).otherwise(parts)


def cost(tokens_in: Column, tokens_out: Column, price_in: float = 2.5, price_out: float = 10.0) -> Column:
    return (tokens_in * price_in + tokens_out * price_out) / 1e6
