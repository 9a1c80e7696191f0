"""Wear, diagnosis and service distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight of a symptom that a cause doesn't show, and the share of a cause's weight that wear doesn't touch.
UNSEEN, NEW = 0.03, 0.25


def wear(km: Column, life: Column, shape: float = 2.0) -> Column:
    """Probability of having failed by km (Weibull)."""
    return 1 - F.exp(-F.pow(km / life, F.lit(shape)))


def diagnose(shown: DataFrame, causes: DataFrame, worn: Column) -> DataFrame:
    """(case, cause, posterior), summing to 1 in each case: the product of the weights of all symptoms shown, UNSEEN where
    the cause lacks one, times NEW + (1 - NEW) * worn. shown: case, symptom (distinct); causes: symptom, cause, weight (unique).

    A product is a sum of logarithms, so symptoms are combined before they shuffle.
    """
    n = shown.groupBy("case").agg(F.count(F.lit(1)).alias("n"))
    fit = shown.join(causes, "symptom").groupBy("case", "cause").agg(F.sum(F.ln("weight")).alias("logs"), F.count(F.lit(1)).alias("seen"))
    score = F.exp("logs") * F.pow(F.lit(UNSEEN), F.col("n") - F.col("seen")) * (NEW + (1 - NEW) * worn)
    scored = fit.join(n, "case").select("case", "cause", score.alias("score"))
    whole = scored.groupBy("case").agg(F.sum("score").alias("whole"))
    return scored.join(whole, "case").select("case", "cause", (F.col("score") / F.col("whole")).alias("posterior"))


def km_estimate(year: Column, newest: Column) -> Column:
    """15 000 km a year and half of one, 5 000 at least; 60 000 where the year is unknown."""
    return F.when(year.isNull(), F.lit(60000)).otherwise(F.greatest(F.lit(5000), F.bround((newest - year + 0.5) * 15000).cast("int"))).cast("long")


def milestones(km: Column, n: int = 8, step: int = 10_000) -> Column:
    """The nearest multiple of step (one step at least) and those after it."""
    first = F.greatest(F.lit(step), (F.bround(km / step) * step).cast("long"))
    return F.sequence(first, first + (n - 1) * step, F.lit(step).cast("long"))
