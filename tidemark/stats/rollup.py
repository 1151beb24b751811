"""What several models' results say together: stability across models, added fit, decisions, and compact roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import rejects

LEVEL = 0.05


def coefficient_stability(suite: DataFrame, parameter: str, base: str, extended: str, keys: Sequence[str]) -> DataFrame:
    """One parameter in two nested models: both coefficients, their difference, and it in percent of the first's size."""
    of = lambda m, n: suite.where((F.col("parameter") == parameter) & (F.col("model") == m)).select(*keys, F.col("coefficient").alias(n))
    both = of(base, "base").join(of(extended, "extended"), list(keys))
    change = F.col("extended") - F.col("base")
    return both.withColumns({"difference": change, "change_pct": F.when(F.col("base") != 0, 100 * change / F.abs("base"))})


def incremental_fit(suite: DataFrame, base: str, extended: str, keys: Sequence[str]) -> DataFrame:
    """R2 and adjusted R2 of two models per key, and what the second adds."""
    of = lambda m, s: suite.where(F.col("model") == m).groupBy(*keys).agg(F.max("r2").alias(f"r2_{s}"), F.max("adj_r2").alias(f"adj_r2_{s}"))
    both = of(base, "base").join(of(extended, "extended"), list(keys))
    return both.withColumns({"change_r2": F.col("r2_extended") - F.col("r2_base"), "change_adj_r2": F.col("adj_r2_extended") - F.col("adj_r2_base")})


def diagnostic_flags(tests: DataFrame, keys: Sequence[str], level: float = LEVEL) -> DataFrame:
    """Per key: whether the residual tests speak of heteroscedasticity, of serial correlation, and so for HAC errors."""
    hit = lambda *starts: F.bool_or(rejects("p_value", level) & ~F.col("test").endswith(" F") & F.col("test").rlike("^(" + "|".join(starts) + ")"))
    got = tests.groupBy(*keys).agg(hit("Breusch-Pagan", "White").alias("heteroscedastic"), hit("Breusch-Godfrey", "Ljung-Box").alias("serially_correlated"), hit("Jarque-Bera").alias("not_normal"))
    return got.withColumn("hac_supported", F.col("heteroscedastic") | F.col("serially_correlated"))


HYPOTHESIS = ("hypothesis", "subject", "test_type", "effect", "se", "statistic", "p_value", "supported", "decision_rule")


def association(name: Column, subject: Column, fitted: DataFrame, level: float = LEVEL) -> DataFrame:
    """In-sample: the coefficient differs from zero. `fitted` has coefficient, se, stat, p_value."""
    return fitted.select(name.alias("hypothesis"), subject.alias("subject"), F.lit("in-sample association").alias("test_type"), F.col("coefficient").alias("effect"), "se", F.col("stat").alias("statistic"), "p_value", rejects("p_value", level).alias("supported"), F.lit("two-sided p < 0.05").alias("decision_rule"))


def improvement(name: Column, subject: Column, compared: DataFrame, level: float = LEVEL) -> DataFrame:
    """Out of sample: a lower error and a one-sided test. `compared` has mean, se, z, p_value, better."""
    supported = F.coalesce("better", F.lit(False)) & rejects("p_value", level)
    return compared.select(name.alias("hypothesis"), subject.alias("subject"), F.lit("out-of-sample forecast").alias("test_type"), F.col("mean").alias("effect"), "se", F.col("z").alias("statistic"), "p_value", supported.alias("supported"), F.lit("lower error and one-sided p < 0.05").alias("decision_rule"))


def difference(name: Column, subject: Column, pooled: DataFrame, level: float = LEVEL) -> DataFrame:
    """Pooled: the interaction differs from zero."""
    return association(name, subject, pooled, level).withColumn("test_type", F.lit("pooled difference"))


def any_significant(results: DataFrame, check: str, keys: Sequence[str], level: float = LEVEL) -> DataFrame:
    """Per key whether any of the results' p-values is significant, and in words."""
    found = F.bool_or(rejects("p_value", level))
    text = F.when(F.col("significant"), "at least one significant at 5%").otherwise("none significant at 5%")
    got = results.groupBy(*keys).agg(F.count("p_value").alias("n_results"), found.alias("significant"))
    return got.select(*keys, F.lit(check).alias("robustness_check"), "n_results", "significant", text.alias("finding"))
