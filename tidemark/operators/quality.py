"""Data-quality checks: named expectations over frames, one aggregate per frame, and gates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import duplicate_keys, missing_keys

SCHEMA = "name string, expected string, actual string, passed boolean, category string, notes string"


@dataclass
class Checks:
    """Collects checks; `counts` checks of one frame share a single pass."""

    spark: SparkSession
    rows: list[tuple] = field(default_factory=list)

    def add(self, name: str, expected, actual, passed: bool, category: str = "", notes: str = "") -> None:
        self.rows.append((name, str(expected), str(actual), bool(passed), category, notes))

    def counts(self, df: DataFrame, bad: dict[str, Column], category: str = "") -> None:
        """No row may satisfy any of `bad`; nulls don't."""
        got = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in bad.items())).first().asDict()
        for name, n in got.items():
            self.add(name, 0, n, n == 0, category)

    def size(self, df: DataFrame, expected: int, name: str = "row count") -> None:
        n = df.count()
        self.add(name, expected, n, n == expected, "structure")

    def unique(self, df: DataFrame, keys: Sequence[str], name: str = "unique key") -> None:
        n = duplicate_keys(df, keys).count()
        self.add(name, 0, n, n == 0, "structure")

    def complete_grid(self, df: DataFrame, grid: DataFrame, keys: Sequence[str], name: str = "complete grid") -> None:
        lacking, extra = missing_keys(grid, df, keys).count(), missing_keys(df, grid, keys).count()
        self.add(name, "0 lacking, 0 extra", f"{lacking} lacking, {extra} extra", lacking == extra == 0, "structure")

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, SCHEMA)

    def gate(self) -> None:
        """Raise if any check failed."""
        failed = [r[0] for r in self.rows if not r[3]]
        if failed:
            raise AssertionError(f"{len(failed)} of {len(self.rows)} checks failed: {failed}")


def outside(c: str, low: float | None = None, high: float | None = None) -> Column:
    below, above = F.col(c) < low if low is not None else F.lit(False), F.col(c) > high if high is not None else F.lit(False)
    return below | above


def not_finite(c: str) -> Column:
    return F.isnan(c) | (F.abs(c) == float("inf"))


def looks_ahead(day: str, source: str, steps: int | None = None) -> Column:
    """Whether a source day is not before its row's day, or, with `steps`, not exactly that many days before."""
    late = F.col(source) >= F.col(day)
    return late | (F.datediff(F.col(day), F.col(source)) != steps) if steps is not None else late


def differs(stored: str, rebuilt: Column, atol: float = 1e-12, rtol: float = 0.0) -> Column:
    """Whether a stored value isn't the recomputed one, nulls being equal to nulls."""
    near = F.abs(F.col(stored) - rebuilt) <= atol + rtol * F.abs(rebuilt)
    return ~F.coalesce(near, F.col(stored).isNull() & rebuilt.isNull())


def audit(df: DataFrame, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """One row per rule: its kind, the rows it marks, and their share; one pass."""
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *(F.count_if(c).alias(k) for k, (_, c) in rules.items()))
    items = F.array(*(F.struct(F.lit(k).alias("measure"), F.lit(kind).alias("rule_type"), F.col(k).alias("n")) for k, (kind, _) in rules.items()))
    return wide.select("__n", F.inline(items)).select("measure", "rule_type", "n", F.when(F.col("__n") > 0, 100.0 * F.col("n") / F.col("__n")).alias("pct"))


def extremes(df: DataFrame, keys: Sequence[str], value: str, threshold: float, k: int) -> DataFrame:
    """Rows at or beyond `threshold` in size, with the k largest per key: flagged, never deleted."""
    from .series import top_per_group

    size = F.abs(F.col(value))
    top = top_per_group(df.where(F.col(value).isNotNull()), keys, [size.desc(), *df.columns], k).drop("position")
    return df.where(size >= threshold).unionByName(top).dropDuplicates()


def within(c: str, low: str, high: str, atol: float = 0.0) -> Column:
    """Whether a value lies between two columns, bounds included."""
    return F.col(c).between(F.col(low) - atol, F.col(high) + atol)


def rebuilt_lag(df: DataFrame, keys: Sequence[str], day: str, value: str, stored: str, steps: int = 1, atol: float = 1e-12) -> DataFrame:
    """Rows whose stored lag isn't the value `steps` rows earlier, with that value as `rebuilt`."""
    from pyspark.sql import Window

    again = df.withColumn("rebuilt", F.lag(value, steps).over(Window.partitionBy(*keys).orderBy(day)))
    return again.where(differs(stored, F.col("rebuilt"), atol))


def not_nested(df: DataFrame, inner: str, outer: str) -> DataFrame:
    """Rows in the inner sample that the outer one lacks: none where samples are nested."""
    return df.where(F.coalesce(inner, F.lit(False)) & ~F.coalesce(outer, F.lit(False)))


def disagreement(left: DataFrame, right: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Keys whose membership two stages see differently; a stage that lacks a key counts as no."""
    both = left.select(*keys, F.col(flag).alias("in_left")).join(right.select(*keys, F.col(flag).alias("in_right")), list(keys), "full")
    l, r = F.coalesce("in_left", F.lit(False)), F.coalesce("in_right", F.lit(False))  # noqa: E741
    return both.where(l != r).select(*keys, l.alias("in_left"), r.alias("in_right"))


def same_days(frames: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """For each frame the keys it has, and those of the others' union that it lacks: 0 where all use the same."""
    tagged = None
    for name, df in frames.items():
        one = df.select(*keys).distinct().withColumn("frame", F.lit(name))
        tagged = one if tagged is None else tagged.unionByName(one)
    held = tagged.groupBy(*keys).agg(F.collect_set("frame").alias("frames"))
    counts = held.agg(*(F.count_if(F.array_contains("frames", n)).alias(n) for n in frames), F.count(F.lit(1)).alias("__all"))
    items = F.array(*(F.struct(F.lit(n).alias("frame"), F.col(n).alias("n_keys"), (F.col("__all") - F.col(n)).alias("n_lacking")) for n in frames))
    return counts.select(F.inline(items))


def model_rules() -> dict[str, Column]:
    """What no row of a coefficient table may show."""
    missing = lambda c: F.coalesce(~(F.abs(c) < float("inf")), F.lit(True))
    return {
        "coefficient not finite": missing("coefficient"),
        "error not positive": F.coalesce(~(F.col("se") > 0), F.lit(True)),
        "p outside 0 to 1": F.coalesce(~F.col("p_value").between(0, 1), F.lit(True)),
        "interval without coefficient": ~F.coalesce(F.col("coefficient").between(F.col("ci_low"), F.col("ci_high")), F.lit(False)),
        "r2 outside 0 to 1": F.coalesce(~F.col("r2").between(0, 1), F.lit(True)),
        "too few rows": F.col("n") <= F.col("n_parameters"),
    }


def scoring_rules(labels: Sequence[str] = ("negative", "neutral", "positive"), atol: float = 1e-5) -> dict[str, Column]:
    """What no row of scored texts may show: probabilities out of bounds or not adding up, labels that aren't the likeliest."""
    probs = [F.col(f"prob_{x}") for x in labels]
    out = F.lit(False)
    for p in probs:
        out = out | F.coalesce(~p.between(0, 1), F.lit(True))
    total = probs[0]
    for p in probs[1:]:
        total = total + p
    chosen = F.lit(None).cast("double")
    for x, p in zip(labels, probs, strict=True):
        chosen = F.when(F.col("score_label") == x, p).otherwise(chosen)
    return {
        "probability outside 0 to 1": out,
        "probabilities don't add up": F.coalesce(F.abs(total - 1) > atol, F.lit(True)),
        "unknown label": ~F.coalesce(F.col("score_label").isin(*labels), F.lit(False)),
        "label not the likeliest": F.coalesce(chosen < F.greatest(*probs) - atol, F.lit(True)),
        "score outside -1 to 1": F.coalesce(~F.col("sentiment_score").between(-1, 1), F.lit(True)),
    }


def gate_status(checks: DataFrame, by: str = "category") -> DataFrame:
    """Per stage or category: checks, failures, and whether it may go on."""
    failed = F.count_if(~F.coalesce("passed", F.lit(False)))
    return checks.groupBy(by).agg(F.count(F.lit(1)).alias("n_checks"), failed.alias("n_failed")).withColumn("passed", F.col("n_failed") == 0)


def require_passed(checks: DataFrame, stage: str = "upstream") -> DataFrame:
    """`checks`, if it has rows and all passed; else an error: a stage publishes only after those before it passed."""
    failed = checks.where(~F.coalesce("passed", F.lit(False))).select("name").limit(20).collect()
    if failed or checks.isEmpty():
        raise AssertionError(f"{stage}: {[r[0] for r in failed] or 'no checks'}")
    return checks
