"""Plan-time helpers over a frame's columns: nothing here runs a job."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions.scalar import complete, finite


def require_columns(df: DataFrame, columns: Iterable[str], name: str = "frame") -> DataFrame:
    """`df`, if it has all `columns`; else an error that names those missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks {missing}; it has {df.columns}")
    return df


def resolve_column(df: DataFrame, candidates: Sequence[str], what: str = "column") -> str:
    """The first of `candidates` that `df` has."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"no {what} among {list(candidates)}; the frame has {df.columns}")


def null_missing(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every floating-point column."""
    return df.withColumns({f.name: finite(f.name).cast(f.dataType) for f in df.schema if isinstance(f.dataType, DoubleType | FloatType)})


def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*(c for c in columns if c in df.columns))


def select_safe(df: DataFrame, keys: Sequence[str], tokens: Sequence[str], forbidden: Sequence[str] = ()) -> DataFrame:
    """Key columns and those whose names hold one of `tokens`, none of `forbidden`: only what was known beforehand."""
    low = lambda c: c.lower()
    keep = [c for c in df.columns if c in keys or (any(t in low(c) for t in tokens) and not any(f in low(c) for f in forbidden))]
    return df.select(*keep)


def forbid_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    found = sorted(set(df.columns) & set(names))
    if found:
        raise ValueError(f"forbidden columns: {found}")
    return df


def leaks_target(predictors: Iterable[str], target: str) -> list[str]:
    """Predictors whose names say that they hold the target of the same day."""
    return [p for p in predictors if p == target or (target.lower() in p.lower() and "lag" not in p.lower())]


def unique_names(names: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(names))


def sample_flags(df: DataFrame, samples: dict[str, Sequence[str]]) -> DataFrame:
    """A boolean column per sample: target and predictors are all there and finite."""
    return df.withColumns({name: complete(cols) for name, cols in samples.items()})


def listwise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(complete(columns))


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str = "variable", value: str = "value") -> DataFrame:
    return df.select(*ids, *(F.col(v).cast("double").alias(v) for v in values)).unpivot(list(ids), list(values), variable, value)


def order_by_list(column: str, order: Sequence[str]) -> Column:
    """A sort key that follows a given list."""
    return F.array_position(F.array(*(F.lit(x) for x in order)), F.col(column))
