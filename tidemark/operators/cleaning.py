"""Text rows to a cleaned, flagged table with a decision and its reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scalar import any_of, reasons
from .series import duplicates

#: Flags that exclude a row, in the order in which reasons are named; the rest are diagnostic.
EXCLUDING = ("unusable", "crosspost", "promotional", "recurring_template", "exact_duplicate", "link_only")


def clean(df: DataFrame, title: str, body: str) -> DataFrame:
    """Adds title_clean, body_clean, analysis_text (both), matching_key and letters."""
    out = df.withColumns({"title_clean": T.clean_text(title), "body_clean": T.clean_text(body)})
    out = out.withColumn("analysis_text", T.combine("title_clean", "body_clean"))
    return out.withColumns({"matching_key": T.matching_key("analysis_text"), "letters": T.letter_count("analysis_text")})


def flag(df: DataFrame, title: str, body: str, group: Sequence[str], order: Sequence[str], url: Column, parent: Column, least_letters: int = 3, many: int = 5) -> DataFrame:
    """Adds every flag, exclude, retain and reason. `order` must be unique: the first of equal texts stays."""
    out = duplicates(df, [*group, "matching_key"], order, F.col("matching_key") != "")
    flags = {
        "empty": T.strip("analysis_text") == "",
        "deleted": T.is_placeholder(title) | T.is_placeholder(body),
        "too_short": F.col("letters") < least_letters,
    }
    out = out.withColumns({f"flag_{k}": v for k, v in flags.items()})
    more = {
        "unusable": F.col("flag_empty") | F.col("flag_deleted") | F.col("flag_too_short"),
        "crosspost": T.present(parent),
        "promotional": T.matches_any("analysis_text", T.PROMOTIONAL),
        "recurring_template": T.matches_any(title, T.RECURRING),
        "exact_duplicate": F.col("later_copy"),
        "link_only": (T.safe_text(url) != "") & (F.col("letters") < least_letters),
        "repeated": F.col("copies") >= many,
    }
    out = out.withColumns({f"flag_{k}": v for k, v in more.items()})
    excluding = {k: F.col(f"flag_{k}") for k in EXCLUDING}
    return out.withColumns({"exclude": any_of(excluding.values()), "reason": reasons(excluding)}).withColumn("retain", ~F.col("exclude"))
