"""Scalar functions of numbers, dates and labels as column expressions."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | str


def _col(c: Value) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- numbers -------------------------------------------------------------------
def finite(c: Value) -> Column:
    """NaN and infinities as null."""
    x = _col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def to_number(c: Value) -> Column:
    """Text as a number: thousands separators go, what isn't a finite number is null."""
    return finite(F.replace(F.trim(_col(c).cast("string")), F.lit(","), F.lit("")).try_cast("double"))


def to_bool(c: Value) -> Column:
    """Text as a boolean; anything unknown is null."""
    t = F.lower(F.trim(_col(c).cast("string")))
    return F.when(t.isin("true", "t", "1", "1.0", "yes", "y"), True).when(t.isin("false", "f", "0", "0.0", "no", "n"), False)


def log_return(now: Value, before: Value) -> Column:
    return F.ln(_col(now) / F.nullif(_col(before), F.lit(0.0)))


def percent_change(now: Value, before: Value) -> Column:
    return F.try_divide(_col(now), _col(before)) - 1


def share(part: Value, whole: Value) -> Column:
    """part / whole, null when whole is 0."""
    return F.try_divide(_col(part).cast("double"), _col(whole).cast("double"))


def close(a: Value, b: Value, atol: float = 1e-12, rtol: float = 0.0) -> Column:
    """Equal within tolerance; two nulls are equal, one is not."""
    x, y = _col(a), _col(b)
    return F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(y), x.isNull() & y.isNull())


def complete(cols) -> Column:
    """Every column holds a finite number."""
    return reduce(lambda p, q: p & q, (finite(c).isNotNull() for c in cols))


def round_even(c: Value, digits: int) -> Column:
    return F.bround(_col(c), digits)


# -- dates -----------------------------------------------------------------------
def to_day(c: Value, *formats: str) -> Column:
    """Text as a date by the first format that fits; null when none does."""
    t = F.trim(_col(c).cast("string"))
    return F.coalesce(*(F.to_date(F.try_to_timestamp(t, F.lit(f))) for f in formats or ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy")))


def to_moment(c: Value, *formats: str, zone: str = "UTC") -> Column:
    """Text as a UTC instant (timestamp without zone) by the first format that fits.

    Text that names an offset keeps its instant; text without one is local time of `zone`. Null when nothing fits.
    """
    t = F.trim(_col(c).cast("string"))
    with_offset = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    local = formats or ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy HH:mm", "dd/MM/yyyy")
    instants = [F.try_to_timestamp(t, F.lit(f)) for f in with_offset]
    locals_ = [F.to_utc_timestamp(F.try_to_timestamp(t, F.lit(f)), zone) for f in local]
    return F.coalesce(*instants, *locals_)


def in_zone(c: Value, zone: str) -> Column:
    """A UTC instant as the clock of `zone` shows it."""
    return F.from_utc_timestamp(_col(c), zone)


def midnight(c: Value) -> Column:
    """An instant's day at 00:00."""
    return F.date_trunc("day", _col(c))


def is_weekend(c: Value) -> Column:
    return F.weekday(_col(c)) >= 5


def age_days(day: Value, source: Value) -> Column:
    return F.datediff(_col(day), _col(source))


# -- labels ----------------------------------------------------------------------
def stars(p: Value) -> Column:
    x = _col(p)
    return F.when(x < 0.01, "***").when(x < 0.05, "**").when(x < 0.10, "*").otherwise("")


def significance(p: Value) -> Column:
    x = _col(p)
    return F.when(x.isNull(), "not available").when(x < 0.01, "significant at 1%").when(x < 0.05, "significant at 5%").when(x < 0.10, "significant at 10%").otherwise("not significant")


def rejects(p: Value, level: float = 0.05) -> Column:
    return F.coalesce(_col(p) < level, F.lit(False))


def sign_label(x: Value) -> Column:
    c = _col(x)
    return F.when(c.isNull(), "missing").when(c > 0, "positive").when(c < 0, "negative").otherwise("zero")


def same_sign(a: Value, b: Value) -> Column:
    """Whether signs agree; null when either is 0 or missing."""
    x, y = _col(a), _col(b)
    return F.when((x != 0) & (y != 0), F.signum(x) == F.signum(y))


def vif_band(x: Value) -> Column:
    c = _col(x)
    return F.when(c.isNull(), "missing").when(c < 5, "low").when(c < 10, "potential concern").otherwise("high")


def yes_no(c: Value) -> Column:
    return F.when(F.coalesce(_col(c), F.lit(False)), "Yes").otherwise("No")


def pass_fail(c: Value) -> Column:
    return F.when(F.coalesce(_col(c), F.lit(False)), "PASS").otherwise("FAIL")


def reasons(flags: dict[str, Column], none: str = "retained") -> Column:
    """Names of the flags that hold, joined with ';' in the given order."""
    joined = F.concat_ws(";", *(F.when(flag, name) for name, flag in flags.items()))
    return F.when(joined == "", none).otherwise(joined)


def any_of(flags) -> Column:
    return reduce(lambda p, q: p | q, (F.coalesce(f, F.lit(False)) for f in flags))


def all_of(flags) -> Column:
    return reduce(lambda p, q: p & q, (F.coalesce(f, F.lit(False)) for f in flags))


def count_of(flags) -> Column:
    return reduce(lambda p, q: p + q, (F.coalesce(f, F.lit(False)).cast("int") for f in flags))


def evidence(p: Value, of: str, level: float = 0.05) -> Column:
    """What a p-value says about an alternative, in words."""
    x = _col(p)
    return F.when(x.isNull(), "Not available").when(x < level, f"Evidence of {of}").otherwise(f"No evidence of {of} at the {level:.0%} level")


def kept_where(value: Value, condition: Column) -> Column:
    """The value where the condition holds, null elsewhere."""
    return F.when(condition, _col(value))


def last_of(default: str, rules: dict[str, Column]) -> Column:
    """A label by ordered overwriting: the last rule that holds wins."""
    out = F.lit(default)
    for label, rule in rules.items():
        out = F.when(F.coalesce(rule, F.lit(False)), label).otherwise(out)
    return out


def canonical(c: Value, aliases: dict[str, str]) -> Column:
    """Names by a table of aliases, whatever their case and the blanks around them; unknown ones raise when evaluated."""
    given = F.upper(F.trim(_col(c).cast("string")))
    known = F.from_json(F.lit(json.dumps({k.upper(): v for k, v in aliases.items()})), "map<string,string>")
    return F.coalesce(F.element_at(known, given), F.raise_error(F.concat(F.lit("no alias for "), F.coalesce(_col(c).cast("string"), F.lit("null")))))


def formula(target: str, predictors) -> str:
    """A readable regression formula."""
    return f"{target} ~ {' + '.join(predictors) or '1'}"


def effect_sentence(subject: Value, predictor: Value, spread: Value, effect: Value, coefficient: Value, p: Value) -> Column:
    """One sentence on what a spread of one standard deviation does."""
    e = _col(effect)
    word = F.when(e > 0, "rise").when(e < 0, "fall").otherwise("change")
    return F.format_string(
        "%s: one standard deviation more of %s (%.6f) goes with a %s of %.8f in the expected log return, about %.4f percentage points or %.2f basis points (coefficient %.6f, p %.4f).",
        _col(subject), _col(predictor), _col(spread), word, F.abs(e), F.abs(percentage_points(e)), F.abs(basis_points(e)), _col(coefficient), _col(p),
    )


# -- effects of log returns ------------------------------------------------------
def percentage_points(effect: Value) -> Column:
    return 100 * _col(effect)


def basis_points(effect: Value) -> Column:
    return 10_000 * _col(effect)


def exact_percent(effect: Value) -> Column:
    return 100 * F.expm1(_col(effect))


def coefficient_text(c: Value, p: Value) -> Column:
    return F.concat(F.format_string("%.4f", _col(c)), stars(p))


def error_text(c: Value) -> Column:
    return F.format_string("(%.4f)", _col(c))


def p_text(c: Value) -> Column:
    return F.when(_col(c) < 0.001, "<0.001").otherwise(F.format_string("%.3f", _col(c)))
