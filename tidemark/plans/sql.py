"""Pieces of DuckDB SQL for the statistics that it has no function for: tails by Simpson's rule, R2 by orthogonalisation."""

from __future__ import annotations

from collections.abc import Sequence

from .base import CHANGES_SQL


def _integral(upper: str, density: str, steps: int) -> str:
    """The integral of `density` (of s) from 0 to `upper`."""
    at = f"({upper} * i / {steps}.0)"
    weight = f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return f"(list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * {density.replace('$s', at)})) * {upper} / {3 * steps}.0)"


def normal_half(z: str) -> str:
    """P(0 < Z < |z|)."""
    return _integral(f"least(abs({z}), 12.0)", "exp(-0.5 * $s ** 2) / sqrt(2 * pi())", 400)


def normal_two_sided(z: str) -> str:
    return f"greatest(0.0, 1 - 2 * {normal_half(z)})"


def normal_upper(z: str) -> str:
    return f"(0.5 - sign({z}) * {normal_half(z)})"


def t_two_sided(t: str, v: str) -> str:
    density = f"exp(lgamma(({v} + 1) / 2) - lgamma({v} / 2) - ({v} + 1) / 2 * ln(1 + $s ** 2 / {v})) / sqrt({v} * pi())"
    return f"greatest(0.0, 1 - 2 * {_integral(f'least(abs({t}), 60.0)', density, 2000)})"


def chi2_upper(x: str, d: str) -> str:
    density = f"2 * $s ** ({d} - 1) * exp(0 - $s ** 2 / 2 - {d} / 2 * ln(2) - lgamma({d} / 2))"
    return f"greatest(0, 1 - {_integral(f'least(sqrt({x}), 40.0)', density, 2000)})"


def f_upper(x: str, d: str, e: str) -> str:
    density = f"2 * $s ** ({d} - 1) * exp({d} / 2 * ln({d} / {e}) - ({d} + {e}) / 2 * ln(1 + {d} * $s ** 2 / {e}) + lgamma(({d} + {e}) / 2) - lgamma({d} / 2) - lgamma({e} / 2))"
    return f"greatest(0, 1 - {_integral(f'least(sqrt({x}), 40.0)', density, 2000)})"


def stars(p: str) -> str:
    return f"CASE WHEN {p} < 0.01 THEN '***' WHEN {p} < 0.05 THEN '**' WHEN {p} < 0.10 THEN '*' ELSE '' END"


def r_squared(name: str, source: str, y: str, xs: Sequence[str], key: str = "asset") -> str:
    """Common table expressions that end in `name`(key, n, k, r2): y on xs and a constant, by modified Gram-Schmidt."""
    own = f"OVER (PARTITION BY {key})"
    k = len(xs)
    columns = [f"{e} - avg({e}) {own} AS {c}" for c, e in [("y", y), *((f"x{i}", x) for i, x in enumerate(xs))]]
    steps = [f"{name}_0 AS (SELECT {key}, {', '.join(columns)} FROM {source})"]
    for j in range(k):
        rest = [f"x{i} - sum(x{i} * x{j}) {own} / nullif(sum(x{j} * x{j}) {own}, 0) * x{j} AS x{i}" if i > j else f"x{i}" for i in range(k)]
        steps.append(f"{name}_{j + 1} AS (SELECT {key}, y, {', '.join(rest)} FROM {name}_{j})")
    explained = " + ".join(f"sum(y * x{i}) ** 2 / sum(x{i} * x{i})" for i in range(k))
    steps.append(f"{name} AS (SELECT {key}, count(*)::DOUBLE AS n, {k}::DOUBLE AS k, ({explained}) / sum(y * y) AS r2 FROM {name}_{k} GROUP BY {key})")
    return ", ".join(steps)


LAGS = range(1, 8)
HAC = "sum(s * s) + 2 * (" + " + ".join(f"{1 - k / 8} * sum(coalesce(s * s{k}, 0))" for k in LAGS) + ")"
LAGGED = ", ".join(f"lag(s, {k}) OVER w AS s{k}" for k in LAGS)

#: Sums of the return's two models on one sample: on its own lag (M0), and on that of activity too (M1).
SUITE = f"""{CHANGES_SQL}, s AS (SELECT asset, day, ret AS y, ret_lag AS x1, activity_lag AS x2 FROM r WHERE ret IS NOT NULL AND ret_lag IS NOT NULL AND activity_lag IS NOT NULL),
mid AS (SELECT *, y - avg(y) OVER p AS yc, x1 - avg(x1) OVER p AS a, x2 - avg(x2) OVER p AS b FROM s WINDOW p AS (PARTITION BY asset)),
g AS (SELECT asset, count(*)::DOUBLE AS n, sum(a * a) AS saa, sum(b * b) AS sbb, sum(a * b) AS sab, sum(a * yc) AS say, sum(b * yc) AS sby, sum(yc * yc) AS syy, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM mid GROUP BY 1),
k AS (SELECT *, saa * sbb - sab * sab AS det, say / saa AS b0, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS b1, (saa * sby - sab * say) / (saa * sbb - sab * sab) AS b2 FROM g),
e AS (SELECT mid.*, n, m1, m2, saa, sbb, sab, det, yc - b0 * a AS u0, yc - b1 * a - b2 * b AS u1 FROM mid JOIN k USING (asset)),
ssr AS (SELECT asset, sum(u0 * u0) AS ssr0, sum(u1 * u1) AS ssr1 FROM e GROUP BY 1),
infl AS (SELECT asset, day, 'M0' AS model, 'ret_lag' AS parameter, a / saa * u0 AS s FROM e
 UNION ALL SELECT asset, day, 'M0', 'const', (1 / n - m1 * a / saa) * u0 FROM e
 UNION ALL SELECT asset, day, 'M1', 'ret_lag', (sbb * a - sab * b) / det * u1 FROM e
 UNION ALL SELECT asset, day, 'M1', 'activity_lag', (saa * b - sab * a) / det * u1 FROM e
 UNION ALL SELECT asset, day, 'M1', 'const', (1 / n - m1 * (sbb * a - sab * b) / det - m2 * (saa * b - sab * a) / det) * u1 FROM e),
v AS (SELECT asset, model, parameter, {HAC} AS hac FROM (SELECT *, {LAGGED} FROM infl WINDOW w AS (PARTITION BY asset, model, parameter ORDER BY day)) GROUP BY 1, 2, 3),
coef AS (SELECT asset, 'M0' AS model, 'ret_lag' AS parameter, b0 AS coefficient, 1 / saa AS inverse FROM k
 UNION ALL SELECT asset, 'M0', 'const', my - b0 * m1, 1 / n + m1 * m1 / saa FROM k
 UNION ALL SELECT asset, 'M1', 'ret_lag', b1, sbb / det FROM k
 UNION ALL SELECT asset, 'M1', 'activity_lag', b2, saa / det FROM k
 UNION ALL SELECT asset, 'M1', 'const', my - b1 * m1 - b2 * m2, 1 / n + (m1 * m1 * sbb - 2 * m1 * m2 * sab + m2 * m2 * saa) / det FROM k),
suite AS (SELECT asset, model, parameter, coefficient, n, hac, inverse, CASE model WHEN 'M0' THEN 2 ELSE 3 END AS p, CASE model WHEN 'M0' THEN ssr0 ELSE ssr1 END AS ssr, syy FROM coef JOIN v USING (asset, model, parameter) JOIN g USING (asset) JOIN ssr USING (asset)),
fitted AS (SELECT *, sqrt(hac * n / (n - p)) AS se, 1 - ssr / syy AS r2, coefficient / sqrt(hac * n / (n - p)) AS z FROM suite)"""


def last_coefficient(name: str, source: str, y: str, xs: Sequence[str], keys: Sequence[str] = ("asset",)) -> str:
    """Common table expressions that end in `name`(keys, n, k, r2, coefficient, se, z): the last of `xs`, with HAC errors."""
    key, k = ", ".join(keys), len(xs)
    own, last = f"OVER (PARTITION BY {key})", f"x{k - 1}"
    columns = [f"{e} - avg({e}) {own} AS {c}" for c, e in [("y", y), *((f"x{i}", x) for i, x in enumerate(xs))]]
    steps = [f"{name}_0 AS (SELECT {key}, day, {', '.join(columns)} FROM {source})"]
    for j in range(k):
        rest = [f"x{i} - sum(x{i} * x{j}) {own} / nullif(sum(x{j} * x{j}) {own}, 0) * x{j} AS x{i}" if i > j else f"x{i}" for i in range(k)]
        steps.append(f"{name}_{j + 1} AS (SELECT {key}, day, y, {', '.join(rest)} FROM {name}_{j})")
    fitted = " - ".join(f"sum(y * x{i}) {own} / sum(x{i} * x{i}) {own} * x{i}" for i in range(k))
    steps.append(f"{name}_u AS (SELECT *, y - {fitted} AS u FROM {name}_{k})")
    steps.append(f"{name}_s AS (SELECT *, {last} / sum({last} * {last}) {own} * u AS s FROM {name}_u)")
    steps.append(f"{name}_l AS (SELECT *, {LAGGED} FROM {name}_s WINDOW w AS (PARTITION BY {key} ORDER BY day))")
    steps.append(
        f"{name} AS (SELECT *, coefficient / se AS z FROM (SELECT {key}, count(*)::DOUBLE AS n, {k}::DOUBLE AS k, 1 - sum(u * u) / sum(y * y) AS r2, sum(y * {last}) / sum({last} * {last}) AS coefficient, sqrt(({HAC}) * count(*) / (count(*) - {k + 1})) AS se FROM {name}_l GROUP BY {key}))"
    )
    return ", ".join(steps)
