"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score. DataFrame functions only.

A kind's pattern is marked in the text in one pass (\\u0001 before and \\u0002 after each leftmost match), the text is
split at the marks, and the parts' lengths give the spans: code points, end exclusive. The patterns are possessive
where that changes no match, so that Java's matcher neither recurses nor backtracks over long runs, and those that
begin with a run are tried at its start alone (or where the last match ended): what follows the run decides for all of
its places, and a long run is read once.

Base kinds (email, ip, card, phone) always stay once their check passes. Beyond them, `iban` (confirmed by mod-97) and
`ssn` are kept when the score reaches `THRESHOLD`. Score: the kind's base, plus its checksum, plus a context word
within `REACH` code points before or after the span.

Null texts count as empty: no spans. Rows pass through one by one, so repeated or null doc_ids and empty tables need no
rule. In redact(), other columns, whatever their names, pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

REACH, THRESHOLD = 40, 80
SPAN = "array<struct<s:int,k:int,e:int,score:int>>"


@dataclass(frozen=True)
class Kind:
    name: str
    hint: str  # a cheap test that every text with a match passes
    pattern: str
    score: int  # base and checksum
    context: str  # words nearby that add to the score
    bonus: int


_EDGE, _END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_RUN, _DIGITS = r"(?:\G|(?<![A-Za-z0-9._%+-]))", "(?<![0-9])"
#: The order is that of ties at one start.
KINDS = (
    Kind("email", "@", rf"{_RUN}[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 80, "e-?mail|contact|write|mailto", 10),
    Kind("ip", r"[0-9]\.[0-9]", rf"{_DIGITS}[0-9]++(?:\.[0-9]++){{3}}", 60, r"(?<![a-z0-9_])ip(?![a-z0-9_])|address|host|server", 20),
    Kind("card", "[0-9]", r"[0-9](?:[\x20-]?+[0-9])++", 90, "card|visa|mastercard|credit|payment", 10),
    Kind("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", 70, "phone|call|tel|mobile|fax", 20),
    Kind("iban", "[A-Z]{2}[0-9]{2}", rf"{_EDGE}[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}{_END}", 90, "iban|account|bank|konto|cuenta|compte", 10),
    Kind("ssn", "[0-9]-[0-9]", rf"{_EDGE}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_END}", 40, "ssn|social security|tax id", 45),
)
BASE = 4


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def mod97(iban: Column) -> Column:
    """An IBAN's remainder: first four characters last, letters as 10 to 35."""
    bare = F.translate(iban, " ", "")
    turned = F.split(F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4)), "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97)
    return F.aggregate(turned, F.lit(0), step)


def valid(kind: Kind, m: Column) -> Column:
    if kind.name == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind.name == "card":
        return F.length(digits(m)).between(14, 19) & F.call_function("luhn_check", digits(m))
    if kind.name == "phone":
        return F.length(digits(m)).between(10, 15)
    if kind.name == "iban":
        return mod97(m) == 1
    return F.lit(True)


def spans_of(at: int, text: Column) -> Column:
    """The spans of kind number `at` in `text`, an array of structs; a kind's hint spares most texts the work."""
    kind = KINDS[at]
    marked = F.regexp_replace(F.translate(text, "\u0001\u0002", "\u0003\u0003"), kind.pattern, "\u0001$0\u0002")

    def add(acc: Column, part: Column) -> Column:
        m = F.substring_index(part, "\u0002", 1)
        start, end = acc["p"], acc["p"] + F.length(m)
        near = F.concat_ws(" ", F.substring(text, F.greatest(start + 1 - REACH, F.lit(1)), F.least(start, F.lit(REACH))), F.substring(text, end + 1, F.lit(REACH)))
        score = F.lit(kind.score) + F.when(F.lower(near).rlike(kind.context), kind.bonus).otherwise(0)
        span = F.struct(start.alias("s"), F.lit(at).alias("k"), end.alias("e"), score.alias("score"))
        keep = valid(kind, m) if at < BASE else valid(kind, m) & (score >= THRESHOLD)
        return F.struct((acc["p"] + F.length(part) - 1).alias("p"), F.when(keep, F.array_append(acc["o"], span)).otherwise(acc["o"]).alias("o"))

    def walk(parts: Column) -> Column:
        zero = F.struct(F.length(parts[0]).alias("p"), F.array().cast(SPAN).alias("o"))
        return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), zero, add, lambda acc: acc["o"])

    found = let(F.split(marked, "\u0001"), walk)
    hint = F.contains(text, F.lit("@")) if kind.hint == "@" else text.rlike(kind.hint)
    return F.when(hint, found).otherwise(F.array().cast(SPAN))


def with_spans(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """Adds `out`: every kept span, sorted by start, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(out, F.array_sort(F.concat(*(spans_of(k, text) for k in range(len(KINDS))))))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k.name) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"], x["e"])), ",")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, their digest, all spans and the best score, one row per row of `docs`."""
    found = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "found")
    of_kind = lambda k: F.size(F.filter("found", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(of_kind(k).alias(f"n_{KINDS[k].name}") for k in range(BASE)),
        F.sha2(_joined(F.filter("found", lambda x: x["k"] < BASE)).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0)).cast("long").alias("top_score"),
    )


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """`docs` with every span replaced by its kind in angle brackets, and `length_col`, if given, following the text.

    Where spans overlap, the one that starts first (the longer of two) is named and all are covered.
    """
    mine = "__spans"
    while mine in docs.columns:
        mine += "_"
    found = with_spans(docs, text_col, mine)
    text, spans = F.coalesce(F.col(text_col), F.lit("")), F.col(mine)
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("n"), x["k"].alias("k"))))
    names = F.array(*(F.lit(f"<{k.name.upper()}>") for k in KINDS))

    def add(acc: Column, x: Column) -> Column:
        piece = F.array(F.substring(text, acc["p"] + 1, x["s"] - acc["p"]), names[x["k"]])
        inside = x["s"] < acc["p"]
        return F.struct(F.greatest(acc["p"], -x["n"]).alias("p"), F.when(inside, acc["o"]).otherwise(F.concat(acc["o"], piece)).alias("o"))

    zero = F.struct(F.lit(0).alias("p"), F.array().cast("array<string>").alias("o"))
    clean = F.aggregate(ordered, zero, add, lambda acc: F.array_join(F.concat(acc["o"], F.array(F.substring(text, acc["p"] + 1, F.length(text)))), ""))
    out = found.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(F.col(text_col)))
    if length_col:
        out = out.withColumn(length_col, F.when(F.size(spans) > 0, F.length(text_col)).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)


def oracle_sql() -> str:
    """detect() in DuckDB SQL; the patterns without possessive quantifiers and run starts, word edges as \\b."""
    plain = lambda p: p.removeprefix(_RUN).removeprefix(_DIGITS).replace("++", "+").replace("?+", "?").replace(_EDGE, r"\b").replace(_END, r"\b").replace("(?<![a-z0-9_])ip(?![a-z0-9_])", r"\bip\b")
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN CAST({digits}[length({digits}) - i + 1] AS INTEGER) * (1 + (i - 1) % 2) > 9 THEN CAST({digits}[length({digits}) - i + 1] AS INTEGER) * (1 + (i - 1) % 2) - 9 ELSE CAST({digits}[length({digits}) - i + 1] AS INTEGER) * (1 + (i - 1) % 2) END)) % 10 = 0"
    bare = "replace(m, ' ', '')"
    turned = f"({bare}[5:] || {bare}[1:4])"
    values = f"list_transform(range(1, length({turned}) + 1), lambda i: CASE WHEN {turned}[i] BETWEEN '0' AND '9' THEN ascii({turned}[i]) - 48 ELSE ascii({turned}[i]) - 55 END)"
    check = {
        "ip": "list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND CAST('0' || right(ltrim(p, '0'), 3) AS INTEGER) <= 255))",
        "card": f"length({digits}) BETWEEN 14 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
        "iban": f"list_reduce(list_prepend(0, {values}), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1",
    }
    parts = []
    for k, kind in enumerate(KINDS):
        near = f"lower(substring(t, greatest(s + 1 - {REACH}, 1), least(s, {REACH})) || ' ' || substring(t, e + 1, {REACH}))"
        score = f"{kind.score} + CASE WHEN regexp_matches({near}, '{plain(kind.context)}') THEN {kind.bonus} ELSE 0 END"
        places = f"SELECT rid, t, ms[i] AS m, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM (SELECT rid, t, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT rid, t, regexp_extract_all(t, '{plain(kind.pattern)}') AS ms, regexp_split_to_array(t, '{plain(kind.pattern)}') AS gs FROM d))"
        limit = "" if k < BASE else f" WHERE score >= {THRESHOLD}"
        parts.append(f"SELECT rid, {k} AS k, '{kind.name}' AS kind, s, e, score FROM (SELECT *, {score} AS score FROM (SELECT *, s + length(m) AS e FROM ({places})) WHERE {check.get(kind.name, 'true')}){limit}")
    joined = lambda where: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) {where}, '')"
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{KINDS[k].name}" for k in range(BASE))
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), x AS ({" UNION ALL ".join(parts)})
SELECT doc_id, {counts}, sha256({joined(f"FILTER (k < {BASE})")}) AS base_sha256, {joined("FILTER (k IS NOT NULL)")} AS spans, CAST(coalesce(max(score), 0) AS BIGINT) AS top_score FROM d LEFT JOIN x USING (rid) GROUP BY rid, doc_id"""
