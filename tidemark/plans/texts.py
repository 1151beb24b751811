"""Queries over text: cleaning, flags, reasons, audits, and the pluggable scorer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..functions import text as T
from ..operators import cleaning, quality, summary
from ..operators.series import duplicates
from ..registry import register
from ..session import kept, load

#: White space as Unicode has it, inside a class of DuckDB's patterns.
SPACE = "\\s\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def _sql_steps(c: str, steps) -> str:
    for pattern, to in steps:
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return f"trim(regexp_replace({c}, '[{SPACE}]+', ' ', 'g'))"


#: The entities that pages hold; the text tests hold all others against Python's own reader.
_SQL_ENTITIES = "regexp_replace(replace(replace(replace({}, '&copy;', '\u00a9'), '&middot;', '\u00b7'), '&quot;', '\"'), '&amp;?', '&', 'g')"
_SQL_CLEAN = (("[\\x{200B}-\\x{200D}\\x{FEFF}]", ""), ("(?s)```.*?```", " "), ("\\[([^\\]]+)\\]\\([^)]+\\)", "\\1"), (f"(?i)https?://[^{SPACE}]+", " "), (f"(?i)www\\.[^{SPACE}]+", " "), ("<[^>]+>", " "), ("[*_~`]+", ""), (f"(?m)^[{SPACE}]*>[{SPACE}]?", ""))
_SQL_KEY = ((f"https?://[^{SPACE}]+", " "), (f"www\\.[^{SPACE}]+", " "), (f"[^a-z0-9{SPACE}]", " "))


@register("clean_html", f"SELECT page_id, {_sql_steps(_SQL_ENTITIES.format('html'), _SQL_CLEAN)} AS body FROM pages")
def clean_html(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", T.clean_text("html").alias("body"))


@register("matching_key", f"SELECT doc_id, {_sql_steps('lower(text)', _SQL_KEY)} AS key FROM documents")
def matching_key(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.matching_key("text").alias("key"))


@register("letter_count", "SELECT doc_id, length(regexp_replace(coalesce(text, ''), '\\P{L}', '', 'g')) AS letters FROM documents")
def letter_count(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.letter_count("text").cast("long").alias("letters"))


@register("model_input", "SELECT conv_id, turn, array_to_string(list_transform(string_split(coalesce(text, ''), ' '), lambda w: CASE WHEN starts_with(w, '@') AND length(w) > 1 THEN '@user' WHEN starts_with(w, 'http') THEN 'http' ELSE w END), ' ') AS prepared FROM conversations")
def model_input(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", T.model_input("text").alias("prepared"))


@register("slug", "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def slug(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", T.slug("p_name").alias("slug"))


FLAGS_SQL = f"""b AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
k AS (SELECT *, {_sql_steps('lower(t)', _SQL_KEY)} AS key, length(regexp_replace(t, '\\P{{L}}', '', 'g')) AS letters FROM b),
f AS (SELECT *, letters < 40 AS short, regexp_matches(t, '(?i)(trash|loser|scum)') AS promo, key <> '' AND row_number() OVER (PARTITION BY lang, key ORDER BY doc_id) > 1 AS dup, CASE WHEN key <> '' THEN count(*) OVER (PARTITION BY lang, key) ELSE 0 END >= 5 AS many FROM k),
d AS (SELECT *, short OR promo OR dup AS exclude, coalesce(nullif(concat_ws(';', CASE WHEN short THEN 'too_short' END, CASE WHEN promo THEN 'promotional' END, CASE WHEN dup THEN 'exact_duplicate' END), ''), 'retained') AS reason FROM f)"""


def flagged(spark, sf_dir):
    """Flags of every document. The text is read and cleaned once; what goes on to grouping is a digest and flags."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", T.safe_text("text").alias("t"))
    key = T.matching_key("t")
    once = docs.select("doc_id", "lang", "source", F.nullif(key, F.lit("")).alias("key"), T.letter_count("t").alias("letters"), T.matches_any("t", ["trash", "loser", "scum"]).alias("promotional"))
    rows = kept(once.withColumn("key", F.unhex(F.md5("key"))), "flagged-texts")
    out = duplicates(rows.withColumn("key", F.hex("key")), ["lang", "key"], ["doc_id"], F.col("key").isNotNull())
    flags = {"too_short": F.col("letters") < 40, "promotional": F.col("promotional"), "exact_duplicate": F.col("later_copy")}
    out = out.withColumns(flags | {"many": F.col("copies") >= 5})
    named = {k: F.col(k) for k in flags}
    return out.withColumns({"exclude": scalar.any_of(named.values()), "reason": scalar.reasons(named), "n_flags": scalar.count_of(named.values())}).withColumn("retain", ~F.col("exclude")).drop("key")


@register("text_flags", f"WITH {FLAGS_SQL} SELECT doc_id, short AS too_short, promo AS promotional, dup AS exact_duplicate, many AS repeated, exclude, reason, CAST(short AS INTEGER) + CAST(promo AS INTEGER) + CAST(dup AS INTEGER) AS n_flags FROM d")
def text_flags(spark, sf_dir):
    return flagged(spark, sf_dir).select("doc_id", "too_short", "promotional", "exact_duplicate", F.col("many").alias("repeated"), "exclude", "reason", "n_flags")


@register("cleaning_audit", f"""WITH {FLAGS_SQL}, u AS (SELECT count(*) AS n, count(*) FILTER (short) AS a, count(*) FILTER (promo) AS b, count(*) FILTER (dup) AS c, count(*) FILTER (many) AS m, count(*) FILTER (NOT exclude) AS r FROM d)
SELECT 'too_short' AS measure, 'exclusion' AS rule_type, a AS n, round(100.0 * a / n, 6) AS pct FROM u UNION ALL SELECT 'promotional', 'exclusion', b, round(100.0 * b / n, 6) FROM u UNION ALL SELECT 'exact_duplicate', 'exclusion', c, round(100.0 * c / n, 6) FROM u UNION ALL SELECT 'repeated', 'diagnostic', m, round(100.0 * m / n, 6) FROM u UNION ALL SELECT 'retained', 'total', r, round(100.0 * r / n, 6) FROM u""")
def cleaning_audit(spark, sf_dir):
    rules = {c: ("exclusion", F.col(c)) for c in ("too_short", "promotional", "exact_duplicate")} | {"repeated": ("diagnostic", F.col("many")), "retained": ("total", F.col("retain"))}
    return quality.audit(flagged(spark, sf_dir), rules).withColumn("pct", F.round("pct", 6))


@register("flag_overlap", f"WITH {FLAGS_SQL} SELECT a AS flag, b AS other, count(*) FILTER (list_contains(s, a) AND list_contains(s, b)) AS n FROM (SELECT list_filter([CASE WHEN short THEN 'too_short' END, CASE WHEN promo THEN 'promotional' END, CASE WHEN dup THEN 'exact_duplicate' END], lambda x: x IS NOT NULL) AS s FROM d), (SELECT unnest(['too_short', 'promotional', 'exact_duplicate']) AS a), (SELECT unnest(['too_short', 'promotional', 'exact_duplicate']) AS b) GROUP BY 1, 2")
def flag_overlap(spark, sf_dir):
    return summary.overlaps(flagged(spark, sf_dir), ["too_short", "promotional", "exact_duplicate"])


@register("reason_counts", f"WITH {FLAGS_SQL} SELECT reason, count(*) AS count FROM d GROUP BY 1")
def reason_counts(spark, sf_dir):
    return flagged(spark, sf_dir).groupBy("reason").count()


@register("representation_shift", f"WITH {FLAGS_SQL}, g AS (SELECT source, count(*) AS n_raw, count(*) FILTER (NOT exclude) AS n_retained FROM d GROUP BY 1) SELECT source, n_raw, n_retained, round(100.0 * n_raw / sum(n_raw) OVER (), 6) AS raw_pct, round(100.0 * n_retained / sum(n_retained) OVER (), 6) AS retained_pct, round(100.0 * n_retained / sum(n_retained) OVER () - 100.0 * n_raw / sum(n_raw) OVER (), 6) AS shift_pp FROM g")
def representation_shift(spark, sf_dir):
    out = summary.representation_shift(flagged(spark, sf_dir), "source", "retain")
    return out.withColumns({c: F.round(c, 6) for c in ("raw_pct", "retained_pct", "shift_pp")})


POSTS_SQL = f"""p AS (SELECT conv_id, turn, role, conv_id || '-' || turn AS post_id, coalesce(text, '') AS body, string_split(coalesce(text, ''), '.')[1] AS title FROM conversations),
c AS (SELECT *, {_sql_steps("title", _SQL_CLEAN)} AS tc, {_sql_steps("body", _SQL_CLEAN)} AS bc FROM p),
a AS (SELECT *, CASE WHEN tc = '' THEN bc WHEN bc = '' THEN tc ELSE tc || '. ' || bc END AS whole FROM c),
k AS (SELECT *, {_sql_steps("lower(whole)", _SQL_KEY)} AS key, length(regexp_replace(whole, '\\P{{L}}', '', 'g')) AS letters FROM a),
f AS (SELECT *, whole = '' OR letters < 3 OR lower(trim(title)) IN ('[deleted]', '[removed]', 'deleted', 'removed') OR lower(trim(body)) IN ('[deleted]', '[removed]', 'deleted', 'removed') AS unusable, key <> '' AND row_number() OVER (PARTITION BY role, key ORDER BY conv_id, turn) > 1 AS dup, CASE WHEN key <> '' THEN count(*) OVER (PARTITION BY role, key) ELSE 0 END >= 5 AS many FROM k)"""


@register("clean_posts", f"WITH {POSTS_SQL} SELECT conv_id, turn, letters, unusable AS flag_unusable, dup AS flag_exact_duplicate, many AS flag_repeated, NOT (unusable OR dup) AS retain, coalesce(nullif(concat_ws(';', CASE WHEN unusable THEN 'unusable' END, CASE WHEN dup THEN 'exact_duplicate' END), ''), 'retained') AS reason FROM f")
def clean_posts(spark, sf_dir):
    """The whole cleaning stage over conversations as posts: first words as title, text as body."""
    rows = load(spark, sf_dir, "conversations").withColumns({"post_id": F.concat_ws("-", "conv_id", "turn"), "title": F.substring_index(F.coalesce("text", F.lit("")), ".", 1)})
    cleaned = kept(cleaning.clean(rows, "title", "text"), "cleaned-posts")
    out = cleaning.flag(cleaned, "title", "text", ["role"], ["conv_id", "turn", "post_id"], F.lit(None).cast("string"), F.lit(None).cast("string"))
    return out.select("conv_id", "turn", "letters", "flag_unusable", "flag_exact_duplicate", "flag_repeated", "retain", "reason")
