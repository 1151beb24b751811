"""Queries over the trained scorer, token lengths and resumable scoring. The SQL trains the same model, step by step."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import resumable, scoring, tokens, trained
from ..registry import register
from ..session import kept, load, scratch
from .base import r6
from .quality import SCORED_SQL

#: A document's label: toxic ones are negative, good ones positive, others neutral.
RATED_SQL = "rated AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 WHEN quality = 0 THEN 1 END AS y, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 1))::INT <= 2 AS held_out FROM labels)"


def _steps() -> str:
    """One full-batch step after another: class probabilities, gradients by bucket, weights."""
    out = [f"s0 AS MATERIALIZED (SELECT bucket, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS v0, 0.0::DOUBLE AS v1, 0.0::DOUBLE AS v2, sum(x * x) / any_value(n) + {trained.SHRINK} AS h FROM train GROUP BY bucket)"]
    for i in range(1, trained.STEPS + 1):
        move = ", ".join(f"{trained.MOMENTUM} * v{k} - {trained.RATE} * (coalesce(g{k}, 0) + {trained.SHRINK} * w{k}) / h AS v{k}" for k in range(3))
        out.append(
            f"z{i} AS (SELECT doc_id, y, any_value(c) AS c, exp(sum(x * w0)) AS a0, exp(sum(x * w1)) AS a1, exp(sum(x * w2)) AS a2 FROM train JOIN s{i - 1} USING (bucket) GROUP BY doc_id, y), "
            f"p{i} AS MATERIALIZED (SELECT doc_id, {', '.join(f'c * (a{k} / (a0 + a1 + a2) - (y = {k})::INT) AS d{k}' for k in range(3))} FROM z{i}), "
            f"g{i} AS (SELECT bucket, {', '.join(f'sum(x * d{k}) / any_value(n) AS g{k}' for k in range(3))} FROM train JOIN p{i} USING (doc_id) GROUP BY bucket), "
            f"m{i} AS (SELECT bucket, w0, w1, w2, {move}, h FROM s{i - 1} LEFT JOIN g{i} USING (bucket)), "
            f"s{i} AS MATERIALIZED (SELECT bucket, w0 + v0 AS w0, w1 + v1 AS w1, w2 + v2 AS w2, v0, v1, v2, h FROM m{i})"
        )
    return ",\n".join(out)


#: The model's features, training and probabilities of every document, in SQL.
MODEL_SQL = f"""prep AS (SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), ' '), lambda w: CASE WHEN starts_with(w, '@') AND length(w) > 1 THEN '@user' WHEN starts_with(w, 'http') THEN 'http' ELSE w END), ' ') AS t FROM documents),
words AS (SELECT doc_id, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+') AS w FROM prep),
grams AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM words),
counts AS (SELECT doc_id, ('0x' || substr(md5(gram), 1, {trained.DIGITS}))::INT AS bucket, count(*) AS n FROM grams GROUP BY 1, 2),
features AS MATERIALIZED (SELECT doc_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS x FROM counts UNION ALL SELECT doc_id, {trained.BUCKETS}, 1.0 FROM documents),
{RATED_SQL},
sizes AS (SELECT y, count(*) AS n_y, sum(count(*)) OVER () AS n FROM rated JOIN documents USING (doc_id) WHERE NOT held_out AND y IS NOT NULL GROUP BY y),
train AS MATERIALIZED (SELECT doc_id, y, bucket, x, CAST(n AS DOUBLE) AS n, n / (3.0 * n_y) AS c FROM features JOIN rated USING (doc_id) JOIN sizes USING (y) WHERE NOT held_out),
{_steps()},
logits AS (SELECT doc_id, exp(sum(x * coalesce(w0, 0))) AS a0, exp(sum(x * coalesce(w1, 0))) AS a1, exp(sum(x * coalesce(w2, 0))) AS a2 FROM features LEFT JOIN s{trained.STEPS} USING (bucket) GROUP BY doc_id),
by_model AS MATERIALIZED (SELECT doc_id, a0 / (a0 + a1 + a2) AS pn, a1 / (a0 + a1 + a2) AS pz, a2 / (a0 + a1 + a2) AS pp FROM logits)"""
_LABEL = "CASE WHEN pn = greatest(pn, pz, pp) THEN 'negative' WHEN pz = greatest(pn, pz, pp) THEN 'neutral' ELSE 'positive' END"


def _texts(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.model_input("text").alias("text"))


def rated(spark, sf_dir):
    """(doc_id, label, held_out): the documents' labels as the three classes, and the rows that no model learns from."""
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "neutral")
    return load(spark, sf_dir, "labels").select("doc_id", label.alias("label"), trained.held_out("doc_id").alias("held_out"))


def stored_model(spark, sf_dir):
    """A model trained on the labelled documents that aren't held out, written as an artefact and opened from it."""
    rows = rated(spark, sf_dir).where(~F.col("held_out")).join(_texts(spark, sf_dir), "doc_id")
    path = scratch(spark, "model")
    trained.save(spark, trained.fit(rows, "text", "label"), path)
    return trained.open_model(spark, path)


@register("model_scores", f"WITH {MODEL_SQL} SELECT doc_id, {_LABEL} AS score_label, round(pn, 6) AS prob_negative, round(pz, 6) AS prob_neutral, round(pp, 6) AS prob_positive, round(pp - pn, 6) + 0.0 AS sentiment_score FROM by_model")
def model_scores(spark, sf_dir):
    """Class probabilities of every document by the trained model."""
    out = scoring.score(_texts(spark, sf_dir), "text", trained.scorer(spark, stored_model(spark, sf_dir)))
    return out.select("doc_id", "score_label", r6("prob_negative"), r6("prob_neutral"), r6("prob_positive"), r6("sentiment_score"))


_AGREE = "SELECT scorer, count(*) AS n, avg((y = q)::INT) AS po, " + ", ".join(f"count(*) FILTER (y = {k}) AS t{k}, count(*) FILTER (q = {k}) AS p{k}, count(*) FILTER (y = {k} AND q = {k}) AS b{k}" for k in range(3)) + " FROM judged GROUP BY 1"


@register(
    "model_accuracy",
    f"""WITH {MODEL_SQL}, {SCORED_SQL[SCORED_SQL.index("tok AS") :]},
called AS (SELECT 'trained' AS scorer, doc_id, {_LABEL} AS label FROM by_model UNION ALL SELECT 'word list', doc_id, {_LABEL} FROM scored),
judged AS (SELECT scorer, y, CASE label WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END AS q FROM called JOIN rated USING (doc_id) WHERE held_out AND y IS NOT NULL),
a AS ({_AGREE}),
k AS (SELECT *, {' + '.join(f't{k} / n * p{k} / n' for k in range(3))} AS pe, ({' + '.join(f'coalesce(2.0 * b{k} / nullif(t{k} + p{k}, 0), 0)' for k in range(3))}) / 3 AS macro_f1 FROM a)
SELECT scorer, n, round(po, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round((po - pe) / nullif(1 - pe, 0), 6) + 0.0 AS kappa FROM k""",
)
def model_accuracy(spark, sf_dir):
    """Accuracy, macro F1 and kappa on held-out labels, of the trained model and of the word lists."""
    texts = rated(spark, sf_dir).where("held_out and label is not null").join(_texts(spark, sf_dir), "doc_id")
    own = scoring.score(texts, "text", trained.scorer(spark, stored_model(spark, sf_dir))).withColumn("scorer", F.lit("trained"))
    both = own.unionByName(scoring.score(texts, "text").withColumn("scorer", F.lit("word list")))
    out = trained.agreement(both, ["scorer"], "label", "score_label")
    return out.select("scorer", "n", r6("accuracy"), r6("macro_f1"), r6("kappa"))


@register("resumed_scores", f"WITH {SCORED_SQL} SELECT doc_id, round(pp - pn, 6) + 0.0 AS sentiment_score, token_length FROM scored")
def resumed_scores(spark, sf_dir):
    """Scoring in key ranges, stopped after the first one and taken up again: every document once."""
    docs, folder = _texts(spark, sf_dir), scratch(spark, "scoring")
    work = lambda part: scoring.score(part, "text").select("doc_id", "sentiment_score", "token_length")
    rows = max(1, docs.count() // 8)
    resumable.run(docs, "doc_id", work, folder, rows, at_most=1)
    resumable.run(docs, "doc_id", work, folder, rows)
    return resumable.result(spark, folder).select("doc_id", r6("sentiment_score"), "token_length")


def vocabulary() -> str:
    """The tokenizer file of the token audits, from the package of public ones."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register("token_windows", "SELECT lang, count(*) AS n, count(*) AS n_equal, true AS adds_up FROM documents GROUP BY 1")
def token_windows(spark, sf_dir):
    """Per language: texts, those of which a window of 512 keeps just what the tokenizer's own cut leaves, and whether the
    audit's tokens, kept and lost, add up. SQL knows no sub-word tokens; it has the counts that must come out.
    """
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", T.model_input("text").alias("text"))
    # Texts are dealt anew, since a table of few row groups would keep few tasks busy; the audits read what is kept.
    spread = docs.repartition(4 * spark.sparkContext.defaultParallelism)
    lengths = kept(tokens.token_lengths(spread.drop("doc_id"), "text", vocabulary(), cut=True), "token-lengths")
    counted = lengths.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kept_length") == F.col("cut_length")).alias("n_equal"), F.sum("cut_length").alias("kept"))
    audited = tokens.audit(lengths, ["lang"]).select("lang", (F.col("tokens") - F.col("tokens_lost")).alias("left"))
    return counted.join(audited, "lang").select("lang", "n", "n_equal", (F.col("kept") == F.col("left")).alias("adds_up"))
