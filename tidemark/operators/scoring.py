"""Batch scoring of text with a pluggable model, in Arrow batches; the model loads once a worker."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("negative", "neutral", "positive")
#: Texts of more tokens are marked as truncated by models with a window of this size.
MAX_TOKENS = 512

#: Fixed values of the default scorer.
POSITIVE = frozenset("good great gain gains profit bull bullish up win strong best love excellent happy growth rise".split())
NEGATIVE = frozenset("bad loss losses crash bear bearish down lose weak worst hate terrible sad fall trash loser scum worthless stupid".split())
_TOKEN = re.compile(r"\w+|[^\w\s]")

#: Takes texts, returns probabilities of the three labels and token counts.
Scorer = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def word_list_scorer() -> Scorer:
    """The default model: softmax of word-list hits against a neutral unit."""

    def run(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokens = [_TOKEN.findall(t.lower()) for t in texts]
        hits = np.array([[sum(w in NEGATIVE for w in t), 1.0, sum(w in POSITIVE for w in t)] for t in tokens], float).reshape(-1, 3)
        e = np.exp(hits - hits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True), np.array([len(t) for t in tokens], np.int64)

    return run


def score(df: DataFrame, text: str, make: Callable[[], Scorer] = word_list_scorer, batch: int = 256) -> DataFrame:
    """Adds prob_*, sentiment_score (positive less negative), score_label, token_length and was_truncated."""
    kind = "prob_negative double, prob_neutral double, prob_positive double, token_length long"

    @F.pandas_udf(kind)
    def model(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for part in parts:
            texts, out = part.fillna("").tolist(), []
            for at in range(0, len(texts), batch):
                p, n = scorer(texts[at : at + batch])
                out.append(np.column_stack((p, n)))
            table = np.concatenate(out) if out else np.empty((0, 4))
            yield pd.DataFrame({"prob_negative": table[:, 0], "prob_neutral": table[:, 1], "prob_positive": table[:, 2], "token_length": table[:, 3].astype(np.int64)})

    scored = df.withColumn("__p", model(F.col(text))).select(*df.columns, "__p.*")
    top = F.greatest(*(F.col(f"prob_{x}") for x in LABELS))
    label = F.when(F.col("prob_negative") == top, "negative").when(F.col("prob_neutral") == top, "neutral").otherwise("positive")
    return scored.withColumns({"sentiment_score": F.col("prob_positive") - F.col("prob_negative"), "score_label": label, "max_probability": top, "was_truncated": F.col("token_length") > MAX_TOKENS})
