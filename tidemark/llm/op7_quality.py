"""Quality rules with a robust multivariate outlier test. DataFrame functions only.

Fixed rules fail a document that is short or repeats itself. Of the others, each (language, source) cell gets a
minimum-covariance-determinant estimate of four transformed statistics: mean word length, and the square roots of the
shares of symbols, repeated lines and repeated words. `STARTS` deterministic starts (the medians with: spreads alone,
the classical moments, the correlations of tanh-compressed values, the spatial signs) are concentrated side by side:
rank the rows by Mahalanobis distance, keep the `SUBSET` share nearest, re-estimate, until the determinant of the
(regularised) covariance no longer falls. A cell's start of least determinant wins; one reweighting step follows. A
document whose distance passes `CUTOFF` is rejected.

Ranks come from counts of rows per logarithmic distance bin (`FINE` a doubling: the nearest share is met to within one
bin's rows, which go together), medians from counts of rounded values: a cell of any size is summed partly on the map
side and never gathered, and no result depends on partitions. Estimates are one small row per cell: they are broadcast
while there are `BROADCAST_CELLS` cells at most, else rows and estimates meet under salted keys, so that a hot cell is
many tasks.

Cells under `LEAST_CELL` rows share one estimate over all rows. Spreads have floors (the regularisation), so that a cell
whose rows hardly vary rejects no near neighbour. Null texts count as empty and fail. A null lang or source is a value
of its own, apart from ''. Rows with equal or null doc_id stay rows of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, let, park, unpark

LEAST_WORDS, MOST_REPEATED = 50, 50
SUBSET, LEAST_CELL, STARTS, FINE = 0.75, 50, 4, 64
#: Estimates up to this many cells are broadcast (about 500 bytes a cell and start); beyond, keys are salted this many ways.
BROADCAST_CELLS, SALTS = 20_000, 32
#: Steps of a value in which medians and quartiles are found.
GRID = 1024
#: Squared distance beyond which a document is rejected: the upper 1e-9 of chi-square with four degrees, so that skewed but clean rows stay.
CUTOFF = 47.0
#: Consistency of a covariance over the nearest 75 % of a four-dimensional normal: 0.75 / P(chi2_6 < chi2_4's 75 % point).
CONSISTENCY = 1.485
#: chi2_4's 97.5 % point, and the consistency of the rows within it.
REWEIGHT_AT, REWEIGHT_CONSISTENCY = 11.143, 1.057
FEATURES = ("f0", "f1", "f2", "f3")
FLOORS = (0.35, 0.04, 0.1, 0.1)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOLS = "#*$%&|<>"


def _blank_class() -> str:
    return "[\\x20\\x09-\\x0D]+"


def repeated_words(words: Column) -> Column:
    """Words inside some 3-word window that occurs twice or more, the first occurrence included."""

    def count(windows: Column) -> Column:
        def walk(ranked: Column) -> Column:
            same = lambda i, j: ranked[i]["h"] == ranked[j]["h"]
            last = F.size(ranked) - 1
            again = F.filter(F.sequence(F.lit(0), last), lambda i: F.when(i > 0, same(i, i - 1)).otherwise(False) | F.when(i < last, same(i, i + 1)).otherwise(False))
            places = F.array_sort(F.transform(again, lambda i: ranked[i]["i"]))
            zero = F.struct(F.lit(-3).alias("p"), F.lit(0).alias("n"))
            step = lambda acc, p: F.struct(p.alias("p"), (acc["n"] + F.least(F.lit(3), p - acc["p"])).alias("n"))
            return F.aggregate(places, zero, step, lambda acc: acc["n"])

        ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(ranked, walk))

    window = lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])
    return F.when(F.size(words) < 3, 0).otherwise(let(F.transform(F.sequence(F.lit(0), F.size(words) - 3), window), count))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the statistics of each whole text as long columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.btrim(text, F.lit(BLANKS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _blank_class()))
    per_words = let(words, lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    per_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    stats = F.struct(per_words.alias("w"), per_lines.alias("l"))
    name = "__stats"
    out = docs.withColumn(name, stats)
    values = {
        "n_words": F.col(name)["w"]["n"],
        "word_chars": F.length(F.translate(text, BLANKS, "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_dup_lines": F.col(name)["l"]["d"],
        "n_repeat_words": F.col(name)["w"]["r"],
        "n_lines": F.col(name)["l"]["n"],
    }
    return out.withColumns({k: v.cast("long") for k, v in values.items()}).drop(name)


def base_failed() -> Column:
    n, r = F.col("n_words"), F.col("n_repeat_words")
    return (n < LEAST_WORDS) | (100 * r > MOST_REPEATED * n)


def _features() -> list[Column]:
    share = lambda a, b: F.sqrt(F.col(a) / (F.col(b) + 1))
    return [
        F.least(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)), F.lit(50.0)),
        share("n_symbols", "word_chars"),
        share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"),
    ]


K = len(FEATURES)
LOWER = [(i, j) for i in range(K) for j in range(i + 1)]
WHOLE = "\u0002"  # the cell of the estimate over all rows


def cell_of() -> Column:
    """A name of (lang, source) that tells null from ''."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    return F.concat(part("lang"), F.lit("\u0001"), part("source"))


def meet(rows: DataFrame, small: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """Rows with what `small` has of their cell: a broadcast while cells are few, else a join under salted keys."""
    if few:
        return rows.join(F.broadcast(small), "cell", how)
    salted = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.hash(*FEATURES), F.lit(SALTS)))
    return dealt.join(salted, ["cell", "salt"], how).drop("salt")


def distance(features: list[Column], of=F.col) -> Column:
    """Squared Mahalanobis distance from the estimate in columns m* and l*, by forward substitution."""
    solved: list[Column] = []
    for i, f in enumerate(features):
        solved.append(reduce(lambda a, b: a - b, (of(f"l{i}{q}") * z for q, z in enumerate(solved)), f - of(f"m{i}")) / of(f"l{i}{i}"))
    return reduce(lambda a, b: a + b, (z * z for z in solved))


def _factored(got: DataFrame, cov) -> DataFrame:
    """Adds the lower triangle l* of the Cholesky factor of the covariance cov(i, j) plus floors, and its log-determinant."""
    for i, j in LOWER:  # each entry a column of its own, so that later ones don't repeat it
        whole = cov(i, j) + (FLOORS[i] ** 2 if i == j else 0.0)
        rest = reduce(lambda a, b: a - b, (F.col(f"l{i}{q}") * F.col(f"l{j}{q}") for q in range(j)), whole)
        got = got.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    return got.withColumn("log_det", reduce(lambda a, b: a + b, (2 * F.log(F.col(f"l{i}{i}")) for i in range(K))))


def _sums(values: list[Column]) -> list[Column]:
    return [F.avg(x).alias(f"a{i}") for i, x in enumerate(values)] + [F.avg(values[i] * values[j]).alias(f"p{i}{j}") for i, j in LOWER]


def centres(rows: DataFrame) -> DataFrame:
    """Per cell: medians c* and spreads s* of the features, to the grid's steps."""
    values = rows.select("cell", F.posexplode(F.array(*FEATURES)).alias("i", "v"))
    counts = values.groupBy("cell", "i", F.floor(F.col("v") * GRID).alias("bin")).count()
    own = Window.partitionBy("cell", "i")
    ranked = counts.select("cell", "i", "bin", F.sum("count").over(own.orderBy("bin")).alias("upto"), F.sum("count").over(own).alias("n"))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("n"), F.col("bin"))) / GRID
    found = ranked.groupBy("cell", "i").agg(at(0.25).alias("lo"), at(0.5).alias("mid"), at(0.75).alias("hi"))
    floor = F.element_at(F.array(*map(F.lit, FLOORS)), F.col("i") + 1)
    spread = F.sqrt(F.pow((F.col("hi") - F.col("lo")) / 1.349, 2) + floor * floor)
    pick = lambda c, i: F.max(F.when(F.col("i") == i, c))
    return found.groupBy("cell").agg(*(pick(F.col("mid"), i).alias(f"c{i}") for i in range(K)), *(pick(spread, i).alias(f"s{i}") for i in range(K)))


def starts(rows: DataFrame, middle: DataFrame, few: bool) -> DataFrame:
    """(cell, start, c*, m*, l*): where concentration begins."""
    z = [(F.col(f) - F.col(f"c{i}")) / F.col(f"s{i}") for i, f in enumerate(FEATURES)]
    norm = F.sqrt(reduce(lambda a, b: a + b, (x * x for x in z)))
    shapes = [F.struct(F.lit(start).alias("start"), *(v.alias(f"g{i}") for i, v in enumerate(values))) for start, values in ((1, z), (2, [F.tanh(x) for x in z]), (3, [F.when(norm > 0, x / norm).otherwise(0.0) for x in z]))]
    shaped = meet(rows, middle, few).select("cell", F.explode(F.array(*shapes)).alias("g"))
    got = shaped.groupBy("cell", F.col("g.start").alias("start")).agg(*_sums([F.col(f"g.g{i}") for i in range(K)]))
    plain = middle.select("cell", F.lit(0).alias("start"), *(F.lit(0.0).alias(f"a{i}") for i in range(K)), *(F.lit(float(i == j)).alias(f"p{i}{j}") for i, j in LOWER))
    got = got.unionByName(plain).join(middle, "cell")
    root = lambda i: F.sqrt(F.greatest(F.col(f"p{i}{i}"), F.lit(1e-12)))

    def cov(i: int, j: int) -> Column:
        start, p = F.col("start"), F.col(f"p{i}{j}")
        whole = F.when(start == 1, p - F.col(f"a{i}") * F.col(f"a{j}")).when(start == 2, F.lit(1.0) if i == j else p / (root(i) * root(j))).when(start == 3, K * p).otherwise(p)
        return whole * F.col(f"s{i}") * F.col(f"s{j}")

    means = [(F.col(f"c{i}") + F.when(F.col("start") == 1, F.col(f"a{i}") * F.col(f"s{i}")).otherwise(0.0)).alias(f"m{i}") for i in range(K)]
    return _factored(got, cov).select("cell", "start", *(f"c{i}" for i in range(K)), *means, *(f"l{i}{j}" for i, j in LOWER))


def _from_sums(got: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """(keys, c*, m*, l*, log_det) from the mean differences a* from c*, and their mean products p*."""
    got = _factored(got, lambda i, j: scale * (F.col(f"p{i}{j}") - F.col(f"a{i}") * F.col(f"a{j}")))
    means = [(F.col(f"a{i}") + F.col(f"c{i}")).alias(f"m{i}") for i in range(K)]
    return got.select(*keys, *(f"c{i}" for i in range(K)), *means, *(f"l{i}{j}" for i, j in LOWER), "log_det")


def _estimate(kept: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """The same of the rows of each key; sums are taken about c*, which keeps their digits."""
    got = kept.groupBy(*keys).agg(*_sums([F.col(f) - F.col(f"c{i}") for i, f in enumerate(FEATURES)]), *(F.min(f"c{i}").alias(f"c{i}") for i in range(K)))
    return _from_sums(got, keys, scale)


MODEL = [f"c{i}" for i in range(K)] + [f"m{i}" for i in range(K)] + [f"l{i}{j}" for i, j in LOWER]


def concentrate(rows: DataFrame, model: DataFrame, few: bool) -> DataFrame:
    """The estimates after one concentration step from each of `model` (cell, start, ...).

    One pass: sums per distance bin, added up from the nearest bin to the one that completes the subset.
    """
    own = model.groupBy("cell").agg(F.collect_list(F.struct("start", *MODEL)).alias("models"))
    each = meet(rows, own, few).select("cell", *FEATURES, F.explode("models").alias("e"))
    d2 = distance([F.col(f) for f in FEATURES], lambda c: F.col("e." + c))
    apart = [(F.col(f) - F.col(f"e.c{i}")).alias(f"d{i}") for i, f in enumerate(FEATURES)]
    binned = each.select("cell", F.col("e.start").alias("start"), *apart, *(F.col(f"e.c{i}").alias(f"c{i}") for i in range(K)), F.floor(F.log2(d2 + 1e-9) * FINE).cast("int").alias("bin"))
    sums = {f"a{i}": F.sum(f"d{i}") for i in range(K)} | {f"p{i}{j}": F.sum(F.col(f"d{i}") * F.col(f"d{j}")) for i, j in LOWER}
    of_bin = binned.groupBy("cell", "start", "bin").agg(F.count(F.lit(1)).alias("n"), *(v.alias(k) for k, v in sums.items()), *(F.min(f"c{i}").alias(f"c{i}") for i in range(K)))
    one = Window.partitionBy("cell", "start")
    upto = one.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    added = of_bin.select("cell", "start", *(f"c{i}" for i in range(K)), "n", F.sum("n").over(upto).alias("upto"), F.sum("n").over(one).alias("all"), *(F.sum(k).over(upto).alias(k) for k in sums))
    need = SUBSET * F.col("all")
    last = added.where((F.col("upto") >= need) & (F.col("upto") - F.col("n") < need)).withColumns({k: F.col(k) / F.col("upto") for k in sums})
    return _from_sums(last, ["cell", "start"], CONSISTENCY)


def fit(stats: DataFrame) -> tuple[DataFrame, bool]:
    """The estimates (cell, m*, l*), one row per large enough cell and, where some are smaller, one over all rows; and whether they are few.

    `stats` has lang, source and the statistics; rows that fail the base rules take no part.
    """
    rows = stats.where(~base_failed()).select(cell_of().alias("cell"), *(f.alias(n) for f, n in zip(_features(), FEATURES, strict=True)))
    rows = park(rows, "features")
    sizes = rows.groupBy("cell").count()
    large = park(sizes.where(F.col("count") >= LEAST_CELL).select("cell"), "cells")
    n_large = large.count()
    few, small = n_large <= BROADCAST_CELLS, not sizes.where(F.col("count") < LEAST_CELL).isEmpty()
    every = meet(rows, large, few)
    if small:
        every = every.unionByName(rows.withColumn("cell", F.lit(WHOLE)))
    middle = park(centres(every), "centres")
    active = park(starts(every, middle, few).withColumn("log_det", F.lit(float("inf"))), "starts")
    ready, spent = None, [middle, large]
    while not active.isEmpty():
        got = concentrate(every, active, few)
        better = got.select("cell", "start", F.struct(*MODEL, "log_det").alias("new"))
        both = park(active.join(better, ["cell", "start"]).withColumn("fell", F.col("new.log_det") < F.col("log_det") - 1e-9), "steps")
        spent += [active, both]
        stopped = both.where(~F.col("fell")).select("cell", "start", *MODEL, "log_det")
        ready = stopped if ready is None else ready.unionByName(stopped)
        active = both.where("fell").select("cell", "start", "new.*")
    if ready is None:
        ready = active
    best = ready.groupBy("cell").agg(F.min_by(F.struct(*MODEL), F.struct(F.round("log_det", 6), "start")).alias("e")).select("cell", "e.*")
    best = park(best, "least-determinants")
    near = meet(every, best, few).where(distance([F.col(f) for f in FEATURES]) <= REWEIGHT_AT)
    model = park(_estimate(near, ["cell"], REWEIGHT_CONSISTENCY).drop(*(f"c{i}" for i in range(K)), "log_det"), "estimates")
    for table in (*spent, best, rows):
        unpark(table)
    return model, few


def judge(stats: DataFrame) -> DataFrame:
    """Adds base_failed, distance (squared) and kept to `stats`."""
    model, few = fit(stats)
    own = F.struct(*(c for c in model.columns if c != "cell")).alias("own")
    whole = model.where(F.col("cell") == WHOLE).select(own).withColumnRenamed("own", "whole")  # one row or none
    parts = stats.withColumn("cell", cell_of()).withColumns(dict(zip(FEATURES, _features(), strict=True)))
    judged = meet(parts, model.select("cell", own), few, "left").join(F.broadcast(whole), how="left")
    estimate = F.coalesce("own", "whole")
    d2 = F.when(~base_failed(), distance(_features(), lambda c: estimate[c]))
    out = judged.withColumns({"base_failed": base_failed(), "distance": d2}).drop("own", "whole", *FEATURES)
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF))


def verdicts(docs: DataFrame) -> DataFrame:
    """The digest of every row of `docs` (doc_id, text, lang, source)."""
    stats = park(statistics(docs.select("doc_id", "text", "lang", "source")).drop("text"), "statistics")
    out = judge(stats)
    return out.select("doc_id", *STATS[:5], "base_failed", "kept", F.round("distance", 3).alias("distance"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, with their columns."""
    boxed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), "text", "lang", "source")
    stats = park(statistics(boxed).drop("text"), "statistics")
    return judge(stats).where("kept").select("__row.*")
