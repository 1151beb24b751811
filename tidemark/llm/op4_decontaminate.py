"""Benchmark decontamination by template canonicalisation. DataFrame functions only.

A text becomes a row of tokens: numbers, names (runs of capitalised words inside a sentence) and units after numbers
are replaced by typed placeholders, the rest is lower-cased words. Windows of `WINDOW` tokens of every item are hashed
and joined to the windows of every document. A document holds an item when at least `CONTAINED` of the item's windows
occur in it in places where slots are consistent: along one alignment (the same shift between document and item) each
value of an item's slot stands for one value throughout, and two names never become one (numbers may coincide). So a
question whose numbers, names or units were changed is caught with its exact copies, while texts that merely share a
phrase, or fill slots at random, stay.

In texts that are set in capitals or in Title Case, where capitals tell no names, all words count as lower-case. Items
are sought in two forms, with their names as slots and with all words lower-cased, and found by either.

A template of fewer than LITERALS literal words would be filled by any text of its shape. Such items are sought by value:
windows hold their numbers, names and units as they stand, and one shorter than a window is found only as a whole text.

Items shorter than a window are one window of their own length. Names of any number of words are one name. Texts are told apart by their 64-bit hash: equal texts
count once. Null and empty texts have no windows. search() leaves out rows without doc_id, and of several texts under
one doc_id reports the one that holds most of an item; decontaminate() decides by text, whatever the id. A null item_id
leaves the item out; rows with equal item_id are one item. Empty tables give no finds. Other columns, whatever their
names, pass through decontaminate() and are ignored by search().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, park, unpark

WINDOW, CONTAINED, LITERALS = 5, 0.8, 3
#: Item windows up to this many are broadcast (16 bytes each and overhead: under 100 MB); beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000

NUM, NAME, UNIT = "\u0001", "\u0002", "\u0003"
#: Words that count as units when they follow a number.
UNITS = (
    "mm|cm|dm|km|m|mg|g|kg|t|ml|cl|l|kb|mb|gb|tb|hz|khz|mhz|w|kw|mw|v|kv|j|kj|n|pa|ms|s|sec|secs|second|seconds|min|mins|minute|minutes|h|hr|hrs|hour|hours|day|days|week|weeks|month|months|year|years"
    "|meter|meters|metre|metres|kilometer|kilometers|kilometre|kilometres|mile|miles|foot|feet|inch|inches|yard|yards|gram|grams|kilogram|kilograms|pound|pounds|ounce|ounces|ton|tons|liter|liters|litre|litres|gallon|gallons"
    "|percent|degrees|celsius|fahrenheit|dollar|dollars|euro|euros|cent|cents|usd|eur|gbp"
)
#: Joins the parts of one number and the words of one name, so that a slot's value is one token.
JOIN = "\u0005"
#: Ends a capitalised word until neighbours are one name.
END = "\u0006"
_WORD = "\\p{L}\\p{N}"
#: Patterns begin with the rare character that they look for and look behind from there: most of a text costs one test a character.
_NUMBER = f"(?:{JOIN}?\\p{{N}})*+"


def uncased(text: Column) -> Column:
    """`text`, lower-cased where most words begin with a capital."""
    return F.when(F.regexp_count(text, F.lit(r"\s\p{Lu}")) > F.regexp_count(text, F.lit(r"\s\p{Ll}")), F.lower(text)).otherwise(text)


def tokens(text: Column, values: bool) -> Column:
    """The canonical tokens of `text`; with `values`, a placeholder is followed by what it stands for."""
    t = F.regexp_replace(F.coalesce(uncased(text), F.lit("")), f"[{NUM}{NAME}{UNIT}{JOIN}{END}]", " ")
    t = F.regexp_replace(t, r"[.,:/](?<=\p{N}.)(?=\p{N})", JOIN)
    # Names are capitalised words after a word or comma in the same sentence; neighbours make one name.
    t = F.regexp_replace(t, rf"\p{{Lu}}(?<=[^.!?:\s]\s\p{{Lu}})\p{{Ll}}+(?![{_WORD}])", f" {NAME}$0{END} ")
    t = F.regexp_replace(F.regexp_replace(t, rf"{END}\s+{NAME}", JOIN), END, " ")
    t = F.regexp_replace(t, rf"(\p{{N}}(?<![{_WORD}{NUM}]\p{{N}}){_NUMBER})\s?({UNITS})(?![{_WORD}])", f" {NUM}$1 {UNIT}$2 ")
    t = F.regexp_replace(t, rf"\p{{N}}(?<![{_WORD}{NUM}{JOIN}]\p{{N}}){_NUMBER}(?![{_WORD}{JOIN}])", f" {NUM}$0 ")
    if not values:
        t = F.regexp_replace(t, rf"([{NUM}{NAME}{UNIT}])[{_WORD}{JOIN}]+", "$1")
    return F.array_remove(F.split(F.lower(t), f"[^{_WORD}{NUM}{NAME}{UNIT}{JOIN}]+"), "")


def _windows(words: Column, size: int) -> Column:
    at = lambda i: F.xxhash64(*(words[i + k] for k in range(size)))
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), at)).otherwise(F.array().cast("array<long>"))


def _hashes(rows: DataFrame, size: int, exact: bool = False) -> DataFrame:
    """(key, hash) of every window, in compiled code: one row per place, no lambda. The outer explode keeps the optimizer from testing the tokens for emptiness first, which would compute them twice.

    With `exact`, windows hold values, and those shorter than WINDOW are whole texts.
    """
    words = rows.select("key", tokens(F.col("text"), exact).alias("w"))
    long = F.size("w") == size if exact and size < WINDOW else F.size("w") >= size
    places = F.when(long, F.sequence(F.lit(0), F.size("w") - size))
    placed = words.select("key", "w", F.explode_outer(places).alias("at")).where("at is not null")
    return placed.select("key", F.xxhash64(*(F.col("w")[F.col("at") + k] for k in range(size))).alias("hash"))


def _slots(plain: Column, full: Column, size: int) -> Column:
    """Per window, the values in its slots."""

    def values(i: Column) -> Column:
        inside = F.filter(F.sequence(i, i + size - 1), lambda j: plain[j] != full[j])
        return F.transform(inside, lambda j: full[j])

    return F.when(F.size(plain) >= size, F.transform(F.sequence(F.lit(0), F.size(plain) - size), values)).otherwise(F.array().cast("array<array<string>>"))


def _strip(full: Column) -> Column:
    """Canonical tokens from those with values."""
    marked = F.substring(full, 1, 1)
    return F.when(marked.isin(NUM, NAME, UNIT), marked).otherwise(full)


def _with_values(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, at, hash, slots) of every window."""
    full = rows.select(*keys, tokens(F.col("text"), True).alias("full"))
    both = full.select(*keys, let(F.col("full"), lambda f: F.struct(F.transform(f, _strip).alias("plain"), f.alias("full"))).alias("t"))
    hashed = F.when(F.col("exact"), F.col("t.full")).otherwise(F.col("t.plain")) if "exact" in keys else F.col("t.plain")
    zipped = both.select(*keys, F.posexplode(F.arrays_zip(_windows(hashed, size).alias("hash"), _slots(F.col("t.plain"), F.col("t.full"), size).alias("slots"))).alias("at", "w"))
    return zipped.select(*keys, "at", "w.hash", "w.slots")


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, form, n_windows, size, exact, item_at, hash, item_slots), one row per window of every item and form.

    Forms 0 and 1 are templates, 2 and 3 the same by value, for items of few literal words.
    """
    rows = items.where("item_id is not null and text is not null").select("item_id", F.posexplode(F.array(F.col("text"), F.lower("text"))).alias("form", "text"))
    plain = F.filter("plain", lambda w: ~w.isin(NUM, NAME, UNIT))
    sized = rows.withColumn("plain", tokens(F.col("text"), False)).withColumns({"size": F.least(F.size("plain"), F.lit(WINDOW)), "exact": F.size(plain) < LITERALS})
    sized = sized.withColumn("form", F.col("form") + 2 * F.col("exact").cast("int"))
    parts = []
    for size in range(1, WINDOW + 1):
        own = _with_values(sized.where(F.col("size") == size), ["item_id", "form", "exact"], size)
        parts.append(own.select("item_id", "form", F.lit(size).alias("size"), "exact", F.col("at").alias("item_at"), "hash", F.col("slots").alias("item_slots")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionAll(part)
    counts = every.groupBy("item_id", "form").agg(F.countDistinct("hash").alias("n_windows"))
    return every.join(counts, ["item_id", "form"])


FOUND = "key long, item_id {item}, n_windows long, n_found long, refilled boolean"
ITEM = ["item_id", "form", "n_windows"]


def search_texts(texts: DataFrame, items: DataFrame) -> DataFrame:
    """The (key, item_id) finds of texts (key long, text), each by the item's form that is held best."""
    bench = park(item_windows(items), "item-windows")
    sizes = bench.groupBy("size", "exact").agg(F.count("*").alias("n")).collect()  # ten rows at most
    small = sum(r["n"] for r in sizes) <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda x: x)
    finds, spent = None, [bench]
    for size, exact in sorted((r["size"], r["exact"]) for r in sizes):
        own = bench.where((F.col("size") == size) & (F.col("exact") == exact)).drop("exact")
        hashes = own.select("hash", *ITEM).distinct()
        if exact:
            same = _hashes(texts, size, True).join(hint(hashes), "hash").groupBy("key", *ITEM).agg(F.countDistinct("hash").alias("n_found"), F.lit(False).alias("refilled"))
            same = same.where(F.col("n_found") >= CONTAINED * F.col("n_windows"))
            finds = same if finds is None else finds.unionAll(same)
            continue
        # First by hash alone: no values, no alignment, and little else than the texts is read.
        met = _hashes(texts, size).join(hint(hashes), "hash")
        near = met.groupBy("key", *ITEM).agg(F.countDistinct("hash").alias("n")).where(F.col("n") >= CONTAINED * F.col("n_windows"))
        near = park(near.select("key", "item_id", "form"), "near")
        spent.append(near)
        # Then the few texts left, with values and alignment.
        again = _with_values(texts.join(near.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]), ["key"], size)
        pairs = again.join(hint(own), "hash").join(near, ["key", "item_id", "form"], "left_semi").withColumn("shift", F.col("at") - F.col("item_at"))
        slots = pairs.select("key", "item_id", "form", "shift", F.explode(F.arrays_zip(F.col("item_slots").alias("own"), F.col("slots").alias("found"))).alias("v"))
        named = F.col("v.own").startswith(NAME)
        given = slots.groupBy("key", "item_id", "form", "shift").agg(
            F.countDistinct("v.own").alias("values"),
            F.countDistinct("v.own", "v.found").alias("fills"),
            F.countDistinct(F.when(named, F.col("v.own"))).alias("names"),
            F.countDistinct(F.when(named, F.col("v.found"))).alias("names_found"),
            F.max(F.col("v.own") != F.col("v.found")).alias("refilled"),
        )
        held = pairs.select("key", *ITEM, "shift", "hash").join(given, ["key", "item_id", "form", "shift"], "left")
        held = held.where("values is null or (values = fills and names = names_found)")
        found = held.groupBy("key", *ITEM).agg(F.countDistinct("hash").alias("n_found"), F.coalesce(F.max("refilled"), F.lit(False)).alias("refilled"))
        found = found.where(F.col("n_found") >= CONTAINED * F.col("n_windows"))
        finds = found if finds is None else finds.unionAll(found)
    if finds is None:
        return texts.sparkSession.createDataFrame([], FOUND.format(item=items.schema["item_id"].dataType.simpleString()))
    best = F.max_by(F.struct("n_windows", "n_found", "refilled"), F.struct(F.col("n_found") / F.col("n_windows"), -F.col("form")))
    out = park(finds.groupBy("key", "item_id").agg(best.alias("best")).select("key", "item_id", "best.*"), "finds")
    for table in spent:
        unpark(table)
    return out


def _key() -> Column:
    return F.xxhash64("text")


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The (doc_id, item_id) finds: the item's windows, those found, their share, and whether slots were refilled."""
    keyed = docs.where("doc_id is not null and text is not null").select("doc_id", _key().alias("key"), "text")
    finds = search_texts(keyed.select("key", "text"), items)
    named = keyed.select("doc_id", "key").join(finds, "key")
    one = named.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_windows", "n_found", "refilled"), F.struct(F.col("n_found") / F.col("n_windows"), ~F.col("refilled"), "key")).alias("f"))
    return one.select("doc_id", "item_id", "f.n_windows", "f.n_found", (F.col("f.n_found") / F.col("f.n_windows")).alias("containment"), "f.refilled")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no item."""
    texts = docs.where("text is not null").select(_key().alias("key"), "text")
    gone = search_texts(texts, items).select(F.col("key").alias("gone")).distinct()
    boxed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.when(F.col("text").isNotNull(), _key()).alias("key"))
    return boxed.join(gone, F.col("key") == F.col("gone"), "left_anti").select("row.*")
