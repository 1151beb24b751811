import random
import re

from tidemark.llm import op4_decontaminate as D

rng = random.Random(4)
VOCAB = ["".join(rng.choices("abcdefghijklm", k=rng.randint(2, 8))) for _ in range(500)]


def words(n):
    return " ".join(rng.choices(VOCAB, k=n))


ITEM = "a train leaves at 9 and runs 120 km from Paris to Lyon with 120 people on board while another waits 45 minutes"
ITEMS = [(1, words(30)), (2, ITEM), (3, "three short words"), (4, words(18)), (4, "another " + words(9)), (None, words(20)), (6, None), (7, "")]


def _docs():
    swap = ITEM.replace("120", "300").replace("9", "7").replace("Paris", "Berlin").replace("Lyon", "New York").replace("45 minutes", "2 hours")
    broken = swap.replace("300", "250", 1)
    one = ITEMS[0][1].split()
    return [
        (10, words(40) + " " + ITEMS[0][1] + " " + words(40)),
        (11, words(30) + ". " + ITEM + " " + words(3)),
        (12, words(30) + " " + swap + " " + words(30)),
        (13, words(30) + " " + broken + " " + words(30)),
        (14, words(200)),
        (15, words(20) + " " + " ".join(one[:12]) + " " + words(20)),
        (16, ITEMS[0][1].upper()),
        (17, "!! ".join(one)),
        (18, "x three short words y"),
        (19, None),
        (20, ""),
        (None, ITEMS[0][1]),
        (10, words(5)),
        (21, " ".join([ITEMS[0][1]] * 200)),
        (23, (words(9) + " " + ITEM + " " + ITEMS[0][1]).title()),
        (24, ITEM.upper()),
        (25, words(9) + " " + swap.replace("New York", "Berlin")),  # two names become one
        (26, " ".join(one[:16])),
        (26, " ".join(one[12:])),
        (27, " ".join(one[:16])),
        (28, words(9) + " " + ITEM.replace("120", "45")),  # numbers may coincide
        (22, "1.5 kg 3,000 $ 7% and Anna Maria Smith Jones saw A B 12:30 \u0001\u0002\u0003 " + words(10)),
    ]


def canon(text):
    """Tokens as (placeholder or word, value)."""
    t = (text or "").translate({1: " ", 2: " ", 3: " ", 5: " "})
    t = re.sub(r"(?<=[0-9])[.,:/](?=[0-9])", "\x05", t)
    t = re.sub(r"(?<=[^.!?:\s]\s)([A-Z][a-z]+)(?![^\W_])", lambda m: f" \x02{m[1]} ", t)
    while (u := re.sub("(\x02[^\\W_\x05]+(?:\x05[^\\W_]+)*)\\s+\x02", "\\1\x05", t)) != t:
        t = u
    num = "[0-9]+(?:\x05[0-9]+)*"
    t = re.sub(rf"(?<![^\W_])(?<!\x01)({num})\s?(?:({D.UNITS})(?![^\W_]))", lambda m: f" \x01{m[1]} \x03{m[2]} ", t)
    t = re.sub(rf"(?<![^\W_])(?<![\x01\x05])({num})(?![^\W_])(?!\x05)", lambda m: f" \x01{m[1]} ", t)
    return [(w[0] if w[0] in "\x01\x02\x03" else w, w) for w in re.split("[^\\w\x01\x02\x03\x05]+", t.lower().replace("_", " ")) if w]


def uncased(text):
    return text.lower() if len(re.findall(r"\s[^\W\d_](?<=[A-Z])", text)) > len(re.findall(r"\s[^\W\d_](?<=[a-z])", text)) else text


def brute(docs, items):
    """The (doc, item) finds with windows found and refilled, by comparing every window of every text with every item's."""
    per_item, totals, found = {}, {}, {}
    for i, text in items:
        for form, t in enumerate([text, (text or "").lower()]):
            toks = canon(uncased(t)) if text is not None and i is not None else []
            if toks:
                exact = sum(c not in ("\x01", "\x02", "\x03") for c, _ in toks) < 3
                # By value: each token stands for itself.
                per_item.setdefault((i, form + 2 * exact, min(5, len(toks))), []).append([(v, v) for _, v in toks] if exact else toks)
    for (i, form, size), lists in per_item.items():
        totals.setdefault((i, form), set()).update(tuple(c for c, _ in t[k : k + size]) for t in lists for k in range(len(t) - size + 1))
    for d, text in docs:
        if d is None or text is None:
            continue
        as_template = canon(uncased(text))
        for (i, form, size), own in per_item.items():
            t = [(v, v) for _, v in as_template] if form > 1 else as_template
            if form > 1 and size < 5 and len(t) != size:
                continue
            shifts = {}
            for a in range(len(t) - size + 1):
                for o in own:
                    for b in range(len(o) - size + 1):
                        if all(x[0] == y[0] for x, y in zip(t[a : a + size], o[b : b + size], strict=True)):
                            shifts.setdefault(a - b, []).append((o[b : b + size], t[a : a + size]))
            hit, refilled = set(), False
            for pairs in shifts.values():
                fills = {(y[1], x[1]) for o, t_ in pairs for y, x in zip(o, t_, strict=True) if y[0] != y[1]}
                names = {(o, f) for o, f in fills if o[0] == "\x02"}
                if len(fills) == len({a for a, _ in fills}) and len(names) == len({f for _, f in names}):
                    hit.update(tuple(c for c, _ in o) for o, _ in pairs)
                    refilled |= any(o != f for o, f in fills)
            if hit and len(hit) >= 0.8 * len(totals[i, form]):
                new = (len(hit) / len(totals[i, form]), -form, len(hit), refilled)
                found[d, i] = max(new, found.get((d, i), new))
    return {(d, i, n, r) for (d, i), (_, _, n, r) in found.items()}


def test_against_brute_force(spark):
    docs, items = _docs(), ITEMS
    got = D.search(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, hash int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.n_found, r.refilled) for r in got} == brute(docs, items)
    finds = {(r.doc_id, r.item_id): r.refilled for r in got}
    assert finds[12, 2] and not finds[11, 2] and (13, 2) not in finds
    assert {(10, 1), (16, 1), (17, 1), (18, 3), (21, 1), (23, 2), (23, 1), (24, 2)} <= set(finds)
    assert not {14, 15, 25, 27} & {d for d, _ in finds}


def test_templates_without_words_are_sought_by_value(spark):
    """Items that are nearly all placeholders remove their own text, and no other of the same shape."""
    items = [(1, "42"), (2, "7 8 9 10 11"), (3, "costs 5 kg"), (4, "Anna Maria Smith"), (5, words(25))]
    docs = [(1, "42"), (2, "the answer is 42 of course"), (3, "17"), (4, "7 8 9 10 11"), (5, "1 2 3 4 5"), (6, "count 20 30 40 50 60 70"), (7, "Costs 5 kg"), (8, "it costs 6 kg"), (9, "costs 6 kg"), (10, "we met Anna Maria Smith and Bob Jones"), (11, words(60)), (12, words(9) + " 7 8 9 10 11 " + words(3)), (13, items[4][1])]
    got = {(r.doc_id, r.item_id, r.n_found, r.refilled) for r in D.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(docs, items) and {g[:2] for g in got} == {(1, 1), (4, 2), (7, 3), (10, 4), (12, 2), (13, 5)}  # three words in capitals are words


def test_long_names_are_one_name(spark):
    name = "Anna Berta Clara Dora Emma Frida Greta Hanna Ida Julia Karla"
    text = f"we have seen {name} in town and then nobody else for many a long and rainy day"
    got = spark.createDataFrame([(text,)], "text string").select(D.tokens(D.F.col("text"), False)).first()[0]
    assert got[:6] == ["we", "have", "seen", D.NAME, "in", "town"]


def test_a_very_long_text(spark):
    long = " ".join([words(20_000), ITEM, words(20_000)])
    got = D.search(spark.createDataFrame([(1, long)], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.containment) for r in got] == [(1, 2, 1.0)]


def test_shuffled_join_finds_the_same(spark, monkeypatch):
    docs, items = (spark.createDataFrame(x, s) for x, s in ((_docs(), "doc_id long, text string"), (ITEMS, "item_id long, text string")))
    want = sorted(map(str, D.search(docs, items).collect()))
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    assert sorted(map(str, D.search(docs, items).collect())) == want


def test_rows_are_decided_by_their_text(spark):
    docs = spark.createDataFrame([(None, ITEMS[0][1], 1, 2), (7, ITEMS[0][1], 1, 2), (7, "clean text here", 1, 2), (None, None, 1, 2), (8, "", 1, 2)], "doc_id long, text string, __gone int, key int")
    kept = D.decontaminate(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(str(r.text) for r in kept.collect()) == ["", "None", "clean text here"]


def test_decontaminate_and_empty_tables(spark):
    rows = _docs()
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    numbered = list(enumerate(t for _, t in rows))
    gone = {d for d, *_ in brute(numbered, ITEMS)}
    assert sorted(str(r.text) for r in D.decontaminate(docs, items).collect()) == sorted(str(t) for i, t in numbered if i not in gone)
    assert D.search(docs, items.limit(0)).count() == 0 and D.decontaminate(docs, items.limit(0)).count() == len(rows)
    assert D.search(docs.limit(0), items).count() == 0
