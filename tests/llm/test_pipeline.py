import random

import corpus_pipeline
import pytest

from tidemark.llm import op3_pii, op4_decontaminate, op6_simhash, op7_quality

from .test_decontaminate import brute as brute_items
from .test_golay_simhash import brute_components, brute_print
from .test_pii import base_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _tables(spark, folder):
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(400)]
    words = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, words(20)) for i in range(3)]
    docs = [words(rng.randint(60, 150)) for _ in range(120)]
    docs[5] = "$$$ ".join(docs[5].split())
    docs[6] = " ".join(docs[6].split()[:25] * 4)
    docs[7] = words(10)
    docs[8] = docs[9] = docs[10]
    docs[11] += " " + items[1][1] + " " + words(5)
    docs[12] += " write to a.b@example.com or +1 (415) 555-2671"
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(docs)] + [(500, None, None, None, None), (501, "", "en", "s0", 0), (None, words(70), "en", "s1", 3)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_every_stage_against_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    rows, items = _tables(spark, folder)
    docs, names = spark.read.parquet(f"{folder}/documents.parquet"), [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "segmentation"]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != names[-1]:
            assert docs.schema == spark.read.parquet(f"{folder}/documents.parquet").schema
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs.collect()
    kept = {r.doc_id for r in op7_quality.verdicts(spark.createDataFrame(rows, SCHEMA)).where("kept").collect()}
    assert {r.doc_id for r in out["quality_rules"]} == kept
    assert not kept & {5, 6, 7, 500, 501} and len(kept) > 100
    left = [r for r in rows if r[0] in kept]
    prints = [brute_print(r[1]) for r in left]
    comp = brute_components([r[0] for r in left], prints)
    stay = {r[0] for r, c in zip(left, comp, strict=True) if r[0] is None or c == r[0]}
    assert {r.doc_id for r in out["near_duplicates"]} == stay and 8 in stay and not {9, 10} & stay
    held = {d for d, *_ in brute_items([(r[0], r[1]) for r in rows if r[0] in stay], items)}
    assert held == {11} and {r.doc_id for r in out["decontamination"]} == stay - held
    clean = {r.doc_id: r for r in out["personal_data"]}
    assert set(clean) == stay - held
    assert clean[12].text.endswith("write to <EMAIL> or <PHONE>") and clean[12].n_chars == len(clean[12].text)
    assert not any(base_spans(r.text) for r in clean.values())
    assert {r.doc_id for r in out["segmentation"]} == set(clean)
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, out["segmentation"]))


@pytest.mark.parametrize("stage", [op7_quality.keep_good, op6_simhash.deduplicate, op3_pii.redact])
def test_stages_take_empty_tables(spark, stage):
    assert stage(spark.createDataFrame([], SCHEMA)).count() == 0


def test_decontamination_takes_empty_tables(spark):
    empty, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert op4_decontaminate.decontaminate(empty, items).count() == 0
