"""The pipeline's stages, one by one and on end, on documents with odd rows."""

import random

import pytest

import corpus_pipeline
from tests_words import words

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(41)
    folder = tmp_path_factory.mktemp("tables")
    base, item, passage = words(rng, 150), words(rng, 40), words(rng, 80)
    own = base.split()
    rows = [(0, base), (1, " ".join([*own[:70], "changed", *own[71:]])), (2, None), (3, ""), (4, "two words"), (4, "two words"), (None, base), (None, None)]
    rows += [(5, words(rng, 30) + " " + item + " " + words(rng, 30)), (6, words(rng, 60) + "\n" + passage), (7, words(rng, 50) + "\n" + passage + "\n" + words(rng, 20)), (8, words(rng, 3000)), (9, " \n ")]
    labels = []
    for k in range(100, 400):
        toxic = k % 3 == 0
        rows.append((k, f"{words(rng, 12)} {'wxother' if toxic else 'kettle'} {words(rng, 9)}."))
        labels.append((k, 1, int(toxic)))
    put = lambda name, schema, own_rows: spark.createDataFrame(own_rows, schema).write.parquet(f"{folder}/{name}.parquet")
    put("documents", DOCUMENTS, [(i, t, "en", "s", len(t or "")) for i, t in rows])
    put("labels", "doc_id long, quality int, toxic int", labels)
    put("benchmark", "item_id long, text string", [(1, item), (2, None)])
    return str(folder), rows


def test_run_keeps_what_no_stage_objects_to(spark, tables):
    folder, rows = tables
    pieces = corpus_pipeline.run(spark, folder).collect()
    left = {r["doc_id"] for r in pieces}
    toxic = {k for k in range(100, 400) if k % 3 == 0}
    assert left == {i for i, _ in rows} - toxic - {1, 5}
    # Rows that repeat stay both; every id of a document lies in one piece of full or two-power sequences.
    assert sum(r["doc_tokens"] == r["length"] for r in pieces if r["doc_id"] == 4) == 2
    total = {}
    for r in pieces:
        total[r["sequence_id"]] = total.get(r["sequence_id"], 0) + r["length"]
        assert len(r["ids"]) == r["length"]
    assert all(n <= 2048 and (n == 2048 or n & (n - 1) == 0) for n in total.values())


def test_stages_take_effect_and_keep_columns(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {i: t for i, t in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        got = out.collect()
        gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in got}
        changed = {r["doc_id"] for r in got if r["doc_id"] is not None and r["text"] != texts[r["doc_id"]]}
        if name == "toxicity":
            assert gone == {k for k in range(100, 400) if k % 3 == 0} and not changed
        elif name == "ngram_jaccard_join":
            assert gone == {1} and not changed
        elif name == "substring_dedup":
            assert {7} <= changed and all(r["n_chars"] == len(r["text"] or "") for r in got)
            assert len(next(r for r in got if r["doc_id"] == 7)["text"].split()) < 50 + 20 + 40
        else:
            assert gone == {5} and not changed


@pytest.mark.parametrize("stage", range(5))
def test_stages_of_no_rows(spark, tables, stage):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    out = corpus_pipeline.STAGES[stage][1](spark, docs, folder)
    assert out.count() == 0 and (stage == 4 or out.columns == docs.columns)


def test_nothing_to_learn_or_to_match(spark, tables, tmp_path):
    folder, rows = tables
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_contaminated):
        assert stage(spark, docs, str(tmp_path)).count() == len(rows)
