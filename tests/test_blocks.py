"""Searches whose work grows with the rows, not with queries times rows."""

import random

import pytest
from pyspark.sql import functions as F

from notelake.operators import blocks, grams, index, lineage, search

WEIGHTS = {"title": 8.0, "body": 0.2}


@pytest.fixture
def rows(spark):
    rnd = random.Random(7)
    word = lambda: f"w{min(int(rnd.paretovariate(0.7)), 60)}"
    made = [(f"n{k:03}.md", word(), " ".join(word() for _ in range(rnd.randrange(0, 30)))) for k in range(60)]
    copies = [(f"copy{k}.md", "same", "w3 w3_w4 w5 planting") for k in range(9)]
    return spark.createDataFrame([*made, *copies, ("none.md", None, None)], "path string, title string, body string")


def test_terms_are_grouped_where_their_rows_are(rows):
    got = index._postings(rows, WEIGHTS, "path")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    told = lambda df: {(r["term"], r["row_id"]): (round(r["f"], 9), r["len"], sorted(r["places"])) for r in df.collect()}
    assert told(got) == told(index.built(rows, WEIGHTS).postings)


def test_a_task_sorts_a_bounded_share_of_the_postings():
    for size in (1 << 20, 1 << 30, 10 << 30, 300 << 30):
        buckets, spread = index._layout(size, 1000)
        assert size / (buckets * spread) <= index.TASK_BYTES


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_best_keeps_what_ranked_keeps(spark, rows, tmp_path, monkeypatch, block_rows):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", block_rows)
    held = index.repaired(rows, WEIGHTS, str(tmp_path / "i"))
    asked = [(1, "w1 w2 w40"), (2, "w3 w3_w4"), (3, "same"), (4, "planted words"), (5, "absent w1"), (6, "w1 w2 w40"), (7, ""), (8, "W1 w1 w50")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    runs = search.variants(queries, spark.sql("SELECT 'w2' AS title, array('w9', 'w41') AS aliases, 'approved' AS status"))
    told = lambda df: sorted((r["query_id"], r["run"], r["rank"], r["row_id"], round(r["score"], 9)) for r in df.collect())
    for limit in (2, 1000):
        assert told(search.best(runs, held, limit)) == told(search.ranked(search.bm25(runs, held), limit))
    words = search.strict_run(queries)
    some = search.best(words, held, 5, some=True)
    assert told(some) == told(search.ranked(search.bm25(words.withColumn("group_id", F.lit(0)), held), 5))
    hits = {tuple(r) for r in search.phrase_hits(words, held).select("query_id", "group_id", "row_id").collect()}
    for r in some.collect():
        assert set(r["groups"]) == {g for q, g, row in hits if (q, row) == (r["query_id"], r["row_id"])}


def test_groups_count_rows_of_any_member_once(spark, rows, tmp_path):
    held = index.repaired(rows, WEIGHTS, str(tmp_path / "i"))
    groups = spark.createDataFrame([(1, 0, ["w1", "w2"], True), (1, 1, ["w3"], True), (2, 0, ["w2", "w1"], True), (2, 1, ["absent"], True), (3, 0, ["w3_w4"], False)], "query_id long, group_id int, members array<string>, grown boolean")
    hits = search.phrase_hits(search.group_run(groups, 0), held).select("query_id", "group_id", "row_id").distinct().groupBy("query_id", "group_id").count()
    want = {(r[0], r[1]): r[2] for r in hits.collect()}
    assert {(r["query_id"], r["group_id"]): r["df"] for r in search.signal_groups(groups, held).collect()} == {**want, (2, 1): 0}


def test_trigrams_that_are_not_asked_for_stay_in_their_tasks(spark):
    texts = spark.createDataFrame([(f"t{k}", f"text number {k} " + "xyz" * (k % 3)) for k in range(40)], "row_id string, hay string")
    built = grams.built(texts)
    few = built.held_by(spark.createDataFrame([(int(grams.keys("xyz")[0]),)], "gram long"))
    assert "Join" not in few._jdf.queryExecution().executedPlan().toString() and few.count() == 26


def test_postings_of_a_term_are_packed_into_one_row_and_unpacked_whole(rows):
    rows = rows.coalesce(1)
    packed = index._postings(rows, WEIGHTS, "path", packed=True).cache()
    want = {(r["term"], r["row_id"]): (round(r["f"], 9), r["len"], sorted(r["places"])) for r in index.built(rows, WEIGHTS).postings.collect()}
    # One row for each term, and one with all rows' lengths.
    assert packed.count() == len({t for t, _ in want}) + 1 and packed.agg({"n": "sum"}).first()[0] == len(want) + rows.count()
    got = index._unpacked(packed.withColumn("version", F.lit(4))).collect()
    assert {(r["term"], r["row_id"]): (round(r["f"], 9), r["len"], sorted(r["places"])) for r in got if r["term"] is not None} == want
    assert {r["row_id"]: r["len"] for r in got if r["term"] is None} == {r["row_id"]: r["len"] for r in index.row_lengths(rows, WEIGHTS).collect()} and {r["version"] for r in got} == {4}
    assert all(r["places"] is None for r in index._unpacked(packed.withColumn("version", F.lit(4)), places=False).collect())
    packed.unpersist()


def _written(plan, name):
    """The largest of a metric among the shuffles of a plan that has run."""
    kind = plan.getClass().getSimpleName()
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = [plan.metrics().apply(name).value()] if kind == "ShuffleExchangeExec" else []
    return max([*own, *(_written(p, name) for p in below)], default=0)


def _asked_and_parts(spark):
    """60 queries of three phrases each, and the parts of 400 rows."""
    phrases = spark.range(60).selectExpr("id AS query_id", "0 AS run", "explode(array(0, 1, 2)) AS group_id").selectExpr("*", "concat('k', (query_id * (group_id + 1) + group_id) % 50) AS key")
    parts = spark.range(400).selectExpr("concat('r', id) AS row_id", "explode(sequence(0, 49, 1 + cast(id % 3 AS int))) AS k").selectExpr("concat('k', k) AS key", "row_id", "(1 + hash(k, row_id) % 97 / 100) AS part")
    return phrases, parts


@pytest.mark.parametrize("some", [False, True])
def test_what_is_shuffled_does_not_grow_with_queries_times_blocks(spark, monkeypatch, some):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 10)
    monkeypatch.setattr(blocks, "TASKS", 2, raising=False)
    phrases, parts = _asked_and_parts(spark)
    found = blocks.best(phrases, parts, 3, 400, some)
    assert len(found.collect()) == 60 * 3
    # 60 queries and 40 blocks: no row for each pair of them, before blocks are scored or after.
    assert _written(found._jdf.queryExecution().executedPlan(), "shuffleRecordsWritten") < 60 * 40 / 2


def test_chunks_and_spans_change_nothing(spark, monkeypatch):
    phrases, parts = _asked_and_parts(spark)
    told = lambda some: sorted((r["query_id"], r["rank"], r["row_id"], round(r["score"], 9), tuple(r["groups"])) for r in blocks.best(phrases, parts, 4, 400, some).collect())
    want = [told(some) for some in (False, True)]
    for name, value in {"BLOCK_ROWS": 30, "CHUNK_ASKS": 7, "TASKS": 20, "_PACKED": 900, "_KEPT": 10}.items():
        monkeypatch.setattr(blocks, name, value)
    assert [told(some) for some in (False, True)] == want


@pytest.mark.parametrize("buckets", [2, 32])
def test_postings_stay_where_they_are_however_many_terms_a_batch_has(spark, rows, tmp_path, monkeypatch, buckets):
    monkeypatch.setattr(index, "BUCKETS", buckets)
    held = index.repaired(rows, WEIGHTS, str(tmp_path / "i"))
    queries = spark.createDataFrame([(k, f"w{k} w{k % 7} absent{k}") for k in range(40)], "query_id long, query string")
    words = search.or_run(queries)
    told = lambda df: sorted((r["key"], r["row_id"], round(r["part"], 9), r["df"]) for r in df.collect())
    want = told(search.phrase_scores(words, held))
    for module, name, value in ((lineage, "SENT_ROWS", 10), (index, "SENT_ROWS", 10), (lineage, "HELD_ROWS", 5), (search, "HELD_ROWS", 5), (index, "LOOKED_UP", 5), (search, "LOOKED_UP", 5)):
        monkeypatch.setattr(module, name, value)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = search.phrase_scores(words, held)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and told(found) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
