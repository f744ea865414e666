"""Retrieval-quality and decision metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.text import approx_tokens
from notelake.operators import grams


def per_topic(run: DataFrame, qrels: DataFrame, topics: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, mrr, ndcg) at k for every topic. ``run`` has (query_id, path, rank), of
    which only a path's best rank counts; ``qrels`` (query_id, path, relevance). A topic without
    relevant notes has recall 1 and the rest 0."""
    once = run.groupBy("query_id", "path").agg(F.min("rank").alias("r"))
    once = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("r", "path"))).where(F.col("rank") <= k)
    relevant = qrels.where("relevance > 0")
    gain = (F.pow(2.0, F.col("relevance")) - 1) / F.log2(F.col("rank") + 1.0)
    got = once.join(relevant, ["query_id", "path"]).groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(gain).alias("dcg"))
    best = relevant.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "path")))
    ideal = best.groupBy("query_id").agg(F.count("*").alias("total"), F.sum(F.when(F.col("rank") <= k, gain)).alias("idcg"))
    joined = topics.select("query_id").join(ideal, "query_id", "left").join(got, "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    recall = F.when(zero("total") == 0, 1.0).otherwise(zero("hits") / F.col("total"))
    return joined.select("query_id", F.round(recall, 6).alias("recall"), F.round(F.when(F.col("first").isNull(), 0.0).otherwise(1.0 / F.col("first")), 6).alias("mrr"), F.round(F.when(zero("idcg") == 0, 0.0).otherwise(zero("dcg") / F.col("idcg")), 6).alias("ndcg"))


def holders(items: DataFrame, notes: DataFrame, trigrams: grams.Grams | None = None) -> DataFrame:
    """(query_id, path): the notes (path, body) that hold the whole text of an item (query_id, text).
    ``trigrams`` of the bodies may be kept between calls. Every note holds an empty item."""
    rows = notes.select(F.col("path").alias("row_id"), F.col("body").alias("hay"))
    searches = items.where("text <> ''").select("query_id", F.array("text").alias("words"))
    found = grams.holding(searches, rows, trigrams or grams.built(rows)).withColumnRenamed("row_id", "path")
    empty = [r["query_id"] for r in items.where("text = ''").select("query_id").collect()]  # items are few, these are fewer
    if not empty:
        return found
    return found.unionByName(notes.select(F.explode(F.array(*[F.lit(q).cast(items.schema["query_id"].dataType) for q in empty])).alias("query_id"), "path"))


def grep_summary(run: DataFrame, qrels: DataFrame, topics: DataFrame, notes: DataFrame, most: int) -> DataFrame:
    """One row about a baseline that reads every note it finds: topics, mean recall, MRR and nDCG at
    ``most``, how many topics without an answer (query_id, category) found something, notes read and
    their tokens, and means of these. ``run`` has (query_id, path, rank)."""
    read = run.join(notes.select("path", approx_tokens(F.col("body")).alias("tokens")), "path").groupBy("query_id").agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens"))
    rows = per_topic(run, qrels, topics, most).join(topics.select("query_id", "category"), "query_id").join(read, "query_id", "left").fillna(0, ["files", "tokens"])
    mean = lambda c: F.round(F.avg(c), 4)
    silent = F.count_if(F.col("category") == "no_answer")
    wrong = F.round(F.when(silent > 0, F.count_if((F.col("category") == "no_answer") & (F.col("files") > 0)) / silent).otherwise(0.0), 4)
    return rows.agg(F.count("*").alias("topics"), mean("recall").alias("mean_recall"), mean("mrr").alias("mean_mrr"), mean("ndcg").alias("mean_ndcg"), wrong.alias("false_positive_rate"), F.sum("files").alias("files_read"), mean("files").alias("mean_files_read"), F.sum("tokens").alias("returned_tokens"), mean("tokens").alias("mean_returned_tokens"))


def by_slice(metrics: DataFrame, topics: DataFrame, full_tokens: DataFrame, packets: DataFrame, budget: int) -> DataFrame:
    """Metrics of each category of topics (query_id, category).

    ``metrics`` is what per_topic() gives, ``full_tokens`` one row (corpus), ``packets`` has
    (query_id, used_tokens, source_count). Topics of no_answer should have no sources.
    """
    rows = topics.select("query_id", "category").join(metrics, "query_id").join(packets.select("query_id", "used_tokens", "source_count"), "query_id").crossJoin(F.broadcast(full_tokens))
    mean = lambda c, name: F.round(F.avg(c), 4).alias(name)
    silent = F.count_if(F.col("category") == "no_answer")
    wrong = F.count_if((F.col("category") == "no_answer") & (F.col("source_count") > 0))
    full = F.max("corpus") * F.count("*")
    return rows.groupBy("category").agg(
        F.count("*").alias("topics"),
        mean("recall", "recall"),
        mean("mrr", "mrr"),
        mean("ndcg", "ndcg"),
        F.sum("used_tokens").alias("returned_tokens"),
        mean("used_tokens", "mean_returned_tokens"),
        F.when(full > 0, F.round(1 - F.sum("used_tokens") / full, 4)).otherwise(0.0).alias("context_reduction"),
        F.round(F.avg((F.col("used_tokens") <= budget).cast("int")), 4).alias("budget_compliance_rate"),
        F.when(silent > 0, F.round(wrong / silent, 4)).otherwise(0.0).alias("false_positive_rate"),
    )


def corpus_metadata(notes: DataFrame, topics: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row about an evaluation: notes, topics, judgements, answerable topics, mean positives."""
    positive = qrels.where("relevance > 0").groupBy("query_id").agg(F.count("*").alias("n"))
    asked = topics.select("query_id", "category").join(positive, "query_id", "left")
    answerable = F.count_if(F.col("category") != "no_answer")
    mean = F.round(F.coalesce(F.avg(F.when(F.col("category") != "no_answer", F.coalesce("n", F.lit(0)))), F.lit(0.0)), 4)
    one = asked.agg(F.count("*").alias("topics"), answerable.alias("answerable_topics"), F.count_if(F.col("category") == "no_answer").alias("no_answer_topics"), mean.alias("mean_positive_qrels"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("slices"))
    judged = qrels.agg(F.count("*").alias("qrel_rows"), F.count_if(F.col("relevance") > 0).alias("positive_qrels"))
    return one.crossJoin(judged).crossJoin(notes.agg(F.count("*").alias("notes")))


def agent_tasks(tasks: DataFrame, contexts: DataFrame) -> DataFrame:
    """(query_id, slice, facts, covered, coverage, paths_found, sufficient, abstained, correct_abstention)
    of tasks (query_id, slice, expected_paths, expected_facts, expect_abstention) by the contexts
    (query_id, context, sources) that they were given; sources are paths with spaces between."""
    rows = tasks.join(contexts.select("query_id", "context", "sources"), "query_id", "left")
    context, found = F.lower(F.coalesce("context", F.lit(""))), F.split(F.coalesce("sources", F.lit("")), " ")
    empty = F.expr("cast(array() as array<string>)")
    facts, paths = F.coalesce("expected_facts", empty), F.coalesce("expected_paths", empty)
    covered = F.size(F.filter(facts, lambda f: F.contains(context, F.lower(f))))
    coverage = F.round(F.when(F.size(facts) == 0, 1.0).otherwise(covered / F.size(facts)), 4)
    all_paths = F.size(F.array_except(paths, found)) == 0
    abstained = context == ""
    sufficient = F.when(F.col("expect_abstention"), abstained).otherwise(all_paths & (covered == F.size(facts)))
    return rows.select("query_id", "slice", F.size(facts).alias("facts"), covered.alias("covered"), coverage.alias("coverage"), all_paths.alias("paths_found"), sufficient.alias("sufficient"), abstained.alias("abstained"), (abstained == F.col("expect_abstention")).alias("correct_abstention"))


def agent_summary(results: DataFrame) -> DataFrame:
    """(slice, tasks, sufficiency, abstention_accuracy, mean_coverage, stddev_coverage)."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 4)
    return results.groupBy("slice").agg(F.count("*").alias("tasks"), rate("sufficient").alias("sufficiency"), rate("correct_abstention").alias("abstention_accuracy"), F.round(F.avg("coverage"), 4).alias("mean_coverage"), F.round(F.stddev_pop("coverage"), 4).alias("stddev_coverage"))


def writeback_summary(cases: DataFrame) -> DataFrame:
    """One row of rates over (expected_action, action, expected_path, path, expected_reason, reason,
    candidates, margin, changed, present): how often decisions, targets and reasons are right, what
    updates and creations are worth, and whether nothing is written twice or over a conflict. A rate
    over nothing is 1."""
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    decision, target = same("action", "expected_action"), F.col("expected_path").isNull() | same("path", "expected_path")
    reason = same("reason", "expected_reason")
    right = decision & target & reason
    e, a = F.col("expected_action"), F.col("action")

    def rate(good: Column, among: Column) -> Column:
        n = F.count_if(among)
        return F.round(F.when(n > 0, F.count_if(among & good) / n).otherwise(1.0), 4)

    every = F.lit(True)
    return cases.agg(
        F.count("*").alias("cases"),
        rate(decision, every).alias("decision_accuracy"),
        rate(target, F.col("expected_path").isNotNull()).alias("target_path_accuracy"),
        rate(reason, F.col("expected_reason").isNotNull()).alias("reason_accuracy"),
        rate(right, a == "update").alias("update_precision"),
        rate(right, e == "update").alias("update_recall"),
        rate(right, a == "create").alias("create_precision"),
        rate(right, e == "create").alias("create_recall"),
        rate(right, e == "noop").alias("noop_accuracy"),
        rate(a == "conflict", e == "conflict").alias("conflict_detection_rate"),
        rate(~F.col("present"), e == "conflict").alias("conflict_write_block_rate"),
        rate((a != "create") & target, e != "create").alias("duplicate_avoidance_rate"),
        rate(a == "update", e == "create").alias("false_update_rate"),
        rate(a == "create", e != "create").alias("false_create_rate"),
        rate((a == "noop") & ~F.col("changed"), e == "noop").alias("idempotency_rate"),
        F.coalesce(F.median("candidates"), F.lit(0.0)).alias("median_candidate_count"),
        F.round(F.coalesce(F.avg("margin"), F.lit(0.0)), 4).alias("mean_similarity_margin"),
    )


def golden_prefix(run: DataFrame, golden: DataFrame) -> DataFrame:
    """(query_id, verdict): whether a run's paths begin with the expected ones, in order."""
    mine = run.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("s")).select("query_id", F.transform("s", lambda x: x["path"]).alias("mine"))
    theirs = golden.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("s")).select("query_id", F.transform("s", lambda x: x["path"]).alias("expected"))
    verdict = F.when(F.col("mine").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.slice("mine", F.lit(1), F.size("expected")) == F.col("expected"), "match").otherwise("differs")
    return mine.join(theirs, "query_id", "full_outer").select("query_id", verdict.alias("verdict"))


def token_reduction(returned: Column, compared: Column) -> Column:
    return F.when(compared > 0, F.round(1 - returned / compared, 4)).otherwise(0.0)


def latency_summary(samples: DataFrame, by: str, value: str) -> DataFrame:
    """(by, min, p50, p95, max): p50 is the median, p95 the value at the nearest index."""
    values = samples.where(F.col(value).isNotNull())
    order = Window.partitionBy(by).orderBy(value)
    placed = values.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy(by)))
    at = F.rint((F.col("n") - 1) * 0.95)  # halves go to the even index
    return placed.groupBy(by).agg(F.round(F.min(value), 3).alias("min"), F.round(F.median(value), 3).alias("p50"), F.round(F.max(F.when(F.col("i") == at, F.col(value))), 3).alias("p95"), F.round(F.max(value), 3).alias("max"))


def deltas(history: DataFrame, higher_is_better: bool = True) -> DataFrame:
    """(label, date, value, delta, trend, verdict): each value against the one before; of rows that
    repeat a date and label the last value in order counts."""
    last = history.groupBy("date", "label").agg(F.max_by("value", "seq").alias("value"))
    before = F.lag("value").over(Window.partitionBy("label").orderBy("date"))
    moved = last.withColumn("delta", F.round(F.col("value") - before, 4))
    trend = F.when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down").otherwise("flat")
    good = F.when(F.col("delta").isNull() | (F.col("delta") == 0), "same").when((F.col("delta") > 0) == F.lit(higher_is_better), "better").otherwise("worse")
    return moved.select("label", "date", F.round("value", 4).alias("value"), "delta", trend.alias("trend"), good.alias("verdict"))


def sufficiency(contexts: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, facts, covered, coverage): facts found in the context in any case; 1 without facts."""
    joined = contexts.join(facts, "query_id", "left")
    hit = F.count_if(F.contains(F.lower("context"), F.lower("fact")))
    n = F.count("fact")
    return joined.groupBy("query_id").agg(n.alias("facts"), hit.alias("covered"), F.round(F.when(n == 0, 1.0).otherwise(hit / n), 4).alias("coverage"))
