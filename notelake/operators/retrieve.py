"""Context packets: ranked sources fitted into a character budget, secrets redacted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.functions.text import fit, redact
from notelake.operators import search
from notelake.operators.index import Index
from notelake.operators.lineage import cut

CHARS_PER_TOKEN = 4
SEPARATOR = "\n---\n"


def packets(results: DataFrame, rows: DataFrame, budget: int, heading: bool = False) -> DataFrame:
    """(query_id, context, used_tokens, source_count, sources): an ordered fold over each query's
    ranked sources.

    A source's content is fitted into what is left, then redacted; the fold stops when nothing is
    left or a content filled its room exactly. ``results`` has (query_id, row_id, snippet, rank);
    ``rows`` has path, type, title, tags and body, and with ``heading`` also passage_id, heading
    and lines. Queries without sources have no row.
    """
    most = budget * CHARS_PER_TOKEN
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("")), F.lit("\n"))
    tags = F.array_join(F.filter(F.split("tags", r"\s+"), lambda t: t != ""), ", ")
    extra = [line("heading", F.col("heading")), line("lines", F.col("lines"))] if heading else []
    prefix = F.concat(line("path", F.col("path")), line("title", F.col("title")), line("type", F.col("type")), line("tags", tags), *extra)
    sources = results.select("query_id", "row_id", "snippet", "rank").join(rows.withColumn("row_id", F.col("path") if not heading else F.col("passage_id")).withColumn("prefix", prefix), "row_id")
    sources = sources.withColumn("prefix", F.concat("prefix", line("snippet", F.col("snippet")), F.lit("content:\n")))
    lists = sources.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "path", "prefix", "body"))).alias("own"))
    start = F.struct(F.lit("").alias("context"), F.lit(False).alias("over"), F.expr("cast(array() as array<string>)").alias("paths"))

    def step(done, s):
        sep = F.when(done["context"] == "", F.lit("")).otherwise(F.lit(SEPARATOR))
        room = F.lit(most) - F.char_length(done["context"]) - F.char_length(sep) - F.char_length(s["prefix"])
        content = fit(s["body"], room)
        context = F.concat(done["context"], redact(F.concat(sep, s["prefix"], content)))
        over = (F.char_length(context) >= most) | (F.char_length(content) >= room)
        stays = done["over"] | (room <= 0)
        return F.struct(F.when(stays, done["context"]).otherwise(context).alias("context"), (stays | over).alias("over"), F.when(stays, done["paths"]).otherwise(F.concat(done["paths"], F.array(s["path"]))).alias("paths"))

    folded = lists.select("query_id", F.aggregate("own", start, step).alias("p"))
    return folded.select("query_id", F.col("p.context").alias("context"), F.ceil(F.char_length("p.context") / CHARS_PER_TOKEN).alias("used_tokens"), F.size("p.paths").alias("source_count"), F.array_join("p.paths", " ").alias("sources"))


def retrieve(queries: DataFrame, index: Index, rows: DataFrame, limit: int = 3, budget: int = 1000, glossary: DataFrame | None = None, ranker: str = "bm25", heading: bool = False, **filters) -> DataFrame:
    """(query_id, ranker, context, used_tokens, source_count, sources) of every query (query_id, query).

    ``rows`` are notes, or passages with ``heading``. With the ranker auto, bm25 is asked first,
    and rrf for the queries that it gives no context; a query without any has an empty one.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    if budget <= 0:
        raise ValueError("budget must be positive")
    if ranker not in (*search.RANKERS, "auto"):
        raise ValueError("ranker must be 'bm25', 'rrf', or 'auto'")
    named = rows.withColumn("path", F.col("passage_id")) if heading else rows

    def attempt(asked: DataFrame, by: str) -> DataFrame:
        found = cut(search.search(asked, index, limit, glossary, by, named if any(filters.values()) else None, **filters))
        shown = found.join(search.best_snippets(found, named, asked), ["query_id", "row_id"])
        return cut(packets(shown, rows, budget, heading).where("context <> ''").withColumn("ranker", F.lit(by)))

    first = attempt(queries, "bm25" if ranker == "auto" else ranker)
    if ranker == "auto":
        first = first.unionByName(attempt(queries.join(first.select("query_id"), "query_id", "left_anti"), "rrf"))
    last = "rrf" if ranker == "auto" else ranker
    every = queries.select("query_id").join(first, "query_id", "left")
    empty = lambda c, value: F.coalesce(F.col(c), F.lit(value)).alias(c)
    return every.select("query_id", empty("ranker", last), empty("context", ""), empty("used_tokens", 0), empty("source_count", 0), empty("sources", ""))
