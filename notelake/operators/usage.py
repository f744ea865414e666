"""Usage-log analytics over events (timestamp, command, status, duration_ms, data), data a JSON object."""

from __future__ import annotations

import html
import json

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from notelake.functions.text import SECRETS, query_tokens, redact

#: Commands that write.
WRITES = ("add", "capture", "update")
#: Payload keys that are never logged, at any depth and in any case.
DROPPED_KEYS = ("body", "content", "snippet", "append", "append_text")
#: What a log must hold before ranking is decided on, and the rate that is watched.
LEAST_EVENTS, LEAST_SEARCHES, LEAST_RETRIEVES, WATCHED = 30, 10, 5, 0.2

_PAYLOAD = "struct<query:string,query_terms:array<string>,result_paths:array<string>,source_paths:array<string>,path:string,document:string,used_tokens:double,tokens:double,estimated_tokens:double,result_count:double,source_count:double,mode:string,ranker:string,requested_ranker:string>"


def _clean(value):
    if isinstance(value, str):
        for kind, pattern in SECRETS:
            value = regex.sub(pattern, f"[REDACTED:{kind}]", value)
        return value
    if isinstance(value, dict):
        return {k: _clean(v) for k, v in value.items() if k.lower() not in DROPPED_KEYS}
    if isinstance(value, list):
        return [_clean(v) for v in value]
    return value


@F.pandas_udf(StringType())
def _sanitized(payloads: pd.Series) -> pd.Series:
    def one(text):
        if text is None:
            return None
        try:
            return json.dumps(_clean(json.loads(text)), ensure_ascii=False, sort_keys=True)
        except ValueError:
            return None

    return payloads.map(one)


def sanitized(events: DataFrame, data_col: str = "data") -> DataFrame:
    """The events with dropped keys taken out of their JSON payload at any depth, secrets redacted in
    every string of it, and the words of its query added; payloads that aren't JSON become null. A
    payload has any shape, which no built-in walks: an Arrow UDF does."""
    cleaned = events.withColumn(data_col, _sanitized(F.col(data_col).cast("string")))
    query = F.get_json_object(data_col, "$.query")
    terms = F.to_json(F.struct(query_tokens(query).alias("query_terms")))
    joined = F.concat(F.substring(F.col(data_col), F.lit(1), F.char_length(data_col) - 1), F.lit(", "), F.substring(terms, F.lit(2), F.char_length(terms)))
    return cleaned.withColumn(data_col, F.when(query.isNotNull() & (F.get_json_object(data_col, "$.query_terms").isNull()), joined).otherwise(F.col(data_col)))


def parsed(events: DataFrame, data_col: str = "data") -> DataFrame:
    """The events with the known fields of their payload as a struct ``payload``."""
    return events.withColumn("payload", F.from_json(data_col, _PAYLOAD))


def documents_of(payload: Column) -> Column:
    """The paths that a payload names, in order: results, sources, path, document."""
    single = F.array(payload["path"], payload["document"])
    empty = F.expr("cast(array() as array<string>)")
    every = F.concat(F.coalesce(payload["result_paths"], empty), F.coalesce(payload["source_paths"], empty), single)
    return F.filter(every, lambda x: x.isNotNull() & (x != ""))


def tokens_of(payload: Column) -> Column:
    """The first of used_tokens, tokens and estimated_tokens, whole; 0 without any."""
    return F.coalesce(payload["used_tokens"], payload["tokens"], payload["estimated_tokens"], F.lit(0.0)).cast("long")


def summary(events: DataFrame, searches: tuple[str, ...] = ("search",), retrieves: tuple[str, ...] = ("retrieve",), writes: tuple[str, ...] = WRITES, time_col: str = "ts", order_col: str | None = None) -> DataFrame:
    """One row: events, the times of the first and last event in the log's order (``order_col``; by
    time without one), searches, retrieves, writes, errors, mean duration
    (missing ones count) and estimated tokens."""
    among = lambda names: F.count_if(F.col("command").isin(*names))
    total = F.count("*")
    mean = F.when(total > 0, F.round(F.sum(F.coalesce("duration_ms", F.lit(0.0))) / total, 3)).otherwise(0.0)
    tokens = F.coalesce(F.sum(tokens_of(F.col("payload"))), F.lit(0)).alias("total_estimated_tokens")
    return parsed(events).agg(total.alias("events"), F.min_by(time_col, order_col or time_col).alias("first_event"), F.max_by(time_col, order_col or time_col).alias("last_event"), among(searches).alias("searches"), among(retrieves).alias("retrieves"), among(writes).alias("writes"), F.count_if(F.coalesce("status", F.lit("")) != "ok").alias("errors"), mean.alias("avg_duration_ms"), tokens)


def by_command(events: DataFrame) -> DataFrame:
    return events.groupBy(F.coalesce("command", F.lit("unknown")).alias("command")).agg(F.count("*").alias("events"), F.count_if(F.coalesce("status", F.lit("")) != "ok").alias("errors"))


def _most(values: DataFrame, limit: int) -> DataFrame:
    """(value, count) of the most frequent values of (value, at); ties go to the one seen first."""
    return values.groupBy("value").agg(F.count("*").alias("count"), F.min("at").alias("first")).orderBy(F.desc("count"), "first", "value").limit(limit).select("value", "count")


def top_documents(events: DataFrame, order_col: str, limit: int = 10) -> DataFrame:
    """The documents that payloads name most often."""
    each = parsed(events).select(F.posexplode(documents_of(F.col("payload"))).alias("k", "value"), F.col(order_col).alias("o"))
    return _most(each.select("value", F.struct("o", "k").alias("at")), limit)


def top_terms(events: DataFrame, order_col: str, limit: int = 10) -> DataFrame:
    """The query words that payloads hold most often, in lower case."""
    each = parsed(events).select(F.posexplode(F.filter(F.col("payload.query_terms"), lambda t: t.isNotNull() & (t != ""))).alias("k", "value"), F.col(order_col).alias("o"))
    return _most(each.select(F.lower("value").alias("value"), F.struct("o", "k").alias("at")), limit)


def query_examples(events: DataFrame, order_col: str, limit: int = 10) -> DataFrame:
    """(query): the first different queries of the log, redacted."""
    asked = parsed(events).select(redact(F.col("payload.query")).alias("query"), F.col(order_col).alias("o")).where("query <> ''")
    return asked.groupBy("query").agg(F.min("o").alias("o")).orderBy("o", "query").limit(limit).select("query")


def evidence(events: DataFrame, search: str = "search", retrieve: str = "retrieve", writes: tuple[str, ...] = WRITES) -> DataFrame:
    """One row: ten counts, five rates, and two notes with a status each: whether the log is enough to
    decide on ranking, and whether questions without an answer are frequent."""
    p, command = F.col("payload"), F.col("command")
    rate = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 4)
    counts = {
        "events": F.count("*"),
        "searches": F.count_if(command == search),
        "retrieves": F.count_if(command == retrieve),
        "writes": F.count_if(command.isin(*writes)),
        "errors": F.count_if(F.coalesce("status", F.lit("")) != "ok"),
        "zero_result_searches": F.count_if((command == search) & (p["result_count"] == 0)),
        "zero_source_retrieves": F.count_if((command == retrieve) & (p["source_count"] == 0)),
        "passage_retrieves": F.count_if((command == retrieve) & (p["mode"] == "passages")),
        "auto_ranker_retrieves": F.count_if((command == retrieve) & (p["requested_ranker"] == "auto")),
        "rrf_searches": F.count_if((command == search) & (p["ranker"] == "rrf")),
    }
    rates = {
        "zero_result_search_rate": rate("zero_result_searches", "searches"),
        "zero_source_retrieve_rate": rate("zero_source_retrieves", "retrieves"),
        "retrieve_per_search_rate": rate("retrieves", "searches"),
        "passage_retrieve_rate": rate("passage_retrieves", "retrieves"),
        "error_rate": rate("errors", "events"),
    }
    out = parsed(events).agg(*[c.alias(n) for n, c in counts.items()]).withColumns(rates)
    enough = (F.col("events") >= LEAST_EVENTS) & (F.col("searches") >= LEAST_SEARCHES) & (F.col("retrieves") >= LEAST_RETRIEVES)
    often = (F.col("zero_result_search_rate") >= WATCHED) | (F.col("zero_source_retrieve_rate") >= WATCHED)
    return out.withColumns({"ranker_status": F.when(enough, "ready_for_review").otherwise("needs_more_usage"), "no_answer_status": F.when(often, "watch").otherwise("ok")})


def report(events: DataFrame, order_col: str, title: str = "Usage report") -> str:
    """The summary, commands, terms and documents as an HTML page. All that is collected is a row, and
    at most ten rows of each list and one for each command."""
    row = summary(events, time_col=order_col).first()
    bar = lambda rows: "".join(f"<li>{html.escape(str(r[0]))}: {r[1]}</li>" for r in rows) or "<li>none</li>"
    lists = {"Commands": by_command(events).select("command", "events").orderBy("command").collect(), "Query terms": top_terms(events, order_col).collect(), "Documents": top_documents(events, order_col).collect()}
    figures = "".join(f"<li>{name}: {html.escape(str(row[name]))}</li>" for name in row.asDict())
    parts = "".join(f"<h2>{name}</h2><ul>{bar(rows)}</ul>" for name, rows in lists.items())
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><ul>{figures}</ul>{parts}</body></html>"
