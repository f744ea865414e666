"""Schema policy, secrets, statistics, and explanations of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.text import SECRETS, fold, query_tokens
from notelake.operators.glossary import expanded_tokens
from notelake.operators.lineage import cut, sent

REQUIRED = ("type", "title", "description", "tags", "timestamp")


def parse_schema(files: DataFrame) -> DataFrame:
    """(kind, value) of schema files (text): a profile (custom without one), and the bullets below
    ``## Types`` and ``## Tags``."""
    rows = files.withColumn("file", F.monotonically_increasing_id()).select("file", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).withColumn("line", F.regexp_replace("raw", r"^\s+|\s+$", ""))
    place = Window.partitionBy("file").orderBy("pos")
    section = F.last(F.when(F.col("line").isin("## Types", "## Tags"), F.col("line")), ignorenulls=True).over(place)
    bullets = rows.withColumn("section", section).where("startswith(line, '- ') AND section IS NOT NULL")
    value = F.regexp_replace(F.substring(F.col("line"), F.lit(3), F.char_length("line")), r"^\s+|\s+$", "")
    listed = bullets.select(F.when(F.col("section") == "## Types", "type").otherwise("tag").alias("kind"), value.alias("value")).distinct()
    named = rows.withColumn("profile", F.regexp_replace(F.regexp_extract("line", r"^Profile:\s*`?([^`]+)`?", 1), r"\s+$", "")).groupBy("file").agg(F.max_by("profile", F.when(F.col("profile") != "", F.col("pos"))).alias("profile"))
    return listed.unionByName(named.select(F.lit("profile").alias("kind"), F.coalesce("profile", F.lit("custom")).alias("value")))


#: ISO 8601: a date, and a time with or without seconds and zone.
_ISO = r"^\d{4}-?\d{2}-?\d{2}([T ]\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"


def policy_issues(notes: DataFrame, types: list[str], tags: list[str]) -> DataFrame:
    """(path, issue) of notes by their frontmatter policy.

    ``notes`` have path, ``fields`` (a map of a field to its list of values) and ``scalars`` (the
    fields that aren't lists), or plain columns type, title, description, tags (words), timestamp.
    """
    if "fields" not in notes.columns:
        text = lambda c: F.array(F.coalesce(F.col(c), F.lit("")))
        words = F.filter(F.split(F.coalesce("tags", F.lit("")), " "), lambda t: t != "")
        pairs = [x for c in REQUIRED for x in (F.lit(c), words if c == "tags" else text(c))]
        notes = notes.select("path", F.create_map(*pairs).alias("fields"), F.array(*[F.lit(c) for c in REQUIRED if c != "tags"]).alias("scalars"))
    field = lambda c: F.coalesce(F.col("fields")[c], F.expr("cast(array() as array<string>)"))
    scalar = lambda c: F.array_contains("scalars", c)
    missing = lambda c: (F.size(field(c)) == 0) | (scalar(c) & (field(c)[0] == ""))
    issues = [F.when(missing(c), F.lit(f"missing required field: {c}")) for c in REQUIRED]
    issues += [F.when(~missing(c) & (~scalar(c) | (F.trim(field(c)[0]) == "")), F.lit(f"{c} must be a non-empty string")) for c in REQUIRED if c != "tags"]
    kind, stamp = F.get(field("type"), F.lit(0)), F.get(field("timestamp"), F.lit(0))
    issues.append(F.when(~missing("type") & scalar("type") & ~kind.isin(*types), F.concat(F.lit("type '"), kind, F.lit("' is not declared in SCHEMA.md"))))
    issues.append(F.when(scalar("tags"), F.lit("tags must be a list")))
    issues.append(F.when(~missing("timestamp") & scalar("timestamp") & (F.trim(stamp) != "") & ~stamp.rlike(_ISO), F.lit("timestamp must be ISO 8601")))
    undeclared = F.when(scalar("tags"), F.expr("cast(array() as array<string>)")).otherwise(F.filter(field("tags"), lambda t: ~t.isin(*tags)))
    extra = F.transform(undeclared, lambda t: F.concat(F.lit("tag '"), t, F.lit("' is not declared in SCHEMA.md")))
    every = F.concat(F.filter(F.array(*issues), lambda x: x.isNotNull()), extra)
    return notes.select("path", F.explode(every).alias("issue"))


def secret_findings(notes: DataFrame, text_col: str = "body") -> DataFrame:
    """(path, line, kind): one row for each hit; the secret itself is never shown."""
    lines = notes.select("path", F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    kinds = F.flatten(F.array(*[F.array_repeat(F.lit(k), F.size(F.regexp_extract_all("line", F.lit(p), F.lit(0)))) for k, p in SECRETS]))
    return lines.select("path", (F.col("pos") + 1).alias("line"), F.explode(kinds).alias("kind"))


def vault_issues(parsed: DataFrame, schema: DataFrame | None) -> DataFrame:
    """(path, issue) of parsed notes: secrets first, then the parse error, else the policy's.
    ``schema`` is what parse_schema() gives; without one that is the only issue."""
    if schema is None:
        return parsed.sparkSession.createDataFrame([("SCHEMA.md", "missing schema file")], "path string, issue string")
    declared: dict[str, list[str]] = {"type": [], "tag": []}
    for row in schema.where("kind <> 'profile'").collect():  # one small file
        declared[row["kind"]].append(row["value"])
    found = secret_findings(parsed, "text").select("path", F.concat(F.lit("potential secret detected: "), F.col("kind"), F.lit(" on line "), F.col("line").cast("string")).alias("issue"))
    broken = parsed.where("error IS NOT NULL").select("path", F.col("error").alias("issue"))
    good = parsed.where("error IS NULL").select("path", F.col("frontmatter").alias("fields"), "scalars")
    return found.unionByName(broken).unionByName(policy_issues(good, declared["type"], declared["tag"]))


def check_vault(config: list[str], issues: DataFrame, stale: DataFrame) -> DataFrame:
    """(k, line): the lines of a check in order: settings, notes, index. ``stale`` is what
    index.staleness() gives."""
    first = [f"ERROR config: {x}" for x in config] or ["OK config"]
    spark = issues.sparkSession
    head = spark.createDataFrame([(k, "", x) for k, x in enumerate(first)], "k int, path string, line string")
    body = issues.select(F.lit(1000).alias("k"), "path", F.concat(F.lit("ERROR "), "path", F.lit(": "), "issue").alias("line"))
    fine = issues.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(1000).alias("k"), F.lit("").alias("path"), F.lit("OK validation").alias("line"))
    told = F.concat(F.lit("STALE index: changed "), F.col("changed").cast("string"), F.lit(", missing "), F.col("missing").cast("string"), F.lit(", removed "), F.col("removed").cast("string"))
    last = stale.select(F.lit(2000).alias("k"), F.lit("").alias("path"), F.when(F.col("changed") + F.col("missing") + F.col("removed") > 0, told).otherwise("OK index fresh").alias("line"))
    return head.unionByName(body).unionByName(fine).unionByName(last).select(F.row_number().over(Window.orderBy("k", "path", "line")).alias("k"), "line")


def vault_stats(notes: DataFrame) -> DataFrame:
    """One row: documents, characters, estimated tokens."""
    chars = F.coalesce(F.sum(F.char_length("body")), F.lit(0))
    return notes.agg(F.count("*").alias("documents"), chars.alias("chars"), F.ceil(chars / 4).alias("estimated_tokens"))


def counts_by(notes: DataFrame, column: str) -> DataFrame:
    """(value, documents) over a column's words."""
    return notes.select("path", F.explode(F.array_distinct(F.split(column, " "))).alias("value")).where("value <> ''").groupBy("value").agg(F.count("*").alias("documents"))


#: Fields in which a match is looked for.
EXPLAINED = ("title", "description", "tags", "aliases", "systems", "signals", "body", "passage")


def explain_matches(results: DataFrame, queries: DataFrame, rows: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """(query_id, row_id, term, fields): which fields of a result hold each query word, and each
    synonym that the glossary adds, as a substring without case and accents; fields in order.

    ``rows`` has row_id and those of the fields there are, ``passage`` for results that are one. Words
    come first, then synonyms; of equal ones the first counts. Terms found nowhere are left out.
    """
    words = queries.select("query_id", query_tokens(F.col("query")).alias("words"))
    if glossary is not None:
        words = words.join(sent(expanded_tokens(queries, glossary)), "query_id", "left").select("query_id", F.concat("words", F.coalesce("tokens", F.expr("cast(array() as array<string>)"))).alias("words"))
    keys = F.transform("words", fold)
    terms = words.withColumn("keys", keys).select("query_id", F.filter(F.transform("words", lambda w, i: F.struct(w.alias("term"), F.get("keys", i).alias("key"), i.alias("i"))), lambda t: (F.array_position("keys", t["key"]) == t["i"] + 1) & (t["key"] != "")).alias("terms"))
    here = [f for f in EXPLAINED if f in rows.columns]
    fields = F.array(*[F.struct(F.lit(f).alias("field"), fold(F.coalesce(F.col(f), F.lit(""))).alias("text")) for f in sorted(here)])
    asked = cut(results.select("query_id", "row_id"))
    shown = asked.join(rows.join(sent(asked.select("row_id").distinct()), "row_id", "left_semi").select("row_id", fields.alias("fields")), "row_id").join(terms, "query_id")
    each = shown.select("query_id", "row_id", "fields", F.explode("terms").alias("t"))
    holding = F.transform(F.filter("fields", lambda f: F.contains(f["text"], F.col("t.key"))), lambda f: f["field"])
    return each.select("query_id", "row_id", F.col("t.term").alias("term"), F.array_join(holding, ",").alias("fields")).where("fields <> ''")
