"""Batched changes to notes: create and append, with gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.text import SECRETS, slug


def _has_secret(text):
    found = F.lit(False)
    for _, pattern in SECRETS:
        found = found | text.rlike(pattern)
    return found


def create_notes(requests: DataFrame, notes: DataFrame, folder: str = "knowledge", types: list[str] | None = None, tags: list[str] | None = None) -> DataFrame:
    """(title, path, outcome): secret, policy, exists or created, the first that holds. ``requests``
    has (title, body); with ``types`` and ``tags`` declared also (type, tags), which must be among them."""
    path = F.concat(F.lit(folder + "/"), slug(F.col("title")), F.lit(".md"))
    wrong = F.lit(False)
    if types is not None:
        wrong = wrong | ~F.coalesce(F.col("type").isin(*types), F.lit(False))
    if tags is not None:
        wrong = wrong | (F.size(F.array_except(F.coalesce("tags", F.expr("cast(array() as array<string>)")), F.array(*map(F.lit, tags)))) > 0)
    placed = requests.select("title", "body", path.alias("path"), wrong.alias("wrong"))
    there = notes.select("path", F.lit(True).alias("there")).distinct()
    outcome = F.when(_has_secret(F.concat_ws("\n", "title", "body")), "secret").when(F.col("wrong"), "policy").when(F.col("there"), "exists").otherwise("created")
    return placed.join(there, "path", "left").select("title", "path", outcome.alias("outcome"))


def stamped(text: Column, timestamp: str) -> Column:
    """A note's text with the timestamp of its head replaced, or added at the head's end; a text
    without a head stays as it is."""
    head = F.regexp_extract(text, r"^(\s*---[ \t]*\r?\n(?:(?!---[ \t]*\r?\n)[^\n]*\n)*?)(---[ \t]*(?:\r?\n|$))", 1)
    rest = F.substring(text, F.char_length(head) + 1, F.char_length(text))
    line = f"timestamp: {timestamp}"
    new = F.when(head.rlike(r"(?m)^timestamp:"), F.regexp_replace(head, r"(?m)^timestamp:[^\r\n]*", line)).otherwise(F.concat(head, F.lit(line + "\n")))
    return F.when(head == "", text).otherwise(F.concat(new, rest))


def append_notes(requests: DataFrame, notes: DataFrame, timestamp: str | None = None) -> DataFrame:
    """(path, outcome, new_text): missing, conflict, empty, secret, noop or update, the first that
    holds. ``requests`` has (path, addition, expected_sha256); a null or empty expectation isn't
    checked. With ``timestamp`` the head of an updated note gets it."""
    joined = requests.join(notes.select("path", "body"), "path", "left")
    addition = F.regexp_replace("addition", r"^\s+|\s+$", "")
    outcome = (
        F.when(F.col("body").isNull(), "missing")
        .when((F.col("expected_sha256") != "") & (F.col("expected_sha256") != F.sha2("body", 256)), "conflict")
        .when(F.coalesce(addition, F.lit("")) == "", "empty")
        .when(_has_secret(F.col("addition")), "secret")
        .when(F.contains("body", addition), "noop")
        .otherwise("update")
    )
    gap = F.when(F.endswith("body", F.lit("\n")), "\n").otherwise("\n\n")
    return joined.select("path", outcome.alias("outcome"), F.when(outcome == "update", F.concat(stamped(F.col("body"), timestamp) if timestamp else F.col("body"), gap, addition, F.lit("\n"))).otherwise(F.col("body")).alias("new_text"))


def merge_writes(notes: DataFrame, decisions: DataFrame, folder: str = "knowledge", types: list[str] | None = None, tags: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(changes, rejects) of a batch of decisions (query_id, action, path, append, title, description,
    type, tags) about notes (path, body).

    ``changes`` has (path, change, body): each note that is updated, with all its additions in order of
    query_id, or created. An addition that the note has by then adds nothing; no addition left is no
    change. ``rejects`` has (query_id, path, reason): conflict, secret, policy, or exists, where a note
    is to be created at a path that is taken, by a note or by an earlier one of the batch. Notes are
    joined by path, so a merge reads each once.
    """
    addition = F.regexp_replace(F.coalesce("append", F.lit("")), r"^\s+|\s+$", "")
    rows = decisions.where("action <> 'noop'").withColumn("addition", addition)
    updates = rows.where("action = 'update'")
    secret = _has_secret(F.col("addition"))
    kept = updates.where(~secret & (F.col("addition") != "")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("query_id", "addition"))).alias("own"))
    grown = lambda text, x: F.when(F.contains(text, x["addition"]), text).otherwise(F.concat(text, F.when(F.endswith(text, F.lit("\n")), "\n").otherwise("\n\n"), x["addition"], F.lit("\n")))
    updated = notes.select("path", "body").join(kept, "path").select("path", F.lit("updated").alias("change"), F.col("body").alias("was"), F.aggregate("own", F.col("body"), grown).alias("body")).where("body <> was").drop("was")
    place = F.concat(F.lit(folder + "/"), slug(F.col("title")), F.lit(".md"))
    wrong = F.trim(F.coalesce("title", F.lit(""))) == ""
    wrong = wrong | (F.trim(F.coalesce("description", F.lit(""))) == "")
    if types is not None:
        wrong = wrong | ~F.coalesce(F.col("type").isin(*types), F.lit(False))
    if tags is not None:
        wrong = wrong | (F.size(F.array_except(F.coalesce("tags", F.expr("cast(array() as array<string>)")), F.array(*map(F.lit, tags)))) > 0)
    asked = rows.where("action = 'create'").withColumn("path", place)
    asked = asked.withColumn("reason", F.when(_has_secret(F.concat_ws("\n", "title", "description", "addition")), "secret").when(wrong, "policy"))
    there = notes.select("path", F.lit(True).alias("there")).distinct()
    first = F.row_number().over(Window.partitionBy("path", F.col("reason").isNull()).orderBy("query_id"))
    asked = asked.withColumn("k", first).join(there, "path", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("there") | (F.col("k") > 1), "exists")))
    created = asked.where("reason IS NULL").select("path", F.lit("created").alias("change"), F.concat("addition", F.lit("\n")).alias("body"))
    rejects = asked.where("reason IS NOT NULL").select("query_id", "path", "reason")
    rejects = rejects.unionByName(rows.where("action = 'conflict'").select("query_id", "path", F.lit("conflict").alias("reason")))
    rejects = rejects.unionByName(updates.where(secret).select("query_id", "path", F.lit("secret").alias("reason")))
    return updated.unionByName(created), rejects
