"""Evaluation inputs, settings and archives of a vault."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.operators.checks import secret_findings

_TOPIC = "struct<id:string,query:string,category:string,budget:string,limit:string,type:string,tag:string,system:string,mode:string,ranker:string,compare_mode:string,compare_ranker:string>"
_TASK = "struct<id:string,query_id:string,question:string,slice:string,expected_paths:array<string>,expected_facts:array<string>,expect_abstention:boolean,budget:string,mode:string,ranker:string,type:string,system:string>"
_CASE = "struct<id:string,query:string,append:string,title:string,description:string,type:string,tags:array<string>,systems:array<string>,signals:array<string>,category:string,expected_action:string,expected_path:string,expected_reason:string,folder:string,simulate_conflict:boolean>"
MODES, RANKERS, ACTIONS = ("documents", "passages"), ("bm25", "rrf"), ("create", "update", "noop", "conflict")


def _json_lines(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """(file, line, raw, row) of a JSON-lines file's lines that aren't blank."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    lines = files.select("file", F.posexplode(F.split("value", "\n")).alias("k", "raw")).where("trim(raw) <> ''")
    return lines.select("file", (F.col("k") + 1).alias("line"), "raw", F.from_json("raw", shape).alias("row"))


def _errors(rows: DataFrame, checks: dict[str, object]) -> DataFrame:
    """(file, line, error) of the checks that hold, an array of messages in order."""
    found = F.filter(F.array(*[F.when(bad, F.lit(message)) for message, bad in checks.items()]), lambda e: e.isNotNull())
    return rows.select("file", "line", F.explode(found).alias("error"))


def _positive(text) -> object:
    return F.coalesce(text.try_cast("int") > 0, F.lit(False))


def _listed(column):
    """A JSON string or array of strings as an array without empty entries."""
    many = F.from_json(column, "array<string>")
    return F.filter(F.when(column.startswith("["), many).otherwise(F.array(column)), lambda x: x.isNotNull() & (x != ""))


def read_topics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Topics of a JSON-lines file, and (file, line, error) of what is wrong with them.

    Topics have (query_id, query, category, budget, limit, type, tags, systems, mode, ranker,
    compare_mode, compare_ranker); those without an id or a query are left out.
    """
    rows = _json_lines(spark, path, _TOPIC)
    object_ = F.get_json_object("raw", "$").startswith("{")
    rows = rows.withColumn("again", F.row_number().over(_by("row.id")) > 1)
    r = F.col("row")
    text = lambda c: F.coalesce(r[c], F.lit("")) != ""
    bad = lambda c, allowed: r[c].isNotNull() & (r[c] != "") & ~r[c].isin(*allowed)
    issues = _errors(
        rows,
        {
            "topic must be a JSON object": ~F.coalesce(object_, F.lit(False)),
            "id must be a non-empty string": F.coalesce(object_, F.lit(False)) & ~text("id"),
            "duplicate topic id": text("id") & F.col("again"),
            "query must be a non-empty string": text("id") & ~text("query"),
            "budget must be a positive integer": r["budget"].isNotNull() & ~_positive(r["budget"]),
            "limit must be a positive integer": r["limit"].isNotNull() & ~_positive(r["limit"]),
            "mode must be 'documents' or 'passages'": bad("mode", MODES),
            "ranker must be 'bm25' or 'rrf'": bad("ranker", RANKERS),
            "compare_mode must be 'documents' or 'passages'": bad("compare_mode", MODES),
            "compare_ranker must be 'bm25' or 'rrf'": bad("compare_ranker", RANKERS),
        },
    )
    none = rows.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(path).alias("file"), F.lit(0).alias("line"), F.lit("expected at least one topic").alias("error"))
    default = lambda c, value: F.coalesce(r[c], F.lit(value)).alias(c)
    number = F.when(_positive(r["budget"]), r["budget"].try_cast("int")).otherwise(600).alias("budget")
    topics = rows.where(text("id") & text("query")).select(
        r["id"].alias("query_id"), r["query"].alias("query"), default("category", "general"), number, F.when(_positive(r["limit"]), r["limit"].try_cast("int")).alias("limit"), r["type"].alias("type"),
        _listed(r["tag"]).alias("tags"), _listed(r["system"]).alias("systems"), default("mode", "documents"), default("ranker", "bm25"), r["compare_mode"].alias("compare_mode"), r["compare_ranker"].alias("compare_ranker"),
    )
    return topics, issues.unionByName(none)


def _by(key: str):
    from pyspark.sql import Window

    return Window.partitionBy("file", F.col(key)).orderBy("line")


def read_qrels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(query_id, path, relevance) of a tab-separated file, and (file, line, error). Blank lines,
    those that begin with # and a head are left out; of rows that repeat a pair the last counts."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    rows = files.select("file", F.posexplode(F.split("value", "\n")).alias("k", "raw")).where("trim(raw) <> '' AND NOT startswith(raw, '#') AND NOT (k = 0 AND startswith(lower(raw), 'query_id\t'))")
    rows = rows.select("file", (F.col("k") + 1).alias("line"), F.split(F.regexp_replace("raw", "\r$", ""), "\t").alias("p"))
    three = F.size("p") == 3
    part = lambda k: F.get("p", F.lit(k))
    number = part(2).try_cast("int")
    named = three & (part(0) != "") & (part(1) != "")
    issues = _errors(rows, {"qrel must have query_id, path, relevance": ~three, "query_id and path must be non-empty": three & ~named, "relevance must be an integer": named & number.isNull(), "relevance must be non-negative": named & (number < 0)})
    good = rows.where(named & (number >= 0)).select(part(0).alias("query_id"), part(1).alias("path"), number.alias("relevance"), "line")
    return good.groupBy("query_id", "path").agg(F.max_by("relevance", "line").alias("relevance")), issues


def read_tasks(spark: SparkSession, path: str, notes: DataFrame | None = None, topics: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Tasks of a JSON-lines file, and (file, line, error). With ``notes`` (path) the expected paths,
    with ``topics`` (query_id) the query must exist."""
    rows = _json_lines(spark, path, _TASK).withColumn("again", F.row_number().over(_by("row.id")) > 1)
    r = F.col("row")
    text = lambda c: F.coalesce(r[c], F.lit("")) != ""
    issues = _errors(rows, {"id must be a non-empty string": ~text("id"), "duplicate id": text("id") & F.col("again"), "question must be a non-empty string": ~text("question"), "budget must be a positive integer": r["budget"].isNotNull() & ~_positive(r["budget"])})
    if topics is not None:
        lost = rows.where("row.query_id <> ''").join(topics.select(F.col("query_id").alias("known")), F.col("row.query_id") == F.col("known"), "left_anti")
        issues = issues.unionByName(lost.select("file", "line", F.concat(F.lit("query_id does not exist: "), "row.query_id").alias("error")))
    if notes is not None:
        each = rows.select("file", "line", F.explode("row.expected_paths").alias("path")).join(notes.select("path"), "path", "left_anti")
        issues = issues.unionByName(each.select("file", "line", F.concat(F.lit("expected path does not exist: "), "path").alias("error")))
    budget = F.when(_positive(r["budget"]), r["budget"].try_cast("int")).otherwise(1000)
    default = lambda c, value: F.coalesce(r[c], F.lit(value)).alias(c)
    plain = [r[c].alias(c) for c in ("id", "query_id", "question", "slice", "expected_paths", "expected_facts")]
    tasks = rows.where(text("id") & text("question")).select(*plain, default("expect_abstention", False), budget.alias("budget"), default("mode", "documents"), default("ranker", "bm25"))
    return tasks, issues


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Write-back cases of a JSON-lines file, and (file, line, error)."""
    rows = _json_lines(spark, path, _CASE).withColumn("again", F.row_number().over(_by("row.id")) > 1)
    r = F.col("row")
    text = lambda c: F.coalesce(r[c], F.lit("")) != ""
    issues = _errors(rows, {"id must be a non-empty string": ~text("id"), "duplicate id": text("id") & F.col("again"), "append must be a non-empty string": ~text("append"), "unknown expected_action": ~F.coalesce(r["expected_action"].isin(*ACTIONS), F.lit(False))})
    return rows.where(text("id") & text("append")).select("row.*"), issues


def config_issues(text: str | None) -> list[str]:
    """What is wrong with a vault's settings, one small JSON file; nothing without a file."""
    if text is None:
        return []
    try:
        data = json.loads(text)
    except ValueError as error:
        return [f"config invalid JSON: {error}"]
    if not isinstance(data, dict):
        return ["config must be an object"]
    issues = []
    for key in ("exclude", "generated_guides"):
        value = data.get(key, [])
        if not (isinstance(value, list) and all(isinstance(x, str) for x in value)):
            issues.append(f"config {key} must be a list of strings")
    most, tracked = data.get("search_limit"), data.get("usage_tracking")
    if most is not None and not (isinstance(most, int) and most > 0):
        issues.append("config search_limit must be a positive integer")
    if tracked is not None and not isinstance(tracked, bool):
        issues.append("config usage_tracking must be a boolean")
    return issues


def read_note(spark: SparkSession, root: str, rel: str) -> str:
    """The whole text of one file of a vault; ValueError outside of it, FileNotFoundError without one."""
    parts = rel.split("/")
    if rel.startswith("/") or ".." in parts:
        raise ValueError("path must stay inside vault")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{rel}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).isFile(at):
        raise FileNotFoundError(rel)
    found = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{rel}").select(F.decode("content", "utf-8").alias("text")).first()
    return found["text"]


def export_vault(spark: SparkSession, root: str, skipped: tuple[str, ...] = ("index.db",)) -> bytes:
    """A zip archive of a vault's files. All files are scanned for secrets first, on the executors; a
    finding is a ValueError. Files come to the driver one partition after another; the archive is one
    file, as a user's vault is."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = at.getFileSystem(spark._jsc.hadoopConfiguration()).resolvePath(at).toString().rstrip("/") + "/"
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9+.-]+):/+", "$1:/")
    rel = F.substring(plain(F.col("path")), F.char_length(plain(F.lit(base))) + 1, F.char_length("path"))
    named = files.select(rel.alias("path"), "content").where(~F.col("path").endswith(".pyc") & ~F.col("path").contains("__pycache__/") & ~F.element_at(F.split("path", "/"), -1).isin(*skipped))
    found = secret_findings(named.select("path", F.decode("content", "utf-8").alias("body"))).orderBy("path", "line", "kind").first()
    if found:
        raise ValueError(f"potential secret detected in {found['path']}: {found['kind']} on line {found['line']}")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for row in named.orderBy("path").toLocalIterator():
            archive.writestr(row["path"], bytes(row["content"]))
    return out.getvalue()


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files in zip archives; a path that leaves the vault fails the read."""

    def unpack(batches):
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for info in archive.infolist():
                        if info.filename.startswith("/") or ".." in info.filename.split("/"):
                            raise ValueError(f"unsafe archive path: {info.filename}")
                        if not info.is_dir():
                            yield pd.DataFrame({"path": [info.filename], "content": [archive.read(info)]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "path string, content binary")


def json_lines(results: DataFrame) -> DataFrame:
    """(value): each row as a JSON object, null fields included."""
    return results.select(F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"}).alias("value"))
