"""Notes from Markdown folders and from plain tables, and event logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions.text import join_text

#: File names that are never notes, and folders that hold none.
RESERVED = ("index.md", "log.md", "README.md", "AGENTS.md", "CLAUDE.md", "CODEX.md", "copilot-instructions.md", "glossary.md", "HERMES.md", "OPENCODE.md", "SCHEMA.md")
SKIPPED_FOLDERS = ("_templates",)
#: The folder inside a vault that holds its settings, logs and reports.
SETTINGS = ".notelake"
LIST_KEYS = ("tags", "aliases", "systems", "signals")


def _matching(pattern: str) -> Callable[[Column], Column]:
    return lambda part: part.rlike(pattern)


def is_note(rel: Column, excluded: list[str] | None = None, settings: str = SETTINGS) -> Column:
    """Whether a path inside a folder is a note's. An exclusion is a path, a path's head, one of its
    parts, or a glob over the whole path or a part."""
    parts = F.split(rel, "/")
    ok = ~F.element_at(parts, -1).isin(*RESERVED) & ~F.arrays_overlap(parts, F.array(*map(F.lit, [*SKIPPED_FOLDERS, settings])))
    for rule in excluded or []:
        glob = "^" + "".join({"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() and c not in "_/-" else c) for c in rule) + "$"
        ok = ok & ~((rel == rule) | F.startswith(rel, F.lit(rule.rstrip("/") + "/")) | F.array_contains(parts, rule) | rel.rlike(glob) | F.exists(parts, _matching(glob)))
    return ok


def read_folder(spark: SparkSession, root: str, excluded: list[str] | None = None) -> DataFrame:
    """(path, text, sha256) of every Markdown note below a folder. Spark's readers leave out files and
    folders whose names begin with a dot or an underscore."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(root)
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = at.getFileSystem(spark._jsc.hadoopConfiguration()).resolvePath(at).toString().rstrip("/") + "/"
    # The file's location begins with the folder's, both as URIs; a URI may leave out an empty host.
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9+.-]+):/+", "$1:/")
    placed = files.withColumn("tail", F.substring(plain(F.col("path")), F.char_length(plain(F.lit(base))) + 1, F.char_length("path")))
    return placed.select(F.col("tail").alias("path"), F.decode("content", "utf-8").alias("text"), F.sha2("content", 256).alias("sha256")).where(is_note(F.col("path"), excluded))


_ENTRY = "struct<key:string,list:boolean,items:array<string>>"


def _stripped(value: Column) -> Column:
    """Without white space, then double quotes, then single quotes at both ends."""
    for part in (r"^\s+|\s+$", '^"+|"+$', "^'+|'+$"):
        value = F.regexp_replace(value, part, "")
    return value


def parse_frontmatter(notes: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds frontmatter (a map of key to the list of its values), scalars (keys that aren't lists),
    body, body_start_line and error; a note that can't be parsed has an error and neither map nor body.

    The head lies between two ``---`` lines. A line is ``key: value``, ``key: [a, b]``, or an item
    behind two spaces and a dash under a key with an empty value. Of a key that is given twice the
    last one counts; the error is that of the first bad line. Null texts count as empty.
    """
    lines_col, end_col, state_col = (_fresh(notes, c) for c in ("lines", "end", "state"))
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    noted = notes.withColumn(lines_col, F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
    lines, end = F.col(lines_col), F.col(end_col)
    marks = F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))), bare)
    noted = noted.withColumn(end_col, F.array_position(marks, "---"))
    head = F.slice(lines, F.lit(2), F.greatest(end - 1, F.lit(0)).cast("int"))
    none = F.expr(f"cast(array() as array<{_ENTRY}>)")
    empty = F.expr("cast(array() as array<string>)")
    state = lambda error, key, entries: F.struct(error.cast("string").alias("error"), key.cast("string").alias("key"), entries.alias("entries"))
    nothing = F.lit(None).cast("string")

    def step(st: Column, raw: Column) -> Column:
        value = bare(F.regexp_replace(raw, r"^[^:]*:", ""))
        key = bare(F.substring_index(raw, ":", 1))
        inner = F.regexp_replace(bare(F.regexp_replace(value, r"^\[|\]$", "")), r"^\s+$", "")
        listed = F.when(inner == "", empty).otherwise(F.transform(F.split(inner, ","), _stripped))
        bracket = value.rlike(r"^\[[\s\S]*\]$")
        entry = F.struct(key.alias("key"), ((value == "") | bracket).alias("list"), F.when(value == "", empty).when(bracket, listed).otherwise(F.array(_stripped(value))).alias("items"))
        added = F.transform(st["entries"], lambda e: F.struct(e["key"].alias("key"), e["list"].alias("list"), F.when(e["key"] == st["key"], F.concat(e["items"], F.array(_stripped(F.substring(raw, F.lit(5), F.char_length(raw)))))).otherwise(e["items"]).alias("items")))
        opened = F.concat(F.filter(st["entries"], lambda e: e["key"] != key), F.array(entry))
        shown = F.regexp_replace(raw, r"\r$", "")
        return (
            F.when(st["error"].isNotNull() | (bare(raw) == ""), st)
            .when(raw.startswith("  - ") & st["key"].isNotNull(), state(nothing, st["key"], added))
            .when(raw.rlike(r"^\s"), state(F.concat(F.lit("unsupported indented frontmatter line: "), shown), nothing, st["entries"]))
            .when(~raw.contains(":"), state(F.concat(F.lit("invalid frontmatter line: "), shown), nothing, st["entries"]))
            .when(key == "", state(F.lit("empty frontmatter key"), nothing, st["entries"]))
            .otherwise(state(nothing, F.when(value == "", key), opened))
        )

    folded = noted.withColumn(state_col, F.aggregate(head, state(nothing, nothing, none), step))
    error = F.when(bare(F.try_element_at(lines, F.lit(1))) != "---", "missing YAML frontmatter block").when(end == 0, "unterminated YAML frontmatter block").otherwise(F.col(state_col)["error"])
    body = F.array_join(F.slice(lines, (end + 2).cast("int"), F.size(lines)), "\n")
    blank = bare(F.try_element_at(lines, (end + 2).cast("int"))) == ""
    entries = F.when(error.isNull(), F.col(state_col)["entries"])
    return folded.select(
        *notes.columns,
        F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], e["items"]))).alias("frontmatter"),
        F.transform(F.filter(entries, lambda e: ~e["list"]), lambda e: e["key"]).alias("scalars"),
        F.when(error.isNull(), F.regexp_replace(body, "^\r?\n", "")).alias("body"),
        (end + 2 + F.when(blank, 1).otherwise(0)).cast("int").alias("body_start_line"),
        error.alias("error"),
    )


def _fresh(df: DataFrame, name: str) -> str:
    """The name, or one like it, that no column of the frame has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def index_rows(parsed: DataFrame) -> DataFrame:
    """The index's ten text columns of parsed notes."""
    flat = lambda k: F.coalesce(F.array_join(F.col("frontmatter")[k], " "), F.lit("")).alias(k)
    rows = parsed.where("error IS NULL").select("path", *[flat(k) for k in ("type", "title", "description", *LIST_KEYS)], "body")
    return rows.withColumn("content", join_text(*[F.col(c) for c in ("type", "title", "description", *LIST_KEYS)]))


def notes_of_documents(docs: DataFrame) -> DataFrame:
    """The documents table as index rows: the source is the type, the language the tag."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = docs.select(
        F.concat(F.lit("docs/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".md")).alias("path"),
        F.col("source").alias("type"),
        F.array_join(F.slice(F.split(F.element_at(lines, 1), " "), 1, 8), " ").alias("title"),
        F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")).alias("description"),
        F.col("lang").alias("tags"),
        F.lit("").alias("aliases"),
        F.concat_ws("-", "lang", "source").alias("systems"),
        F.lit("").alias("signals"),
        F.coalesce("text", F.lit("")).alias("body"),
    )
    return rows.withColumn("content", join_text(*[F.col(c) for c in ("type", "title", "description", "tags", "aliases", "systems", "signals")]))


def notes_of_conversations(rows: DataFrame) -> DataFrame:
    """Conversations as Markdown bodies with one heading a turn: (path, body)."""
    turn = F.struct("turn", F.concat(F.lit("# "), F.coalesce("role", F.lit("")), F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("part"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("parts"))
    return grouped.select(F.concat(F.lit("talk/"), F.col("conv_id").cast("string")).alias("path"), F.array_join(F.transform("parts", lambda p: p["part"]), "\n").alias("body"))


def usage_of_events(events: DataFrame) -> DataFrame:
    """The events table as a usage log: views search, clicks retrieve, purchases and signups write.
    The payload's fields follow from the event's number, user and value."""
    n, value = F.col("event_id"), F.col("value")
    payload = F.struct(
        F.col("event_type").alias("query"),
        F.array("event_type", F.concat(F.lit("U"), (F.col("user_id") % 7).cast("string"))).alias("query_terms"),
        F.array(F.col("user_id").cast("string")).alias("result_paths"),
        F.when(n % 4 == 0, F.concat(F.lit("doc-"), (n % 11).cast("string"))).alias("document"),
        F.floor(value).alias("used_tokens"),
        F.when(value < 10, 0).otherwise(1).alias("result_count"),
        F.when(value < 20, 0).otherwise(1).alias("source_count"),
        F.when(n % 2 == 0, "passages").otherwise("documents").alias("mode"),
        F.when(n % 3 == 0, "rrf").otherwise("bm25").alias("ranker"),
        F.when(n % 5 == 0, "auto").otherwise("bm25").alias("requested_ranker"),
    )
    return events.select("event_id", "ts", F.col("event_type").alias("command"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.col("value").alias("duration_ms"), F.to_json(payload).alias("data"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines usage log; lines that aren't objects are dropped."""
    schema = "timestamp string, command string, status string, duration_ms double, data string, error string"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_events(events: DataFrame, path: str) -> None:
    """Appends events to a JSON-lines log, with their payloads cleaned and errors redacted."""
    from notelake.functions.text import redact
    from notelake.operators.usage import sanitized

    cleaned = sanitized(events)
    cleaned = cleaned.withColumn("error", redact(F.col("error"))) if "error" in events.columns else cleaned
    cleaned.write.mode("append").json(path)
