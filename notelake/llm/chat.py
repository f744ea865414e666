"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered turn by turn as ``<s>``, an optional ``\\`` (this turn is escaped), a
role mark, the text, ``</s>``. The marks are ``[INST] `` (user), ``[/INST] `` (assistant),
``<<SYS>> `` (system) and ``<</SYS>>`` with the escaped role and a line end (any other role).

A deterministic parser reads the rendering back: it cuts at ``</s>`` and rejects a turn whose
unescaped text holds any control string. Where the recovered turns differ from the source, the
turns that don't survive a round trip by themselves are escaped and all is parsed again; if that
differs still, every turn is escaped. Escaping is reversible: ``\\``, ``<`` and ``[`` become
``\\e``, ``\\l`` and ``\\b``, so no control string is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings (fixed values).
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
MARKS = {"user": "[INST] ", "assistant": "[/INST] ", "system": "<<SYS>> "}
OTHER = "<</SYS>>"


def _swap(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    return _swap(_swap(_swap(text, "\\", "\\e"), "<", "\\l"), "[", "\\b")


def unescape(text: Column) -> Column:
    return _swap(_swap(_swap(text, "\\l", "<"), "\\b", "["), "\\e", "\\")


def _mark(role: Column) -> Column:
    out = F.concat(F.lit(OTHER), _swap(escape(role), "\n", "\\w"), F.lit("\n"))
    for name, mark in MARKS.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def render(turns: Column, escaped: Column) -> Column:
    """The rendering of an array of (role, text), with an array of booleans that says which are escaped."""

    def one(t: Column, flag: Column) -> Column:
        body = F.when(flag, escape(t["text"])).otherwise(t["text"])
        return F.concat(F.lit("<s>"), F.when(flag, F.lit("\\")).otherwise(F.lit("")), _mark(t["role"]), body, F.lit("</s>"))

    return F.array_join(F.zip_with(turns, escaped, one), "")


def segments(formatted: Column) -> Column:
    """What stands before each ``</s>``."""
    parts = F.split(formatted, "</s>")
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def _after(text: Column, n: int) -> Column:
    return F.substring(text, F.lit(n + 1), F.char_length(text))


def _read(segment: Column) -> Column:
    """(role, text, head, body) of a segment: the lengths of its head and of its body as rendered.
    The text is null where the grammar doesn't allow it."""
    flag = F.startswith(segment, F.lit("<s>\\"))
    rest = F.when(flag, _after(segment, 4)).otherwise(_after(segment, 3))
    name = F.substring_index(_after(rest, len(OTHER)), "\n", 1)
    role = F.when(F.startswith(rest, F.lit(OTHER)), unescape(_swap(name, "\\w", "\n")))
    body = F.when(F.startswith(rest, F.lit(OTHER)), F.substring(rest, F.char_length(name) + F.lit(len(OTHER) + 2), F.char_length(rest)))
    for own, mark in MARKS.items():
        role = F.when(F.startswith(rest, F.lit(mark)), F.lit(own)).otherwise(role)
        body = F.when(F.startswith(rest, F.lit(mark)), _after(rest, len(mark))).otherwise(body)
    clash = F.lit(False)
    for control in CONTROL:
        clash = clash | F.contains(body, F.lit(control))
    text = F.when(~F.startswith(segment, F.lit("<s>")) | clash, F.lit(None)).when(flag, unescape(body)).otherwise(body)
    return F.struct(role.alias("role"), text.alias("text"), (F.char_length(segment) - F.char_length(body)).alias("head"), F.char_length(body).alias("body"))


def parse(formatted: Column) -> Column:
    """The recovered turns, an array of (role, text, head, body): see _read()."""
    return F.transform(segments(formatted), _read)


def _turns(read: Column) -> Column:
    return F.transform(read, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def _same(read: Column, turns: Column) -> Column:
    return F.coalesce(_turns(read) == turns, F.lit(False))


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: (conv_id, turns, formatted, loss_mask, recovered).

    ``turns`` are the source's (role, text) by turn; ties go by role, then text. ``loss_mask`` is
    run-length coded: for each turn how many code points of ``formatted`` to skip, then to take
    (an assistant's text, else none), then to skip (the end mark). ``recovered`` is what the parser
    reads from ``formatted``; it equals ``turns``.

    Null texts and roles count as empty; a null turn number comes first; rows with a null
    conv_id make a conversation of their own; repeated rows are turns each; other columns are
    ignored; no rows give no rows. A conversation is one value, so its turns meet in one row, and a
    text of any length is rendered whole.
    """
    chosen = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("t"))
    grouped = chosen.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    # A null turn number sorts last in array_sort: put those first.
    numbered = F.concat(F.filter("t", lambda t: t["turn"].isNull()), F.filter("t", lambda t: t["turn"].isNotNull()))
    turns = grouped.select("conv_id", F.transform(numbered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))

    flags = lambda value: F.transform("turns", lambda t: F.lit(value))
    conflicting = F.transform("turns", lambda t: ~_same(parse(render(F.array(t), F.array(F.lit(False)))), F.array(t)))
    # Each rendering is parsed once; only conversations that differ go on to the next.
    tried = turns.withColumn("f0", render(F.col("turns"), flags(False))).withColumn("p0", parse(F.col("f0"))).withColumn("ok0", _same(F.col("p0"), F.col("turns")))
    tried = tried.withColumn("f1", F.when(~F.col("ok0"), render(F.col("turns"), conflicting))).withColumn("p1", F.when(~F.col("ok0"), parse(F.col("f1"))))
    tried = tried.withColumn("ok1", F.col("ok0") | _same(F.col("p1"), F.col("turns")))
    tried = tried.withColumn("f2", F.when(~F.col("ok1"), render(F.col("turns"), flags(True)))).withColumn("p2", F.when(~F.col("ok1"), parse(F.col("f2"))))
    chosen_of = lambda k: F.when(F.col("ok0"), F.col(f"{k}0")).when(F.col("ok1"), F.col(f"{k}1")).otherwise(F.col(f"{k}2"))
    read = tried.select("conv_id", "turns", chosen_of("f").alias("formatted"), chosen_of("p").alias("read"))
    mask = F.transform("read", lambda t: F.struct(t["head"].alias("skip"), F.when(t["role"] == "assistant", t["body"]).otherwise(0).alias("take"), (F.when(t["role"] == "assistant", 0).otherwise(t["body"]) + 4).alias("then_skip")))
    return read.select("conv_id", "turns", "formatted", mask.alias("loss_mask"), _turns(F.col("read")).alias("recovered"))


def under_mask(formatted: Column, mask: Column) -> Column:
    """What a loss mask takes from a rendering, unescaped: an array of texts. A taken stretch is
    escaped if its turn's head says so."""
    start = F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<string>)").alias("texts"))

    def step(done: Column, m: Column) -> Column:
        text = F.substring(formatted, done["at"] + m["skip"], m["take"])
        flag = F.substring(formatted, done["at"], F.lit(4)) == "<s>\\"
        own = F.array(F.when(flag, unescape(text)).otherwise(text))
        return F.struct((done["at"] + m["skip"] + m["take"] + m["then_skip"]).alias("at"), F.when(m["take"] > 0, F.concat(done["texts"], own)).otherwise(done["texts"]).alias("texts"))

    return F.aggregate(mask, start, step)["texts"]


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars): the turns' digest
    from what the parser recovered, the loss's from what the mask takes of the rendering."""
    whole = F.array_join(F.transform("recovered", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = formatted.select("conv_id", "formatted", F.size("recovered").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.array_join(under_mask(F.col("formatted"), F.col("loss_mask")), "").alias("loss"))
    return read.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))
