"""Batches of keyword queries: phrases in conjunctive normal form, BM25, fallbacks and fusion.

A query run is rows of (query_id, run, group_id, phrase_id, terms, prefix): a row of the index
matches when each group has a phrase that it holds. All queries of a batch run as one plan.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.text import PIECE, TERM, distinct_tokens, fold, index_terms, query_tokens, stem
from notelake.operators import blocks, grams
from notelake.operators.index import LOOKED_UP, Index
from notelake.operators.lineage import HELD_BYTES, HELD_ROWS, cut, held, sent

K1, B = 1.2, 0.75
RRF_K = 60
#: Words too common to tell anything.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "com", "da", "das", "de", "do", "dos", "e", "em", "for", "from", "in", "into", "is", "it", "na", "nas", "no", "nos", "o", "of", "on", "or", "os", "ou", "para", "por", "que", "sem", "the", "to", "um", "uma", "with",
)
RANKERS = ("bm25", "rrf")
LOW_SIGNAL_ROWS, LOW_SIGNAL_DF, LOW_SIGNAL_SHARE = 30, 10, 0.8
RELAX_GROUPS, RELAX_CANDIDATES, RELAX_COVERAGE, RELAX_RATIO, RELAX_RATIO_DROPPED = 8, 20, 0.6, 0.81, 0.65


def query_words(queries: DataFrame) -> DataFrame:
    """(query_id, pos, token): the distinct search words of (query_id, query)."""
    return queries.select("query_id", F.posexplode(distinct_tokens(query_tokens(F.col("query")))).alias("pos", "token"))


def _phrases(words: DataFrame, run: int, group, terms, prefix: bool) -> DataFrame:
    out = words.select("query_id", F.lit(run).alias("run"), group.cast("int").alias("group_id"), F.col("pos").cast("int").alias("phrase_id"), terms.alias("terms"), F.lit(prefix).alias("prefix"))
    return out.where(F.size("terms") > 0)


def strict_run(queries: DataFrame, run: int = 0) -> DataFrame:
    """Every word must occur."""
    return _phrases(query_words(queries), run, F.col("pos"), index_terms(F.col("token")), False)


def or_run(queries: DataFrame, run: int = 2) -> DataFrame:
    """Any word may occur."""
    return _phrases(query_words(queries), run, F.lit(0), index_terms(F.col("token")), False)


def prefix_run(queries: DataFrame, run: int = 3) -> DataFrame:
    """Any word that begins like an inflected query word's stem."""
    stems = query_words(queries).withColumn("stem", stem(F.col("token"))).where("stem IS NOT NULL")
    once = stems.groupBy("query_id", "stem").agg(F.min("pos").alias("pos"))
    return _phrases(once, run, F.lit(0), index_terms(F.col("stem")), True)


def query_groups(queries: DataFrame, terms: DataFrame | None) -> DataFrame:
    """(query_id, group_id, members, grown): each word of a query with its synonyms of the glossary
    (title, aliases, status), in order; equal groups count once, for widened queries also those that
    are equal without accents. ``grown`` queries are those that the glossary widens."""
    from notelake.operators.glossary import token_groups

    words = query_words(queries).withColumn("low", fold(F.col("token")))
    if terms is None:
        return words.select("query_id", F.col("pos").alias("group_id"), F.array("token").alias("members"), F.lit(False).alias("grown"))
    wide = words.join(sent(token_groups(terms)), F.col("low") == F.col("token_low"), "left")
    # The word itself comes first, then its synonyms in order.
    others = F.filter("members", lambda m: fold(m) != F.col("low"))
    grouped = wide.select("query_id", "pos", F.concat(F.array("token"), F.coalesce(others, F.expr("cast(array() as array<string>)"))).alias("members"))
    grouped = grouped.withColumn("grown", F.max(F.size("members") > 1).over(Window.partitionBy("query_id")))
    key = F.array_join(F.array_sort(F.when(F.col("grown"), F.transform("members", fold)).otherwise(F.transform("members", F.lower))), "\n")
    once = grouped.withColumn("k", F.row_number().over(Window.partitionBy("query_id", key).orderBy("pos"))).where("k = 1")
    return once.select("query_id", F.col("pos").alias("group_id"), "members", "grown")


def group_run(groups: DataFrame, run: int) -> DataFrame:
    """Of each group (query_id, group_id, members) a word must occur."""
    each = groups.select("query_id", "group_id", F.posexplode("members").alias("k", "member"))
    out = each.select("query_id", F.lit(run).alias("run"), F.col("group_id").cast("int").alias("group_id"), (F.col("group_id") * 1000 + F.col("k")).cast("int").alias("phrase_id"), index_terms(F.col("member")).alias("terms"), F.lit(False).alias("prefix"))
    return out.where(F.size("terms") > 0)


def glossary_run(queries: DataFrame, terms: DataFrame, run: int = 1) -> DataFrame:
    """Every word, or a synonym of it, must occur; no rows for queries that the glossary doesn't
    widen. ``terms`` has (title, aliases, status)."""
    return group_run(query_groups(queries, terms).where("grown"), run)


def variants(queries: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The runs that fusion merges: strict 0, widened 1, any word 2 (of two words or more, else it is
    the strict one again) and prefixes 3."""
    many = query_words(queries).groupBy("query_id").count().where("count > 1").select("query_id")
    runs = strict_run(queries, 0).unionByName(or_run(queries, 2).join(many, "query_id", "left_semi")).unionByName(prefix_run(queries, 3))
    return runs if terms is None else runs.unionByName(glossary_run(queries, terms, 1))


def _keyed(phrases: DataFrame) -> DataFrame:
    """Phrases with a key that equal ones share."""
    return phrases.withColumn("key", F.concat(F.array_join("terms", " "), F.when(F.col("prefix"), "*").otherwise("")))


def _kinds(phrases: DataFrame) -> dict[str, tuple[DataFrame, list[str] | None]]:
    """The different phrases (key, terms) of a batch by kind, single, several or prefix, and all their
    terms. Few phrases become part of the plan, with their terms as a list; more are joined."""
    every = _keyed(phrases).select("key", "terms", "prefix")
    kind = lambda prefix, size: "prefix" if prefix else "single" if size == 1 else "several"
    few = every.limit(HELD_ROWS + 1).toArrow()
    if few.num_rows > HELD_ROWS or few.nbytes > HELD_BYTES:
        once = cut(every.distinct())
        found = once.select("prefix", F.least(F.size("terms"), F.lit(2)).alias("size")).distinct().collect()  # four at most
        own = F.when(F.col("prefix"), "prefix").when(F.size("terms") == 1, "single").otherwise("several")
        return {k: (once.where(own == k).select("key", "terms"), None) for k in {kind(r["prefix"], r["size"]) for r in found}}
    parts: dict[str, dict[str, list[str]]] = {}
    for r in few.to_pylist():
        parts.setdefault(kind(r["prefix"], len(r["terms"])), {})[r["key"]] = r["terms"]
    local = lambda rows: F.broadcast(phrases.sparkSession.createDataFrame(pa.table({"key": list(rows), "terms": list(rows.values())}), schema="key string, terms array<string>"))
    return {k: (local(rows), sorted({t for terms in rows.values() for t in terms})) for k, rows in parts.items()}


def _phrase_parts(phrases: DataFrame, index: Index) -> list[tuple[DataFrame, DataFrame]]:
    """Pairs of (key, row_id, f, len, df), the weighted occurrences of each different phrase in each
    row that has it, with in how many rows it is, and (key, df) alone; one pair for each kind of
    phrase in the batch.

    A prefix phrase sums all terms that begin with its last. Only the batch's terms are read; how
    many rows hold a term is looked up, not counted, where the index knows.
    """
    out = []
    kinds = _kinds(phrases)
    if "single" in kinds:
        once, terms = kinds["single"]
        single = once.select("key", F.element_at("terms", 1).alias("term"))
        if terms is None:
            found = [r["term"] for r in single.select("term").distinct().limit(LOOKED_UP + 1).collect()]
            terms = found if len(found) <= LOOKED_UP else None
        df = cut(index.frequencies(single.select("term") if terms is None else terms).join(single, "term").select("term", "key", "df"))
        # The terms and their frequencies are sent to the postings, which stay where they are.
        rows = index.met(df) if terms is None else index.of(terms, places=False).join(sent(df), "term")
        out.append((rows.select("key", "row_id", "f", "len", "df"), df.select("key", "df")))
    if "several" in kinds:
        once, terms = kinds["several"]
        keyed = once.select("key", F.size("terms").alias("m"), F.posexplode("terms").alias("k", "term"))
        placed = index.of(keyed.select("term") if terms is None else terms).join(keyed, "term").select("key", "m", "k", "row_id", "len", F.explode("places").alias("p")).withColumns({"field": F.shiftright("p", 32).cast("int"), "at": F.col("p").bitwiseAND(F.lit(0xFFFFFFFF)) - F.col("k")})
        whole = placed.groupBy("key", "row_id", "field", "at").agg(F.max("m").alias("m"), F.count("*").alias("found"), F.first("len").alias("len")).where("found = m")
        whole = whole.withColumn("weight", F.element_at(F.array(*map(F.lit, index.weights)), F.col("field") + 1))
        out.append(_counted(whole.groupBy("key", "row_id").agg(F.sum("weight").alias("f"), F.first("len").alias("len"))))
    if "prefix" in kinds:
        # The vocabulary is matched once for each different stem; a stem has five letters at least, so they join by these.
        head = lambda c: F.substring(c, 1, 5)
        stems = kinds["prefix"][0].select("key", F.element_at("terms", -1).alias("stem")).withColumn("head", head("stem"))
        begins = held(index.terms().withColumn("head", head("term")).join(stems, "head").where(F.startswith("term", F.col("stem"))).select("key", "term"))
        out.append(_counted(index.of(begins.select("term"), places=False).join(begins, "term").groupBy("key", "row_id").agg(F.sum("f").alias("f"), F.first("len").alias("len"))))
    return out


def _counted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows computed once, and in how many of them each key is."""
    rows = cut(rows)
    df = sent(cut(rows.groupBy("key").agg(F.count("*").alias("df"))))
    return rows.join(df, "key"), df


def phrase_rows(phrases: DataFrame, index: Index) -> DataFrame:
    """(key, row_id, f): the weighted occurrences of each different phrase in each row that has it."""
    return _united([rows.select("key", "row_id", "f") for rows, _ in _phrase_parts(phrases, index)], phrases, "key string, row_id string, f double")


def _united(parts: list[DataFrame], like: DataFrame, schema: str) -> DataFrame:
    """All parts' rows; an empty frame without any part."""
    if not parts:
        return like.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def phrase_hits(phrases: DataFrame, index: Index) -> DataFrame:
    """(query_id, run, group_id, phrase_id, row_id): the rows that have each phrase."""
    return _keyed(phrases).select("query_id", "run", "group_id", "phrase_id", "key").join(phrase_rows(phrases, index), "key").drop("key", "f")


def phrase_scores(phrases: DataFrame, index: Index) -> DataFrame:
    """(key, row_id, part, df): what each different phrase adds to a row's score, and in how many
    rows it is. A phrase that over half of the rows have counts next to nothing."""
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0, 1e-6).otherwise(raw)
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    parts = [index.sized(rows).select("key", "row_id", part.alias("part"), "df") for rows, _ in _phrase_parts(phrases, index)]
    return _united(parts, phrases, "key string, row_id string, part double, df long")


def scored(phrases: DataFrame, parts: DataFrame) -> DataFrame:
    """(query_id, run, row_id, score) of the rows that match, from phrase_scores(); smaller scores
    are better. Every phrase of a run counts, also one of a group that another phrase satisfied."""
    keyed = _keyed(phrases).select("query_id", "run", "group_id", "key")
    needed = keyed.groupBy("query_id", "run").agg(F.count_distinct("group_id").alias("needed"))
    met = keyed.join(needed, ["query_id", "run"]).join(parts, "key")
    total = met.groupBy("query_id", "run", "row_id").agg((-F.sum("part")).alias("score"), F.count_distinct("group_id").alias("groups"), F.max("needed").alias("needed"))
    return total.where("groups = needed").select("query_id", "run", "row_id", "score")


def bm25(phrases: DataFrame, index: Index) -> DataFrame:
    """(query_id, run, row_id, score) of the rows that match the phrases of a batch."""
    phrases = held(phrases)
    return scored(phrases, phrase_scores(phrases, index))


def best(phrases: DataFrame, index: Index, limit: int, some: bool = False) -> DataFrame:
    """(query_id, run, row_id, score, rank, groups): what ranked() keeps of what bm25() gives,
    without a row for each match; see blocks.best()."""
    phrases = held(phrases)
    rows = index.lengths.count() if index.size is None else index.size[0]
    return blocks.best(_keyed(phrases).select("query_id", "run", "group_id", "key"), phrase_scores(phrases, index), limit, rows, some)


def ranked(scores: DataFrame, limit: int) -> DataFrame:
    """The best rows of each query and run, with rank from 1; ties by row. Scores are compared to
    nine places, so that the order of a sum doesn't decide."""
    order = Window.partitionBy("query_id", "run").orderBy(F.round("score", 9), "row_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def rrf(runs: DataFrame, limit: int) -> DataFrame:
    """Reciprocal-rank fusion of ranked runs: (query_id, row_id, rrf_score, best_rank, score, rank).

    ``score`` is that of the run whose entry stands for the row: runs in order, each replacing the
    one before if its rank or its score is better.
    """
    once = runs.groupBy("query_id", "run", "row_id").agg(F.min(F.struct("rank", "score")).alias("r"))
    entries = F.array_sort(F.collect_list(F.struct("run", F.col("r.rank").alias("rank"), F.col("r.score").alias("score"))))
    fused = once.groupBy("query_id", "row_id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("r.rank"))), 12).alias("rrf_score"), F.min("r.rank").alias("best_rank"), F.min(F.struct("run", "r.rank")).alias("seen"), entries.alias("e"))
    kept = F.aggregate(F.slice("e", F.lit(2), F.size("e")), F.element_at("e", 1), lambda old, new: F.when((new["rank"] < old["rank"]) | (new["score"] < old["score"]), new).otherwise(old))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "best_rank", "seen", "row_id")
    ranked_ = fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked_.select("query_id", "row_id", "rrf_score", "best_rank", kept["score"].alias("score"), "rank")


def matches_filters(rows: DataFrame, type_: str | None = None, tags: list[str] | None = None, systems: list[str] | None = None) -> DataFrame:
    """The rows of a type that have all given tags and systems, in any case."""
    if type_:
        rows = rows.where(F.lower("type") == type_.lower())
    for column, wanted in (("tags", tags), ("systems", systems)):
        for value in wanted or []:
            rows = rows.where(F.array_contains(F.split(F.lower(column), " "), value.lower()))
    return rows


def search_filtered(scores: DataFrame, rows: DataFrame, limit: int, **filters) -> DataFrame:
    """Filters after the candidate cut, as an index with a limit does: of the first
    max(20 * limit, 100) candidates those that match, and of these the first ``limit``."""
    candidates = ranked(scores, max(limit * 20, 100))
    kept = candidates.join(matches_filters(rows, **filters).select(F.col("path").alias("row_id")), "row_id", "left_semi")
    order = Window.partitionBy("query_id", "run").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _group_counts(phrases: DataFrame, index: Index) -> DataFrame:
    """(query_id, group_id, df): in how many rows a group has a phrase. A single phrase's number is
    known; rows are counted for those of several, once for each different set of phrases."""
    keyed = _keyed(phrases)
    sets = cut(keyed.groupBy("query_id", "group_id").agg(F.array_sort(F.collect_set("key")).alias("keys")))
    counts = _united([df for _, df in _phrase_parts(phrases, index)], phrases, "key string, df long")
    alone = sets.where(F.size("keys") == 1).withColumn("key", F.element_at("keys", 1)).join(counts, "key").select("query_id", "group_id", "df")
    many = held(sets.where(F.size("keys") > 1).select("keys").distinct().select("keys", F.explode("keys").alias("key")))
    if many.isEmpty():
        return alone
    own = held(keyed.join(many.select("key").distinct(), "key", "left_semi").drop("key"))
    met = phrase_rows(own, index).join(sent(many), "key").groupBy("keys", "row_id").agg(F.lit(1).alias("one"))
    return alone.unionByName(sets.join(met.groupBy("keys").agg(F.count("*").alias("df")), "keys").select("query_id", "group_id", "df"))


def signal_groups(groups: DataFrame, index: Index) -> DataFrame:
    """(query_id, group_id, members, df, status, idf) of groups as query_groups() gives them:
    stopword, zero_hit, low_signal or eligible. Stopword groups of widened queries are left out."""
    phrases = held(group_run(groups, 0))
    df = _group_counts(phrases, index)
    table = index.sized(groups.join(df, ["query_id", "group_id"], "left").withColumn("df", F.coalesce("df", F.lit(0))))
    low = (F.col("n") >= LOW_SIGNAL_ROWS) & (F.col("df") >= LOW_SIGNAL_DF) & (F.col("df") / F.col("n") >= LOW_SIGNAL_SHARE)
    common = F.forall("members", lambda m: F.lower(m).isin(*STOPWORDS))
    status = F.when(common, "stopword").when(F.col("df") == 0, "zero_hit").when(low, "low_signal").otherwise("eligible")
    idf = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1
    return table.where(~(F.col("grown") & common)).select("query_id", "group_id", "members", "df", status.alias("status"), idf.alias("idf"))


def relaxed_groups(groups: DataFrame, index: Index) -> DataFrame:
    """(query_id, group_id, enough): the groups that a relaxed query keeps, those of the candidate
    row that covers the most signal. ``groups`` is what signal_groups() gives. Queries with too many
    groups, or whose best row covers too little, have none; a single group that is left of several
    isn't ``enough``."""
    eligible = held(groups.where("status = 'eligible'"))
    size = groups.groupBy("query_id").agg(F.count_if(F.col("status") == "eligible").alias("eligible"), F.count_if(F.col("status") != "eligible").alias("dropped"), F.sum(F.when(F.col("status") == "eligible", F.col("idf"))).alias("total"))
    size = size.where(f"eligible BETWEEN 1 AND {RELAX_GROUPS}")
    own = held(group_run(eligible.join(size.where("eligible > 1").select("query_id"), "query_id", "left_semi"), 0))
    candidates = best(own, index, RELAX_CANDIDATES, some=True).select("query_id", "row_id", "rank", F.explode("groups").alias("group_id"))
    matched = candidates.join(eligible.select("query_id", "group_id", "idf"), ["query_id", "group_id"])
    rows = matched.groupBy("query_id", "row_id").agg(F.count("*").alias("hits"), F.sum("idf").alias("idf"), F.min("rank").alias("rank"), F.sort_array(F.collect_list("group_id")).alias("groups")).join(size, "query_id")
    rows = rows.withColumn("coverage", F.col("hits") / F.col("eligible")).withColumn("ratio", F.round(F.col("idf") / F.col("total"), 9))
    rows = rows.where((F.col("hits") >= 2) & (F.col("coverage") >= RELAX_COVERAGE) & (F.col("ratio") >= F.when(F.col("dropped") > 0, RELAX_RATIO_DROPPED).otherwise(RELAX_RATIO)))
    order = Window.partitionBy("query_id").orderBy(F.desc("ratio"), F.desc("coverage"), F.desc("hits"), "rank")
    top = rows.withColumn("k", F.row_number().over(order)).where("k = 1").select("query_id", F.explode("groups").alias("group_id"), F.lit(True).alias("enough"))
    alone = eligible.join(size.where("eligible = 1"), "query_id").select("query_id", "group_id", (F.col("dropped") <= 1).alias("enough"))
    # Computed once: callers look at it more than once, and the search below it is the whole batch's.
    return cut(top.unionByName(alone))


def search(queries: DataFrame, index: Index, limit: int, glossary: DataFrame | None = None, ranker: str = "bm25", rows: DataFrame | None = None, type_: str | None = None, tags: list[str] | None = None, systems: list[str] | None = None) -> DataFrame:
    """(query_id, stage, row_id, score, rank): the best rows of each query (query_id, query).

    With bm25, the first stage that finds anything: 1 widened by the glossary, 2 strict, 3 relaxed;
    queries without an eligible word abstain. With rrf, the fusion of all variants, stage 0. Filters
    go over the first max(20 * limit, 100) candidates and need ``rows`` (path, type, tags, systems).
    Queries without words have no rows.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    if ranker not in RANKERS:
        raise ValueError("ranker must be 'bm25' or 'rrf'")
    filters = {"type_": type_, "tags": tags, "systems": systems}
    filtered = any(filters.values())
    if filtered and rows is None:
        raise ValueError("filters need rows")
    wide = max(limit * 20, 100)
    if ranker == "rrf":
        runs = held(variants(queries, glossary))
        found = rrf(best(runs, index, wide), wide).withColumn("stage", F.lit(0))
    else:
        found = _first_stage(queries, index, wide if filtered else limit, glossary).withColumnRenamed("run", "stage")
    if filtered:
        found = found.join(matches_filters(rows, **filters).select(F.col("path").alias("row_id")), "row_id", "left_semi")
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return found.where(F.col("rank") <= limit).select("query_id", "stage", "row_id", "score", "rank")


def _first_stage(queries: DataFrame, index: Index, limit: int, glossary: DataFrame | None) -> DataFrame:
    """(query_id, run, row_id, score, rank) of the first stage of each query that finds anything."""
    groups = held(query_groups(queries, glossary))
    state = held(signal_groups(groups, index))
    signal = state.where("status = 'eligible'").select("query_id").distinct()
    strict = strict_run(queries, 2)
    first = held((strict if glossary is None else strict.unionByName(group_run(groups.where("grown"), 1))).join(signal, "query_id", "left_semi"))
    found = cut(best(first, index, limit).drop("groups"))
    # Only queries that found nothing so far are relaxed.
    open_ = signal.join(found.select("query_id").distinct(), "query_id", "left_anti")
    kept = relaxed_groups(state.join(open_, "query_id", "left_semi"), index).where("enough")
    relaxed = held(group_run(state.join(kept, ["query_id", "group_id"], "left_semi"), 3))
    every = found.unionByName(best(relaxed, index, limit).drop("groups"))
    least = found.groupBy("query_id").agg(F.min("run").alias("run")).unionByName(relaxed.select("query_id", "run").distinct())
    return every.join(least, ["query_id", "run"], "left_semi")


def fts_string(groups: DataFrame, out: str) -> DataFrame:
    """(query_id, out): the groups (query_id, group_id, members) as a query string: words in quotes,
    several members of a group in parentheses with OR between, groups with AND between."""
    quoted = F.transform("members", lambda m: F.concat(F.lit('"'), m, F.lit('"')))
    one = F.when(F.size("members") == 1, quoted[0]).otherwise(F.concat(F.lit("("), F.array_join(quoted, " OR "), F.lit(")")))
    lists = groups.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("group_id", one.alias("s")))).alias("l"))
    return lists.select("query_id", F.array_join(F.transform("l", lambda x: x["s"]), " AND ").alias(out))


def diagnostics(queries: DataFrame, index: Index, glossary: DataFrame | None = None) -> DataFrame:
    """(query_id, strict_query, zero_hit_terms, relaxed_query, relaxation_applied, reason) of each
    query: reason is no_signal where no word is eligible or no relaxation helps, else empty. Where
    the strict query has rows the terms and the relaxed query are empty."""
    tokens = queries.select("query_id", query_tokens(F.col("query")).alias("tokens"))
    strict_text = tokens.select("query_id", F.array_join(F.transform("tokens", lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " ").alias("strict_query"))
    state = held(signal_groups(held(query_groups(queries, glossary)), index))
    strict = held(strict_run(queries, 2))
    found = cut(best(strict, index, 1).select("query_id").distinct()).withColumn("found", F.lit(True))
    open_ = state.join(found, "query_id", "left_anti")
    kept = relaxed_groups(open_, index)
    relaxed = fts_string(state.join(kept, ["query_id", "group_id"], "left_semi"), "relaxed")
    zero = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("group_id", F.when(F.col("status") == "zero_hit", F.col("members")[0]).alias("w")))), lambda x: x["w"]), lambda w: w.isNotNull())
    every = state.groupBy("query_id").agg(F.array_join(zero, " ").alias("zero"), F.count_if(F.col("status") == "eligible").alias("eligible"))
    joined = strict_text.join(every, "query_id", "left").join(found, "query_id", "left").join(relaxed, "query_id", "left").join(kept.select("query_id", "enough").distinct(), "query_id", "left")
    silent = F.coalesce(F.col("eligible"), F.lit(0)) == 0
    has_rows = F.coalesce("found", F.lit(False)) & ~silent
    applied = F.coalesce("enough", F.lit(False)) & ~has_rows & ~silent
    empty = F.lit("")
    blank = F.col("strict_query") == ""
    return joined.select(
        "query_id",
        "strict_query",
        F.when(blank | has_rows, empty).otherwise(F.coalesce("zero", empty)).alias("zero_hit_terms"),
        F.when(has_rows | silent, empty).otherwise(F.coalesce("relaxed", empty)).alias("relaxed_query"),
        applied.alias("relaxation_applied"),
        F.when(blank | has_rows | applied, empty).otherwise("no_signal").alias("reason"),
    )


def grep_text() -> Column:
    """What of a note a search for substrings looks at."""
    return F.lower(F.concat("path", F.lit("\n"), "body"))


def grep(queries: DataFrame, rows: DataFrame, limit: int, trigrams: grams.Grams | None = None) -> DataFrame:
    """(query_id, row_id, rank): rows whose path and text hold all words as substrings, by path.
    ``trigrams`` of grep_text() may be kept between batches."""
    words = queries.select("query_id", F.transform(distinct_tokens(query_tokens(F.col("query"))), F.lower).alias("words"))
    hay = rows.select(F.col("path").alias("row_id"), grep_text().alias("hay"))
    hits = grams.holding(words, hay, trigrams or grams.built(hay))
    order = Window.partitionBy("query_id").orderBy("row_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


#: Stand for the brackets until it is known which column is shown; texts have brackets of their own.
_OPEN, _CLOSE = "\x01", "\x02"


def _windows(results: DataFrame, rows: DataFrame, queries: DataFrame, column: str, width: int) -> DataFrame:
    """(query_id, row_id, snippet) with _OPEN and _CLOSE for brackets."""
    wanted = queries.select("query_id", F.flatten(F.transform(query_tokens(F.col("query")), index_terms)).alias("wanted"))
    pieces = F.regexp_extract_all("_text", F.lit(PIECE), F.lit(0))
    shown = rows.select(F.col("path").alias("row_id"), F.coalesce(F.col(column), F.lit("")).alias("_text")).join(sent(results.select("query_id", "row_id").join(wanted, "query_id")), "row_id")
    shown = shown.withColumn("pieces", pieces).drop("_text")
    # Terms are compared folded, and shown as they stand in the text. ``at`` has the places of terms among the pieces.
    shown = shown.withColumn("folded", F.transform("pieces", fold))
    shown = shown.withColumn("at", F.filter(F.transform("folded", lambda t, i: F.when(t.rlike(TERM), i)), lambda i: i.isNotNull()))
    shown = shown.withColumn("terms", F.filter("folded", lambda t: t.rlike(TERM))).withColumn("n", F.size("at"))
    last = F.greatest(F.col("n") - width, F.lit(0))
    hits = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((-F.size(F.array_intersect(F.slice("terms", i + 1, F.lit(width)), "wanted"))).alias("hits"), i.alias("start")))
    best = shown.withColumn("start", F.array_min(hits)["start"])
    first = F.when(F.col("start") == 0, 0).otherwise(F.get("at", F.col("start")))
    end = F.when(F.col("start") + width >= F.col("n"), F.size("pieces")).otherwise(F.get("at", F.col("start") + width - 1) + 1)
    best = best.withColumn("first", first).withColumn("end", end)
    cut_ = lambda c: F.slice(c, F.col("first") + 1, F.col("end") - F.col("first"))
    marked = F.zip_with(cut_("pieces"), cut_("folded"), lambda p, t: F.when(F.array_contains("wanted", t), F.concat(F.lit(_OPEN), p, F.lit(_CLOSE))).otherwise(p))
    text = F.concat(F.when(F.col("start") > 0, "...").otherwise(""), F.array_join(marked, ""), F.when(F.col("start") + width < F.col("n"), "...").otherwise(""))
    return best.select("query_id", "row_id", text.alias("snippet"))


def _bracketed(snippet: Column) -> Column:
    return F.translate(snippet, _OPEN + _CLOSE, "[]")


def snippets(results: DataFrame, rows: DataFrame, queries: DataFrame, column: str = "body", width: int = 12) -> DataFrame:
    """(query_id, row_id, snippet): the earliest window of ``width`` terms with the most distinct
    query words, cut from the text as it stands, its case, accents and signs kept. Words that equal a
    query word without case and accents are in brackets; dots where it is cut."""
    return _windows(results, rows, queries, column, width).withColumn("snippet", _bracketed(F.col("snippet")))


def best_snippets(results: DataFrame, rows: DataFrame, queries: DataFrame, body: str = "body", width: int = 12) -> DataFrame:
    """(query_id, row_id, snippet): of the content column if it holds a query word, else of the
    body if that does, else of the one that has any text."""
    results = held(results.select("query_id", "row_id"))
    both = _windows(results, rows, queries, "content", width).withColumnRenamed("snippet", "c").join(_windows(results, rows, queries, body, width).withColumnRenamed("snippet", "b"), ["query_id", "row_id"])
    marked = lambda c: F.contains(c, F.lit(_OPEN))
    chosen = F.when(marked(F.col("c")), F.col("c")).when(marked(F.col("b")), F.col("b")).when(F.col("c") != "", F.col("c")).otherwise(F.col("b"))
    return both.select("query_id", "row_id", _bracketed(chosen).alias("snippet"))
