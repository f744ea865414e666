import math

from notelake.operators import evaluate, glossary, index, passages, retrieve, search, similar
from notelake.operators import notes as changes
from notelake.sources.notes import index_rows, parse_frontmatter, read_folder

NOTE = "---\ntype: runbook\ntitle: Deploy\ndescription: d\ntags: [a, b]\naliases:\n  - x y\ntimestamp: 2024-01-01\n---\n\n# One\ntext a\n\n## Two\ntext b"


def docs(spark, *bodies):
    return spark.createDataFrame([(f"{k}.md", b) for k, b in enumerate(bodies)], "path string, body string")


def indexed(rows):
    weights = {"body": 1.0}
    return index.built(rows, weights)


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_bm25_is_the_formula(spark):
    rows = docs(spark, "alpha beta beta", "alpha", "gamma", "delta epsilon")
    got = {r["row_id"]: r["score"] for r in search.bm25(search.or_run(queries(spark, "beta")), indexed(rows)).collect()}
    mean = 7 / 4
    want = -math.log((4 - 1 + 0.5) / 1.5) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / mean))
    assert got.keys() == {"0.md"} and math.isclose(got["0.md"], want, rel_tol=1e-12)


def test_underscore_token_is_a_phrase(spark):
    rows = docs(spark, "foo bar", "bar foo", "foo_bar baz")
    got = {r["row_id"] for r in search.bm25(search.strict_run(queries(spark, "foo_bar")), indexed(rows)).collect()}
    assert got == {"0.md", "2.md"}


def test_search_relaxes_and_abstains(spark):
    rows = docs(spark, "rotate credentials now", "oauth flow", "something else", "the last note")
    out = search.search(queries(spark, "credentials xyzzy", "the", "credentials oauth"), indexed(rows), 3).collect()
    assert {(r["query_id"], r["stage"], r["row_id"]) for r in out} == {(0, 3, "0.md")}


def test_rrf_ties_go_to_the_first_seen(spark):
    runs = spark.createDataFrame([(1, 0, "b", 1, -2.0), (1, 0, "a", 2, -1.0), (1, 1, "a", 1, -3.0), (1, 1, "b", 2, -2.5)], "query_id int, run int, row_id string, rank int, score double")
    # b's second entry replaces the first by its score, a's by its rank.
    assert [(r["row_id"], r["score"]) for r in search.rrf(runs, 5).orderBy("rank").collect()] == [("b", -2.5), ("a", -3.0)]


def test_glossary_widens(spark):
    terms = spark.createDataFrame([("Kubernetes", ["k8s"], "approved")], "title string, aliases array<string>, status string")
    rows = docs(spark, "kubernetes cluster", "k8s", "other")
    found = search.bm25(search.glossary_run(queries(spark, "k8s", "other"), terms), indexed(rows)).collect()
    assert {(r["query_id"], r["row_id"]) for r in found} == {(0, "0.md"), (0, "1.md")}
    assert [r["title"] for r in glossary.lookup(queries(spark, "my k8s"), terms).collect()] == ["Kubernetes"]


def test_frontmatter_and_passages(spark, tmp_path):
    # A part of the path that ends like the vault's name.
    vault = tmp_path / "srv" / "v"
    (vault / "v" / "v").mkdir(parents=True)
    (vault / "_templates").mkdir()
    for name in ("n.md", "README.md", "_templates/t.md", "v/v/deep file.md", "GEMINI.md", "CODEX.md"):
        (vault / name).write_text(NOTE)
    (vault / "bad.md").write_text("no head")
    parsed = parse_frontmatter(read_folder(spark, str(vault)))
    by = {r["path"]: r for r in parsed.collect()}
    assert by.keys() == {"n.md", "bad.md", "v/v/deep file.md", "GEMINI.md"} and by["bad.md"]["error"] == "missing YAML frontmatter block"
    parsed = parse_frontmatter(read_folder(spark, str(vault), ["v", "GEMINI.md"]))
    assert by["n.md"]["frontmatter"]["tags"] == ["a", "b"] and by["n.md"]["frontmatter"]["aliases"] == ["x y"]
    assert by["n.md"]["body_start_line"] == 11
    assert index_rows(parsed).first()["title"] == "Deploy"
    parts = passages.split_passages(parsed.where("error IS NULL"), first_line=parsed["body_start_line"]).orderBy("start_line").collect()
    assert [(r["heading"], r["start_line"], r["end_line"], r["text"]) for r in parts] == [("One", 11, 13, "text a"), ("Two", 14, 15, "text b")]


def test_frontmatter_lines(spark):
    heads = {
        "twice": "title: A\ntags:\n  - x\ntitle: 'B'\ntags: [\"p\", q ]",
        "indent": "title: A\n   deep: b",
        "item": "title: A\n  - x",
        "colon": "title A\n  - x",
        "key": " \n: v",
        "empty": "tags: []\naliases:\n",
    }
    rows = spark.createDataFrame([(k, f"---\n{h}\n--- \nbody") for k, h in heads.items()] + [("open", "---\na: b"), ("null", None), ("lines", "x")], "path string, text string").withColumnRenamed("path", "lines")
    got = {r["lines"]: r for r in parse_frontmatter(rows).collect()}
    assert got["twice"]["frontmatter"] == {"title": ["B"], "tags": ["p", "q"]} and got["twice"]["scalars"] == ["title"] and got["twice"]["body"] == "body"
    assert got["empty"]["frontmatter"] == {"tags": [], "aliases": []}
    assert {k: got[k]["error"] for k in ("indent", "item", "colon", "key", "open", "null")} == {
        "indent": "unsupported indented frontmatter line:    deep: b",
        "item": "unsupported indented frontmatter line:   - x",
        "colon": "invalid frontmatter line: title A",
        "key": "empty frontmatter key",
        "open": "unterminated YAML frontmatter block",
        "null": "missing YAML frontmatter block",
    }


def test_search_finds_by_glossary_alone(spark):
    terms = spark.createDataFrame([("Kubernetes", ["k8s"], "approved")], "title string, aliases array<string>, status string")
    held = indexed(docs(spark, "kubernetes cluster", "another note", "the end"))
    asks = queries(spark, "k8s", "k8s xyzzy", "the k8s", "kubernetes k8s")
    got = {(r["query_id"], r["stage"], r["row_id"]) for r in search.search(asks, held, 3, terms).collect()}
    assert got == {(0, 1, "0.md"), (1, 3, "0.md"), (2, 3, "0.md"), (3, 1, "0.md")} or got == {(0, 1, "0.md"), (1, 3, "0.md"), (3, 1, "0.md"), (2, 3, "0.md")}
    told = {r["query_id"]: r for r in search.diagnostics(asks, held, terms).collect()}
    assert told[0]["reason"] == "" and told[0]["relaxed_query"] == '("k8s" OR "kubernetes")' and told[0]["relaxation_applied"]
    assert told[1]["zero_hit_terms"] == "xyzzy" and told[1]["strict_query"] == '"k8s" "xyzzy"'


def test_diagnostics_know_two_reasons(spark):
    held = indexed(docs(spark, "rotate credentials now", "oauth flow", "something else", "the last note"))
    got = {r["query_id"]: tuple(r)[1:] for r in search.diagnostics(queries(spark, "credentials xyzzy", "the", "credentials oauth", "rotate now", "", "xyzzy plugh credentials"), held).collect()}
    assert got == {
        0: ('"credentials" "xyzzy"', "xyzzy", '"credentials"', True, ""),
        1: ('"the"', "", "", False, "no_signal"),
        2: ('"credentials" "oauth"', "", "", False, "no_signal"),
        3: ('"rotate" "now"', "", "", False, ""),
        4: ("", "", "", False, ""),
        5: ('"xyzzy" "plugh" "credentials"', "xyzzy plugh", '"credentials"', False, "no_signal"),
    }


def test_search_by_fusion_filters_and_bad_arguments(spark):
    rows = spark.createDataFrame([("a.md", "alpha beta", "t", "x Y", "s"), ("b.md", "alpha", "u", "x", "s"), ("c.md", "alphas", "t", "", "")], "path string, body string, type string, tags string, systems string")
    held = index.built(rows, {"body": 1.0})
    found = search.search(queries(spark, "alpha beta"), held, 3, ranker="rrf", rows=rows, tags=["X"], type_="T").collect()
    assert [(r["row_id"], r["rank"], r["stage"]) for r in found] == [("a.md", 1, 0)]
    for bad in ({"limit": 0}, {"limit": 1, "ranker": "best"}, {"limit": 1, "tags": ["x"]}):
        try:
            search.search(queries(spark, "alpha"), held, **bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_stored_index_follows_its_rows(spark, tmp_path):
    weights, folder = {"body": 1.0}, str(tmp_path / "ix")
    rows = docs(spark, "alpha beta", "beta_gamma", "delta")
    assert index.update(rows, weights, folder)["version"] == 0 and index.update(rows, weights, folder) == {"version": 0, "same": 3}
    later = spark.createDataFrame([("0.md", "alpha beta"), ("1.md", "alpha alpha"), ("3.md", "beta beta gamma")], "path string, body string")
    assert index.update(later, weights, folder) == {"version": 1, "same": 1, "updated": 1, "removed": 1, "added": 1}
    asks = queries(spark, "alpha", "beta_gamma", "delta", "betas")
    run = search.or_run(asks).unionByName(search.prefix_run(queries(spark, "gammas", "betating")))
    fresh = {(r["query_id"], r["run"], r["row_id"], round(r["score"], 9)) for r in search.bm25(run, index.built(later, weights)).collect()}
    kept = {(r["query_id"], r["run"], r["row_id"], round(r["score"], 9)) for r in search.bm25(run, index.repaired(later, weights, folder)).collect()}
    assert fresh == kept and {(q, n) for q, _, n, _ in kept} >= {(0, "0.md"), (0, "1.md"), (1, "3.md"), (0, "3.md")}
    assert {(r["term"], r["df"]) for r in index.document_frequency(index.read(spark, folder)).collect()} == {("alpha", 2), ("beta", 2), ("gamma", 1)}


def found_by(spark, index_, *texts):
    return {(r["query_id"], r["row_id"]) for r in search.bm25(search.or_run(queries(spark, *texts)), index_).collect()}


def test_stored_index_sees_edits_of_any_column_and_repeated_keys(spark, tmp_path):
    weights, folder = {"path": 0.1, "title": 8.0, "body": 1.0}, str(tmp_path / "ix")
    schema = "path string, title string, body string, term string, version int"  # extra columns with names of the index's own
    rows = lambda *r: spark.createDataFrame([(*x, "t", 7) for x in r], schema)
    assert index.update(rows(("a.md", "old title", "same"), ("b.md", None, ""), (None, "no key", "x")), weights, folder) == {"version": 0, "added": 2}
    later = rows(("a.md", "new zebra", "same"), ("b.md", "", None))
    assert index.update(later, weights, folder) == {"version": 1, "updated": 1, "same": 1}  # null and empty are the same
    assert found_by(spark, index.read(spark, folder), "zebra", "old", "same", "key") == {(0, "a.md"), (2, "a.md")}
    # Of two rows with one key one counts, whatever their order, and equal ones count once.
    twice = rows(("a.md", "new zebra", "same"), ("c.md", "first", "x"), ("c.md", "second", "x"), ("c.md", "first", "x"))
    assert index.update(twice, weights, folder) == {"version": 2, "added": 1, "removed": 1, "same": 1}
    held = index.read(spark, folder)
    assert len(found_by(spark, held, "first", "second")) == 1 and held.size == (2.0, 4.5) and held.lengths.count() == 2
    assert index.update(twice, weights, folder) == {"version": 2, "same": 2}


def test_texts_are_cut_into_terms_once(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("a.md", "x y x"), ("b.md", ""), ("c.md", "é E\u0301 Z"), ("d.md", None)], "path string, body string")
    want = sorted(map(tuple, index.row_lengths(rows, {"path": 1.0, "body": 2.0}).collect()))
    monkeypatch.setattr(index, "_length", None)  # a second pass over the texts
    folder = str(tmp_path / "i")
    index.update(rows, {"path": 1.0, "body": 2.0}, folder)
    opened = index.read(spark, folder)
    assert sorted(map(tuple, opened.lengths.collect())) == want and opened.size == (4.0, sum(n for _, n in want) / 4)
    assert opened.all().where("term IS NULL").isEmpty() and opened.terms().where("term IS NULL").isEmpty()
    assert {r["term"] for r in opened.of(["e", "x"]).collect()} == {"e", "x"}
    bare = spark.createDataFrame([(1, ""), (2, "--")], "path long, body string")  # no terms at all
    index.update(bare, {"body": 2.0}, str(tmp_path / "j"), "path")
    assert sorted(map(tuple, index.read(spark, str(tmp_path / "j")).lengths.collect())) == [(1, 0), (2, 0)]


def test_compaction_merges_runs_and_drops_dead_rows(spark, tmp_path):
    weights, folder = {"body": 1.0}, str(tmp_path / "ix")
    index.update(docs(spark, "alpha gone", "beta", "gamma"), weights, folder)
    index.update(spark.createDataFrame([("0.md", "alpha"), ("1.md", "beta beta")], "path string, body string"), weights, folder)
    before = index.read(spark, folder)
    assert before.dead.count() == 3 and [v for v, _ in before.runs] == [0, 1]
    scores = lambda held: {(r["query_id"], r["row_id"], round(r["score"], 9)) for r in search.bm25(search.or_run(queries(spark, "alpha", "beta gamma", "gone")), held).collect()}
    was = scores(before)
    assert index.compact(spark, folder) == 2
    after = index.read(spark, folder)
    assert scores(after) == was and after.dead is None and [v for v, _ in after.runs] == [2]
    assert {tuple(r) for r in after.vocabulary.select("term", "df").collect()} == {("alpha", 1), ("beta", 1)}
    assert sorted(p.name for p in (tmp_path / "ix").iterdir() if not p.name.startswith(".")) == ["manifest-2", "postings", "state-2", "terms"]
    assert index.compact(spark, folder) == 2
    # Many dead rows: the next repair compacts by itself, down to an empty index.
    assert index.repaired(spark.createDataFrame([], "path string, body string"), weights, folder).all().count() == 0
    assert found_by(spark, index.read(spark, folder), "alpha", "beta") == set()
    assert found_by(spark, index.repaired(docs(spark, "delta"), weights, folder), "delta", "beta") == {(0, "0.md")}


def test_an_index_follows_a_stream(spark, tmp_path):
    from notelake.streaming import sync

    weights, folder = {"body": 1.0}, str(tmp_path / "ix")
    for k, rows in enumerate((docs(spark, "alpha", "beta"), spark.createDataFrame([("1.md", "gamma"), ("2.md", "alpha")], "path string, body string"), None)):
        if rows is not None:
            rows.coalesce(1).write.parquet(str(tmp_path / "in" / f"batch={k}"))
        stream = spark.readStream.schema("path string, body string").parquet(str(tmp_path / "in" / "*"))
        sync.follow(stream, weights, folder, str(tmp_path / "cp")).awaitTermination()
    held = index.read(spark, folder)
    assert found_by(spark, held, "alpha", "beta", "gamma") == {(0, "0.md"), (0, "2.md"), (2, "1.md")} and held.lengths.count() == 3
    events = tmp_path / "log"
    events.mkdir()
    (events / "a.json").write_text('{"ts": "2024-01-01T00:10:00", "command": "search", "status": "ok"}\n{"ts": "2024-01-01T00:50:00", "command": "search", "status": "error"}\n')
    query = sync.windowed_usage(sync.usage_stream(spark, str(events))).writeStream.format("memory").queryName("usage_now").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r)[1:] for r in spark.table("usage_now").collect()] == [("search", 2, 1)]


def test_glossaries_merge_by_title(spark):
    schema = "title string, aliases array<string>, status string, scope string"
    old, more = spark.createDataFrame([("Kubernetes", ["k8s"], "approved", "ops")], schema), spark.createDataFrame([("kub\u00e9rnetes", ["kube", "k8s"], "approved", None), ("Zed", [], "draft", "")], schema)
    assert [tuple(r) for r in glossary.merge_terms(old, more).collect()] == [("Kubernetes", ["k8s", "kube"], "approved", "ops"), ("Zed", [], "draft", "")]


def test_a_batch_opens_the_folders_of_its_terms_alone(spark, tmp_path):
    folder = str(tmp_path / "ix")
    index.update(docs(spark, *(f"word{k} common" for k in range(300))), {"body": 1.0}, folder)
    held = index.read(spark, folder)
    few = held.of(["word7", "word8"])
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "In(term" in plan.split("PushedFilters")[1]
    assert {r["row_id"] for r in few.collect()} == {"7.md", "8.md"}
    opened = few.select(index.F.input_file_name().alias("f")).distinct().count()
    assert opened <= 2 and len(held.postings.inputFiles()) > 20
    assert {tuple(r) for r in held.frequencies(["word7", "common", "none"]).collect()} == {("word7", 1), ("common", 300)}


def test_accents_inside_and_after_letters_are_the_same(spark):
    rows = docs(spark, "decisa\u0303o e ac\u0327a\u0303o", "decis\u00e3o", "decisao", "deciso")
    assert found_by(spark, indexed(rows), "DECIS\u00c3O", "decisa\u0303o", "acao") == {(q, f"{k}.md") for q in (0, 1) for k in (0, 1, 2)} | {(2, "0.md")}


def test_snippets_are_cut_from_the_text_as_it_stands(spark):
    long = "Uma Decis\u00e3o [sic], sobre a A\u00c7\u00c3O!\n" + " ".join(f"w{k}," for k in range(40)) + " the Zebra_Crossing (here) a\u0303."
    rows = spark.createDataFrame([("a.md", long, "plain [text]"), ("b.md", "...", ""), ("c.md", None, "Only content")], "path string, body string, content string")
    found = spark.createDataFrame([(0, "a.md"), (1, "a.md"), (2, "a.md"), (0, "b.md"), (0, "c.md")], "query_id long, row_id string")
    asks = queries(spark, "decisao acao", "zebra_crossing \u00e3", "nothing")
    got = {(r["query_id"], r["row_id"]): r["snippet"] for r in search.best_snippets(found, rows, asks).collect()}
    assert got[0, "a.md"] == "Uma [Decis\u00e3o] [sic], sobre a [A\u00c7\u00c3O]!\nw0, w1, w2, w3, w4, w5..."
    assert got[1, "a.md"] == "...w33, w34, w35, w36, w37, w38, w39, the [Zebra]_[Crossing] (here) [a\u0303]."
    assert got[2, "a.md"] == "plain [text]" and got[0, "b.md"] == "..." and got[0, "c.md"] == "Only content"


def test_parts_of_notes(spark):
    rows = docs(spark, "first\nThe L\u00cdCENSE, and its version 2\nlast", "license: version", "version")
    found = {r["path"]: (r["line"], r["text"]) for r in passages.extract_snippet(rows, "license, Version", 1).collect()}
    assert found == {"0.md": (2, "first\nThe L\u00cdCENSE, and its version 2\nlast"), "1.md": (1, "license: version")}
    for bad in (lambda: passages.extract_snippet(rows, ""), lambda: passages.extract_snippet(rows, "x", -1), lambda: passages.extract_lines(index.F.col("body"), 0, 2), lambda: passages.extract_lines(index.F.col("body"), 3, 2)):
        try:
            bad()
        except ValueError:
            continue
        raise AssertionError(bad)


def test_lexical_pairs_and_holders_match_all_pairs(spark):
    import random

    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(40)]
    texts = [(f"{k}.md", " ".join(rng.choices(vocabulary, k=rng.randint(1, 30)))) for k in range(60)]
    asks = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for k in range(20)] + [(90, ""), (91, texts[5][1]), (92, texts[7][1].split()[0])]
    q, t = spark.createDataFrame(asks, "query_id long, text string"), spark.createDataFrame(texts, "path string, text string")
    want = set()
    for i, a in asks:
        for path, b in texts:
            if a and round(len(set(a.split()) & set(b.split())) / len(set(a.split())), 4) >= 0.55:
                want.add((i, path))
    assert {(r["query_id"], r["path"]) for r in similar.lexical_pairs(q, t).collect()} == want
    held = {(i, path) for i, a in asks for path, b in texts if a in b}
    assert {(r["query_id"], r["path"]) for r in evaluate.holders(q, t.withColumnRenamed("text", "body")).collect()} == held


def test_manifest_diff(spark):
    old, new = index.signatures(docs(spark, "a", "b")), index.signatures(docs(spark, "a", "c", "d"))
    assert {(r["path"], r["change"]) for r in index.manifest_diff(old, new).collect()} == {("0.md", "same"), ("1.md", "updated"), ("2.md", "added")}


def test_packets_keep_the_budget(spark):
    rows = spark.createDataFrame([("a.md", "t", "A", "x", "y" * 500), ("b.md", "t", "B", "x", "z")], "path string, type string, title string, tags string, body string")
    results = spark.createDataFrame([(1, "a.md", "s", 1), (1, "b.md", "s", 2)], "query_id int, row_id string, snippet string, rank int")
    full = retrieve.packets(results, rows, 50).first()
    assert full["used_tokens"] <= 50 and full["sources"] == "a.md" and full["context"].endswith("[truncated]\n")
    assert retrieve.packets(results, rows, 500).first()["sources"] == "a.md b.md"


def test_metrics_without_relevant_notes(spark):
    topics = spark.createDataFrame([(1,), (2,)], "query_id int")
    run = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, path string, rank int")
    qrels = spark.createDataFrame([(1, "y", 3)], "query_id int, path string, relevance int")
    got = {r["query_id"]: (r["recall"], r["mrr"]) for r in evaluate.per_topic(run, qrels, topics, 3).collect()}
    assert got == {1: (1.0, 0.5), 2: (1.0, 0.0)}


def test_append_outcomes(spark):
    rows = docs(spark, "have this")
    asks = spark.createDataFrame([("0.md", "have", None), ("0.md", "new", None), ("0.md", "new", "0"), ("9.md", "x", None)], "path string, addition string, expected_sha256 string")
    assert [r["outcome"] for r in changes.append_notes(asks, rows).orderBy("path", "addition", "expected_sha256").collect()] == ["noop", "update", "conflict", "missing"]
    # The hash is looked at first, and an empty addition is no addition.
    more = spark.createDataFrame([("0.md", "have", "0"), ("0.md", "AKIA" + "A" * 16, "0"), ("0.md", " \n", None), ("0.md", None, "")], "path string, addition string, expected_sha256 string")
    assert sorted(r["outcome"] for r in changes.append_notes(more, rows).collect()) == ["conflict", "conflict", "empty", "empty"]


def test_retrieve_asks_again_by_fusion(spark):
    rows = spark.createDataFrame([("a.md", "t", "A", "x y", "rotate credentials", ""), ("b.md", "t", "B", "", "oauth flow", "flow")], "path string, type string, title string, tags string, body string, content string")
    held = index.built(rows, {"body": 1.0})
    asks = queries(spark, "rotate credentials", "credentials oauth", "nothing here")
    plain = {r["query_id"]: r for r in retrieve.retrieve(asks, held, rows).collect()}
    auto = {r["query_id"]: r for r in retrieve.retrieve(asks, held, rows, ranker="auto").collect()}
    assert plain[0]["context"] == "path: a.md\ntitle: A\ntype: t\ntags: x, y\nsnippet: [rotate] [credentials]\ncontent:\nrotate credentials" == auto[0]["context"]
    assert [(plain[k]["sources"], plain[k]["ranker"]) for k in range(3)] == [("a.md", "bm25"), ("", "bm25"), ("", "bm25")]
    assert [(auto[k]["sources"], auto[k]["ranker"]) for k in range(3)] == [("a.md", "bm25"), ("a.md b.md", "rrf"), ("", "rrf")]


def test_sufficiency_ignores_case_and_counts_topics_without_facts(spark):
    contexts = spark.createDataFrame([(1, "The Lamp is RED"), (2, "nothing")], "query_id long, context string")
    facts = spark.createDataFrame([(1, "lamp IS red"), (1, "blue")], "query_id long, fact string")
    got = {r.query_id: (r.facts, r.covered, r.coverage) for r in evaluate.sufficiency(contexts, facts).collect()}
    assert got == {1: (2, 1, 0.5), 2: (0, 0, 1.0)}
