"""Registered queries on small tables."""

from notelake.plans import queries


def table(spark, folder, name, schema, *rows):
    spark.createDataFrame(list(rows), schema).write.parquet(f"{folder}/{name}.parquet")


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_append_outcomes_sees_whole_texts(spark, tmp_path):
    same = "word " * 20
    table(spark, tmp_path, "documents", DOCUMENTS, (2, same + "AKIA" + "A" * 16, "en", "s", 0), (3, same + "three", "en", "s", 0), (4, same + "four", "en", "s", 0), (5, same + "five", "en", "s", 0))
    got = sorted((r["path"], r["outcome"]) for r in queries.append_outcomes(spark, str(tmp_path)).collect())
    # 2 goes to 3, 3 to 4, 4 to 5 and 5 to itself.
    assert got == [("docs/00000003.md", "secret"), ("docs/00000004.md", "update"), ("docs/00000005.md", "noop"), ("docs/00000005.md", "update")]


def test_every_conversation_asks_with_its_whole_first_turn(spark, tmp_path):
    turns = [(c, t, "user", f"same old words {'zebra' if t == 0 else 'other'}{c}") for c in (3, 7, 10, 11) for t in (0, 1)]
    table(spark, tmp_path, "conversations", "conv_id long, turn long, role string, text string", *turns)
    strict = queries.bm25_passages(spark, str(tmp_path)).collect()
    assert sorted((r["query_id"], r["row_id"], r["rank"]) for r in strict) == sorted((c, f"talk/{c}:1:2", 1) for c in (3, 7, 10, 11))
    packets = {r["query_id"]: r["sources"] for r in queries.retrieve_passages_budget(spark, str(tmp_path)).collect()}
    assert packets.keys() == {3, 7, 10, 11} and all(p.startswith(f"talk/{c}") for c, p in packets.items())


def test_find_similar_keeps_hits_of_the_index_at_any_similarity(spark, tmp_path):
    long = " ".join(f"w{k}" for k in range(300))
    table(spark, tmp_path, "documents", DOCUMENTS, (1, "zebra " + long, "en", "s", 0), (2, long, "en", "s", 0), (3, "quite another text", "en", "s", 0))
    table(spark, tmp_path, "benchmark", "item_id long, text string", (1, "zebra qqq"), (2, "zebra"))
    got = {(r["query_id"], r["path"]): r["similarity"] for r in queries.find_similar(spark, str(tmp_path)).collect()}
    assert got[1, "docs/00000001.md"] == 0.5


def test_usage_payloads(spark, tmp_path):
    from notelake.operators import usage
    from notelake.sources.notes import append_events, read_events

    secret = "AKIA" + "B" * 16
    data = [
        '{"query": "deploy token:x ' + secret + '", "result_paths": ["a.md", ""], "Body": "gone", "deep": {"content": 1, "kept": ["' + secret + '"]}, "used_tokens": 7.9}',
        '{"query_terms": ["Deploy", "x"], "path": "a.md", "document": "b.md", "tokens": 3}',
        "no json",
        None,
    ]
    rows = spark.createDataFrame([(f"2024-01-0{k + 1}", c, "ok" if k else None, 2.0, d, None) for k, (c, d) in enumerate(zip(("search", "retrieve", None, "add"), data, strict=True))], "timestamp string, command string, status string, duration_ms double, data string, error string")
    append_events(rows, str(tmp_path / "log"))
    log = read_events(spark, str(tmp_path / "log"))
    kept = {r["command"]: r["data"] or "" for r in log.collect()}
    assert secret not in kept["search"] and "gone" not in kept["search"] and "content" not in kept["search"] and '"query_terms"' in kept["search"]
    assert [tuple(r) for r in usage.top_documents(log, "timestamp").collect()] == [("a.md", 2), ("b.md", 1)]
    assert {r["value"] for r in usage.top_terms(log, "timestamp").collect()} >= {"deploy", "x"}
    one = usage.summary(log, time_col="timestamp").first()
    assert (one["events"], one["errors"], one["writes"], one["total_estimated_tokens"], one["avg_duration_ms"]) == (4, 1, 1, 10, 2.0)
    assert usage.evidence(log).first()["ranker_status"] == "needs_more_usage"
    page = usage.report(log, "timestamp", "<Usage>")
    assert "&lt;Usage&gt;" in page and "a.md: 2" in page
    assert [r["query"] for r in usage.query_examples(log, "timestamp").collect()] == ["deploy token:x [REDACTED:AWS access key]"]


def test_evaluation_inputs_say_what_is_wrong(spark, tmp_path):
    from notelake.sources import vault

    (tmp_path / "topics.jsonl").write_text('{"id": "t1", "query": "a b", "tag": "x", "budget": 50, "system": ["s", ""]}\n\n{"id": "t1", "query": "again", "budget": 0}\n[1]\n{"id": "", "query": "q"}\n{"id": "t2", "query": "q", "mode": "all", "ranker": "best", "limit": "no"}\n')
    topics, issues = vault.read_topics(spark, str(tmp_path / "topics.jsonl"))
    assert sorted((r["query_id"], r["budget"], tuple(r["tags"]), tuple(r["systems"])) for r in topics.collect()) == [("t1", 50, ("x",), ("s",)), ("t1", 600, (), ()), ("t2", 600, (), ())]
    assert sorted((r["line"], r["error"]) for r in issues.collect()) == [
        (3, "budget must be a positive integer"), (3, "duplicate topic id"), (4, "topic must be a JSON object"), (5, "id must be a non-empty string"),
        (6, "limit must be a positive integer"), (6, "mode must be 'documents' or 'passages'"), (6, "ranker must be 'bm25' or 'rrf'"),
    ]
    (tmp_path / "qrels.tsv").write_text("query_id\tpath\trelevance\n# note\nt1\ta.md\t1\nt1\ta.md\t3\nt1\tb.md\nt1\t\t2\nt1\tc.md\tx\nt1\td.md\t-1\n")
    qrels, issues = vault.read_qrels(spark, str(tmp_path / "qrels.tsv"))
    assert [tuple(r) for r in qrels.collect()] == [("t1", "a.md", 3)] and sorted(r["line"] for r in issues.collect()) == [5, 6, 7, 8]
    (tmp_path / "tasks.jsonl").write_text('{"id": "k", "question": "q", "query_id": "t9", "expected_paths": ["a.md", "z.md"], "budget": 5}\n{"id": "k", "question": ""}\n')
    tasks, issues = vault.read_tasks(spark, str(tmp_path / "tasks.jsonl"), spark.createDataFrame([("a.md",)], "path string"), topics)
    assert tasks.count() == 1 and sorted(r["error"] for r in issues.collect()) == ["duplicate id", "expected path does not exist: z.md", "query_id does not exist: t9", "question must be a non-empty string"]
    (tmp_path / "cases.jsonl").write_text('{"id": "c", "append": "x", "expected_action": "merge"}\n')
    assert [r["error"] for r in vault.read_cases(spark, str(tmp_path / "cases.jsonl"))[1].collect()] == ["unknown expected_action"]
    assert vault.config_issues('{"exclude": "x", "search_limit": 0, "usage_tracking": 1}') == ["config exclude must be a list of strings", "config search_limit must be a positive integer", "config usage_tracking must be a boolean"]
    assert vault.config_issues(None) == [] and vault.config_issues("{")[0].startswith("config invalid JSON")


def test_vault_checks_and_archives(spark, tmp_path):
    from notelake.operators import checks, glossary, index, notes
    from notelake.sources import vault
    from notelake.sources.notes import parse_frontmatter, read_folder

    root = tmp_path / "w" / "vault"
    root.mkdir(parents=True)
    head = "---\ntype: runbook\ntitle: T\ndescription: d\ntags: [a]\ntimestamp: 2024-01-01T00:00:00Z\n---\nbody\n"
    (root / "good.md").write_text(head)
    (root / "bad.md").write_text(head.replace("runbook", "memo").replace("tags: [a]", "tags: a").replace("2024-01-01T00:00:00Z", "soon"))
    (root / "broken.md").write_text("x")
    (root / "SCHEMA.md").write_text("Profile: `team`\n\n## Types\n- runbook\n\n## Tags\n- a\n- b\n")
    parsed = parse_frontmatter(read_folder(spark, str(root)))
    schema = checks.parse_schema(spark.createDataFrame([(vault.read_note(spark, str(root), "SCHEMA.md"),)], "text string"))
    assert {(r["kind"], r["value"]) for r in schema.collect()} == {("profile", "team"), ("type", "runbook"), ("tag", "a"), ("tag", "b")}
    issues = checks.vault_issues(parsed, schema)
    found = sorted((r["path"], r["issue"]) for r in issues.collect())
    assert found == [("bad.md", "tags must be a list"), ("bad.md", "timestamp must be ISO 8601"), ("bad.md", "type 'memo' is not declared in SCHEMA.md"), ("broken.md", "missing YAML frontmatter block")]
    assert checks.vault_issues(parsed, None).first()["issue"] == "missing schema file"
    rows = parsed.where("error IS NULL")
    stale = index.staleness(index.manifest_diff(index.signatures(rows.limit(1)), index.signatures(rows)))
    lines = [r["line"] for r in checks.check_vault([], issues, stale).orderBy("k").collect()]
    assert lines[0] == "OK config" and lines[1] == "ERROR bad.md: tags must be a list" and lines[-1] == "STALE index: changed 0, missing 1, removed 0"
    archive = vault.export_vault(spark, str(root))
    (tmp_path / "v.zip").write_bytes(archive)
    assert {r["path"] for r in vault.read_archive(spark, str(tmp_path / "v.zip")).collect()} == {"good.md", "bad.md", "broken.md", "SCHEMA.md"}
    (root / "leak.md").write_text("k\nAKIA" + "C" * 16)
    for bad, text in ((lambda: vault.export_vault(spark, str(root)), "potential secret detected in leak.md: AWS access key on line 2"), (lambda: vault.read_note(spark, str(root), "../x"), "path must stay inside vault")):
        try:
            bad()
        except ValueError as error:
            assert str(error) == text
        else:
            raise AssertionError(text)
    stamped = notes.append_notes(spark.createDataFrame([("good.md", "more", None)], "path string, addition string, expected_sha256 string"), spark.createDataFrame([("good.md", head)], "path string, body string"), "2025-05-05").first()
    assert "timestamp: 2025-05-05\n---\nbody\n" in stamped["new_text"] and stamped["new_text"].endswith("\nmore\n")
    terms = spark.createDataFrame([("Zed", ["z"], "approved", ""), ("Ab", [], "draft", "all")], "title string, aliases array<string>, status string, scope string")
    text = glossary.rendered(terms)
    assert [(r["title"], r["aliases"], r["status"], r["scope"]) for r in glossary.parse_terms(text).orderBy("title").collect()] == [("Ab", [], "draft", "all"), ("Zed", ["z"], "approved", "")]
    asked = spark.createDataFrame([(1, "z now")], "query_id int, query string")
    assert glossary.or_string(asked, terms).first()["query"] == '"z" OR "now" OR "zed"'
    assert vault.json_lines(asked).first()["value"] == '{"query_id":1,"query":"z now"}'


def test_agent_tasks(spark):
    from notelake.operators import evaluate

    tasks = spark.createDataFrame([(1, "s", ["a.md"], ["Red lamp", "x"], False), (2, "s", [], [], True), (3, "t", ["a.md"], ["red"], False)], "query_id int, slice string, expected_paths array<string>, expected_facts array<string>, expect_abstention boolean")
    contexts = spark.createDataFrame([(1, "the RED lamp", "a.md b.md"), (3, "red", "a.md")], "query_id int, context string, sources string")
    results = evaluate.agent_tasks(tasks, contexts)
    assert {(r["query_id"], r["covered"], r["coverage"], r["sufficient"], r["correct_abstention"]) for r in results.collect()} == {(1, 1, 0.5, False, True), (2, 0, 1.0, True, True), (3, 1, 1.0, True, True)}
    assert {(r["slice"], r["tasks"], r["sufficiency"], r["mean_coverage"], r["stddev_coverage"]) for r in evaluate.agent_summary(results).collect()} == {("s", 2, 0.5, 0.75, 0.25), ("t", 1, 1.0, 1.0, 0.0)}
