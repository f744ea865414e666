"""Fingerprints, similar notes, substring search, suggestions, explanations and write-back."""

import random

import numpy as np
import pytest

from notelake.functions.fingerprints import HASHES, fingerprint_similarity, fingerprints, simhash
from notelake.operators import checks, evaluate, glossary, grams, search, similar
from notelake.operators import notes as changes

NOTE = "path string, title string, description string, aliases string, signals string, body string, type string, tags string, systems string, rank int"


def notes(spark, *bodies):
    return spark.createDataFrame([(f"{k:03}.md", f"T{k}", "", "", "", b, "t" if k % 2 else "u", "x y" if k % 3 else "z", "", 9) for k, b in enumerate(bodies)], NOTE)


def test_fingerprints_of_near_and_unrelated_texts():
    share = lambda a, b: round(1 - ((a ^ b) & (2**64 - 1)).bit_count() / 64, 4)
    a, b = fingerprints(["Update the CI secret after rotating workspace access and rerun the failed deployment job.", "After workspace access rotation, update the CI secret and rerun the failed deploy job."])
    c, d = fingerprints(["Update the CI secret after rotating workspace access.", "Plan support escalation for a blocked customer before the SLA deadline."])
    assert share(a, b) >= 0.65 and share(c, d) < 0.55
    assert fingerprints(["", None, " - ", "x"])[:3] == [None] * 3


def test_fingerprints_are_votes_of_each_gram():
    def slow(text, kind):
        bits, folded, digest = HASHES[kind]
        line = f"  {folded(' '.join(text.split()))}  "
        own = [digest(line[i : i + 4]) for i in range(len(line) - 3)]
        value = sum(1 << k for k in range(bits) if sum(1 if d >> k & 1 else -1 for d in own) > 0)
        return value - (1 << 64) if value >> 63 else value

    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcß漢É") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    for kind in HASHES:
        assert fingerprints(texts, kind) == [slow(t, kind) for t in texts]


def brute_similar(asks, bodies, limit):
    def prints(text):
        return fingerprints([text])[0]

    def words(text):
        return set(text.lower().split())

    out = {}
    for q, text in asks:
        found = []
        for k, body in enumerate(bodies):
            whole = f"T{k}\n\n\n\n{body}"
            lexical = len(words(text) & words(whole)) / len(words(text)) if words(text) else 0.0
            a, b = prints(text), prints(whole)
            near = round(1 - ((a ^ b) & (2**64 - 1)).bit_count() / 64, 4) if a is not None and b is not None else 0.0
            if max(lexical, near) >= 0.55:
                found.append((-round(max(lexical, near), 4), f"{k:03}.md"))
        out[q] = [(path, -s) for s, path in sorted(found)[:limit]]
    return out


def test_candidates_are_the_best_of_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    bodies = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(150)] + ["", "twin words here", "twin words here"]
    asks = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 25)))) for k in range(25)] + [(50, ""), (51, "twin words here"), (52, bodies[7])]
    queries = spark.createDataFrame(asks, "query_id long, text string")
    queries = queries.join(simhash(queries, "query_id", "text"), "query_id", "left")
    for sent in (200_000, 10):  # in one pass and in several
        monkeypatch.setattr(similar, "SENT_ROWS", sent)
        got = {q: [] for q, _ in asks}
        for r in similar.candidates(queries, notes(spark, *bodies), 4).collect():
            got[r["query_id"]].append((-round(r["similarity"], 4), r["path"]))
        assert {q: [(p, -s) for s, p in sorted(rows)] for q, rows in got.items()} == brute_similar(asks, bodies, 4)


def test_the_first_of_equal_values_are_kept():
    rng = np.random.default_rng(2)
    for _ in range(200):
        far = rng.integers(0, 6, rng.integers(0, 30))
        limit, most = int(rng.integers(1, 6)), int(rng.integers(0, 6))
        want = sorted(sorted((v, k) for k, v in enumerate(far.tolist()) if v <= most)[:limit], key=lambda x: x[1])
        assert similar.smallest(far, limit, most).tolist() == [k for _, k in want]


def test_find_similar_shows_hits_and_candidates(spark):
    rows = notes(spark, "rotate the deploy   token\nafter a 403", "rotate the deploy token", "quite another text", "rotate the deploy token after")
    asks = spark.createDataFrame([(1, "rotate the deploy token after a 403"), (2, "")], "query_id long, text string")
    hits = spark.createDataFrame([(1, "002.md", -1.5, "a [hit]"), (1, "000.md", -2.5, "[rotate]")], "query_id long, path string, score double, snippet string")
    got = {r["path"]: r for r in similar.find_similar(asks, rows, hits, 5).collect()}
    assert got["000.md"]["snippet"] == "[rotate]" and got["000.md"]["score"] == -2.5 and got["000.md"]["kind"] == "duplicate_candidate" and got["000.md"]["rank"] == 1
    assert got["002.md"]["score"] == -1.5 and got["002.md"]["similarity"] < 0.8 and got["003.md"]["snippet"] == "rotate the deploy token after" and got["003.md"]["score"] == 0
    only = similar.find_similar(asks, rows, hits.limit(0), 5, type_="U", tags=["Z"]).collect()
    assert {r["path"] for r in only} == {"000.md"} and only[0]["snippet"] == "rotate the deploy token after a 403"
    # A hit whose whole text compares worse gives way to the same note as a candidate.
    raw = search.F.lit("nothing alike at all")
    assert {r["path"]: r["score"] for r in similar.find_similar(asks, rows, hits, 5, raw=raw).collect()}["000.md"] == 0


def test_grep_equals_a_scan(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcé漢") for _ in range(rng.randint(1, 5))) for _ in range(40)]
    bodies = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 25))) for _ in range(80)] + ["Ab", "", "x" * 2000 + "needle"]
    rows = notes(spark, *bodies)
    asks = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 3)))) for k in range(60)] + [(90, "a"), (91, "b a"), (92, ""), (93, "NEEDLE"), (94, "zzzz"), (95, "xxxneedle a"), (96, "md 08")]
    queries = spark.createDataFrame(asks, "query_id long, query string")
    want = set()
    for q, text in asks:
        words = text.lower().split()
        hold = [f"{k:03}.md" for k, b in enumerate(bodies) if words and all(w in f"{k:03}.md\n{b}".lower() for w in words)]
        want |= {(q, p, r + 1) for r, p in enumerate(hold[:5])}
    assert {tuple(r) for r in search.grep(queries, rows, 5).select("query_id", "row_id", "rank").collect()} == want
    kept = grams.stored(rows.select(search.F.col("path").alias("row_id"), search.grep_text().alias("hay")), str(tmp_path / "g"))
    assert {tuple(r) for r in search.grep(queries, rows, 5, kept).select("query_id", "row_id", "rank").collect()} == want
    one = spark.createDataFrame([(1,)], "x int").select(search.F.explode(grams.grams_of(search.F.lit("needle"))).alias("gram"))
    plan = kept.of(kept.postings, one)._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "In(gram" in plan.split("PushedFilters")[1]


def test_grep_summary(spark):
    rows = notes(spark, "alpha", "alpha beta", "gamma")
    topics = spark.createDataFrame([(1, "a"), (2, "no_answer"), (3, "no_answer")], "query_id long, category string")
    run = spark.createDataFrame([(1, "000.md", 1), (1, "001.md", 2), (2, "002.md", 1)], "query_id long, path string, rank int")
    qrels = spark.createDataFrame([(1, "001.md", 1)], "query_id long, path string, relevance int")
    got = evaluate.grep_summary(run, qrels, topics, rows, 20).first().asDict()
    assert (got["topics"], got["mean_recall"], got["mean_mrr"], got["files_read"], got["returned_tokens"], got["false_positive_rate"]) == (3, 1.0, 0.1667, 3, 7, 0.5)


def test_suggestions_need_a_shared_word_and_both_edges(spark):
    rows = notes(spark, "the k8s cluster", "k8s alone", "kubernetes and k8s cluster", "cluster K9S n9 k8x kxxxxxxx8s")
    asks = spark.createDataFrame([(1, "Kubernetes cluster"), (2, "k8s kubernetes cluster"), (3, "")], "query_id long, query string")
    got = {tuple(r) for r in glossary.suggest(asks, rows, 9).select("query_id", "path", "term", "alias", "score").collect()}
    assert got == {(1, "000.md", "kubernetes", "k8s", 0.6), (1, "003.md", "kubernetes", "k9s", 0.6), (2, "003.md", "kubernetes", "k9s", 0.6)}


def test_suggestions_leave_their_task_as_the_best_of_each_query_alone(spark, monkeypatch):
    rnd = random.Random(5)
    word = lambda: rnd.choice(["kubernetes", "kitties", "katastrofes", "cluster", "clear", "k8s", "K9S", "c5r", "x7z", "the", "of", "path:"])
    bodies = [" ".join(word() for _ in range(rnd.randrange(0, 6))) for _ in range(90)]
    asked = [(k, " ".join(word() for _ in range(rnd.randrange(0, 5)))) for k in range(12)]
    rows = notes(spark, *bodies).repartition(3)
    asks = spark.createDataFrame(asked, "query_id long, query string")
    tokens = lambda text: set(text.lower().replace("path:", "").split())
    want = []
    for q, query in asked:
        qw, found = tokens(query), []
        for k, body in enumerate(bodies):
            nw = tokens(body)
            pairs = [(t, a) for t in qw - nw if len(t) >= 5 for a in nw - qw if a[-2].isdigit() and t[0] + t[-1] == a[0] + a[-1]] if qw & nw else []
            found += [(-round(0.5 + min(len(qw & nw), 4) * 0.1, 4), f"{k:03}.md", t, a, len(qw & nw)) for t, a in pairs]
        want += [(q, path, t, a, n, -score, r) for r, (score, path, t, a, n) in enumerate(sorted(found)[:4], 1)]
    for cells in (1, 200, 8_000_000):
        monkeypatch.setattr(glossary, "_CELLS", cells)
        got = glossary.suggest(asks, rows, 4)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 20
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("MapInArrow") == 1
    monkeypatch.setattr(glossary, "SENT_ROWS", 9)
    assert sorted(tuple(r) for r in glossary.suggest(asks, rows, 4).collect()) == sorted(want)
    assert not glossary.suggest(asks, rows, 0).count() and not glossary.suggest(asks.limit(0), rows, 4).count()


def test_explanations_name_synonyms_and_passages(spark):
    terms = spark.createDataFrame([("Kubernetes", ["k8s"], "approved")], "title string, aliases array<string>, status string")
    rows = spark.createDataFrame([("a", "Décision", "on kubernetes", "whole", "the K8S part")], "row_id string, title string, body string, tags string, passage string")
    asks = spark.createDataFrame([(1, "decisao DECISION k8s nothing decision")], "query_id long, query string")
    found = spark.createDataFrame([(1, "a"), (1, "gone")], "query_id long, row_id string")
    assert {(r["term"], r["fields"]) for r in checks.explain_matches(found, asks, rows, terms).collect()} == {("DECISION", "title"), ("k8s", "passage"), ("kubernetes", "body")}


def test_explanations_find_their_results_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([("a", "one text"), ("b", "other text")], "row_id string, body string")
    asks = spark.createDataFrame([(1, "text")], "query_id long, query string")
    found = spark.createDataFrame([(1, "a"), (1, "b")], "query_id long, row_id string").mapInArrow(counted, "query_id long, row_id string")
    assert checks.explain_matches(found, asks, rows).count() == 2 and seen.value == 2


def test_writeback_decides_by_the_best_and_its_lead(spark):
    rows = notes(spark, "have this text", "other")
    found = spark.createDataFrame([(1, "000.md", 0.9, 1), (1, "001.md", 0.6, 2), (2, "000.md", 0.9, 1), (3, "000.md", 0.9, 1), (4, "001.md", 0.69, 1)], "query_id long, path string, similarity double, rank int")
    cases = spark.createDataFrame([(1, "new", None), (2, "this text", ""), (3, "new", "0"), (4, "new", None), (5, "new", None)], "query_id long, append string, expected_sha256 string")
    got = {r["query_id"]: (r["path"], r["action"], r["reason"], r["candidates"], r["margin"]) for r in similar.writeback(cases, found, rows).collect()}
    assert got == {1: ("000.md", "update", "updated", 2, 0.3), 2: ("000.md", "noop", "already_present", 1, 0.9), 3: ("000.md", "conflict", "conflict", 1, 0.9), 4: (None, "create", "created", 1, 0.69), 5: (None, "create", "created", 0, 0.0)}


def test_a_merge_sets_rejects_aside(spark):
    rows = notes(spark, "old", "other\n")
    secret = "AKIA" + "A" * 16
    told = [
        (1, "update", "000.md", "first", "t", "d", "t", ["x"]), (2, "update", "000.md", " second ", "t", "d", "t", ["x"]), (3, "update", "000.md", "first", "t", "d", "t", ["x"]),
        (4, "update", "001.md", secret, "t", "d", "t", ["x"]), (5, "conflict", "001.md", "x", "t", "d", "t", ["x"]), (6, "noop", "001.md", "x", "t", "d", "t", ["x"]), (7, "update", "001.md", None, "t", "d", "t", ["x"]),
        (8, "create", None, "body", "New Note", "d", "t", ["x"]), (9, "create", None, "again", "new note!", "d", "t", ["x"]), (10, "create", None, "b", "Odd", "d", "nope", ["x"]), (11, "create", None, "b", "Tag", "d", "t", ["bad"]),
        (12, "create", None, secret, "S", "d", "t", ["x"]), (13, "create", None, "b", "No description", " ", "t", ["x"]), (14, "create", None, "b", "000", "d", "t", None),
    ]
    decisions = spark.createDataFrame(told, "query_id long, action string, path string, append string, title string, description string, type string, tags array<string>")
    done, rejects = changes.merge_writes(rows.unionByName(notes(spark, "z").withColumn("path", search.F.lit("knowledge/000.md"))), decisions, types=["t"], tags=["x"])
    assert {tuple(r) for r in done.collect()} == {("000.md", "updated", "old\n\nfirst\n\nsecond\n"), ("knowledge/new-note.md", "created", "body\n")}
    assert {(r["query_id"], r["reason"]) for r in rejects.collect()} == {(4, "secret"), (5, "conflict"), (9, "exists"), (10, "policy"), (11, "policy"), (12, "secret"), (13, "policy"), (14, "exists")}


@pytest.mark.parametrize("kind", list(HASHES))
def test_similarity_counts_equal_bits(spark, kind):
    bits = HASHES[kind][0]
    pair = spark.createDataFrame([(-1 if bits == 64 else (1 << 60) - 1, 0), (5, 5)], "a long, b long")
    assert [r[0] for r in pair.select(fingerprint_similarity(search.F.col("a"), search.F.col("b"), kind)).collect()] == [0.0, 1.0]


def test_lexical_pairs_read_the_texts_once_and_shuffle_no_words(spark, monkeypatch):
    rng = random.Random(9)
    bodies = [" ".join(rng.choices("a b c d e f g h i j k l".split(), k=rng.randint(0, 9))) for _ in range(120)] + [None]
    asks = [(k, " ".join(rng.choices("a b c d e f g h x".split(), k=rng.randint(0, 7)))) for k in range(40)] + [(None, "a b")]
    want = set()
    for q, ask in asks:
        for k, body in enumerate(bodies):
            own, there = set(ask.split()), set((body or "").split())
            if q is not None and own & there and round(len(own & there) / len(own), 4) >= 0.55:
                want.add((q, f"{k:03}.md", round(len(own & there) / len(own), 4)))
    texts = spark.createDataFrame([(f"{k:03}.md", b) for k, b in enumerate(bodies)], "path string, text string").repartition(3)
    for sent, cells in ((200_000, 8_000_000), (200_000, 900), (50, 300)):  # in one pass, in small parts, in several passes
        monkeypatch.setattr(similar, "SENT_ROWS", sent)
        monkeypatch.setattr(similar, "_CELLS", cells)
        pairs = similar.lexical_pairs(spark.createDataFrame(asks, "query_id long, text string"), texts)
        assert sorted((r[0], r[1], round(r[2], 4)) for r in pairs.collect()) == sorted(want)
    monkeypatch.undo()
    plan = similar.lexical_pairs(spark.createDataFrame(asks, "query_id long, text string"), texts.coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1
