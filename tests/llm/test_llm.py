"""Each operator on small fixtures with nulls, empty and long texts, ties, repeats and extra columns."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from notelake.llm import ann, brown, chat, decontaminate, jaccard, packing, quality, substrings, toxicity, wavelet
from notelake.llm import labelled as labelled_rows
from notelake.llm.common import components
from notelake.llm.tokens import encoder, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig long, token long, words int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, 7, 7) for i, t in rows], SCHEMA)


def corpus():
    rng = random.Random(1)
    base = words(rng, 80)
    parts = base.split()
    near = " ".join(parts[:40] + ["changed"] + parts[41:])
    return [(0, base), (1, near), (2, base.upper()), (3, None), (4, ""), (5, words(rng, 60)), (6, "one two"), (7, "one  two\n"), (8, words(rng, 3000)), (9, base), (9, base), (None, base), (10, "Ünï  ço\t dé — x")]


def test_empty_tables(spark):
    none = frame(spark, []).limit(0)
    path = vocabulary("byte_bpe_50k.json")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    outs = [substrings.repeated_spans(none), packing.pack_documents(none, path), jaccard.join_classes(none), decontaminate.contaminated(none, items), ann.nearest(vectors), toxicity.score_toxicity(none, labels), quality.score_quality(none, labels), chat.format_conversations(turns), brown.score_texts(none)]
    assert [df.count() for df in outs] == [0] * len(outs)


def brute_classes(rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    own = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in own if i is not None}
    links = [(a, b) for a, x in own for b, y in own if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y)]
    for _ in own:
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    return sorted((i if i is not None else -1, len(s), root[i] if i is not None else -1) for i, s in own)


def test_jaccard_classes_match_all_pairs(spark):
    got = jaccard.join_classes(frame(spark, corpus())).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in got) == brute_classes(corpus())


def test_jaccard_chain_of_copies(spark):
    rng = random.Random(4)
    w = words(rng, 100).split()
    rows = []
    for k in range(25):
        rows.append((k, " ".join(w)))
        w[rng.randrange(100)] = f"new{k}"
    got = jaccard.join_classes(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_classes(rows)


def test_jaccard_with_hot_passages_and_many_near_copies(spark):
    rng = random.Random(8)
    hot = words(rng, 60)
    groups = [words(rng, 120).split() for _ in range(4)]
    rows = []
    for k in range(120):
        w = list(groups[k % 4])
        for _ in range(rng.choice((0, 1, 2, 3, 6))):
            w[rng.randrange(120)] = f"e{rng.randrange(40)}"
        rows.append((k, " ".join(w)))
    # Long texts of shared passages, some of them near copies; a passage that very many texts have.
    blocks = [words(rng, 150) for _ in range(12)]
    for k in range(40):
        rows.append((200 + k, " ".join(rng.sample(blocks, 6)) + " " + words(rng, rng.choice((5, 200)))))
    rows += [(300 + k, hot + " " + words(rng, 3 + k % 15)) for k in range(60)]
    rng.shuffle(rows)
    got = jaccard.join_classes(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_classes(rows)


def test_one_of_each_goes_by_id_and_text(spark):
    rng = random.Random(9)
    a, b = words(rng, 50), words(rng, 50)
    rows = [(1, a), (2, a + " more"), (2, b), (3, b), (4, None), (4, ""), (None, a), (2, a + " more")]
    kept = jaccard.one_of_each(frame(spark, rows).withColumnRenamed("lang", "gone_id"))
    assert sorted(((r["doc_id"] or 0), r["text"] or "") for r in kept.collect()) == sorted([(1, a), (2, b), (4, ""), (4, ""), (0, a)])
    assert jaccard.one_of_each(frame(spark, []).limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 9), (9, 8), (3, 4), (5, 5)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7), (9, 7)}


def test_substrings_cut_later_copies_only(spark):
    rng = random.Random(2)
    passage = words(rng, 90)
    rows = [(0, words(rng, 50) + " " + passage + " " + words(rng, 30)), (1, words(rng, 20) + "x " + passage + " " + words(rng, 30)), (2, words(rng, 100)), (3, None), (4, ""), (5, "short line")]
    docs = frame(spark, rows)
    spans = substrings.repeated_spans(docs)
    found = spans.collect()
    assert {r["doc_id"] for r in found} == {1} and {r["source_id"] for r in found} == {0}
    cut = {r["doc_id"]: r for r in substrings.without_spans(docs, spans).collect()}
    assert all(cut[i]["text"] == t for i, t in rows if i != 1)
    assert len(cut[1]["text"].split()) < 50 + 51 and cut[1].asDict().keys() == {c.split()[0] for c in SCHEMA.split(", ")}


def brute_spans(rows):
    """The rule of repeated_spans() over (id, text) with one text for each id, without Spark."""
    cut = {}
    for i, t in sorted((i, t) for i, t in rows if i is not None and t):
        raw = t.encode()
        ends = substrings.chunk_ends(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).tolist()
        cut[i] = raw, [0, *ends]
    count = lambda raw: len(re.findall(rb"[^\x20\x09-\x0D]+", raw))
    first, found = {}, []
    for i, (raw, at) in cut.items():
        pairs = [(a, b, c) for a, b, c in zip(at, at[1:], at[2:])] or [(at[0], at[1], at[1])]
        chain = []
        for a, b, c in [*pairs, (None, None, None)]:
            owner = None
            if a is not None:
                j, where = first.setdefault(raw[a:c], (i, a))
                owner = j if j != i or a >= where + c - a else None
            if owner is not None:
                chain.append((a, b, c, owner))
            elif chain:
                owned = {}
                for k, (a, b, c, o) in enumerate(chain):
                    # A word that a cut parts counts for the piece it begins in, as in the operator.
                    begin = count(raw[:b]) - count(raw[:a]) + (k + 1 == len(chain)) * (count(raw[:c]) - count(raw[:b]))
                    owned[o] = owned.get(o, 0) + begin
                top, name = max((w, -o) for o, w in owned.items())
                if sum(owned.values()) >= substrings.MIN_WORDS and top >= substrings.MIN_OWNED:
                    found.append((i, chain[0][0], chain[-1][2] - chain[0][0], sum(owned.values()), -name, top))
                chain = []
    return sorted(found)


def test_spans_match_brute_force(spark):
    rng = random.Random(12)
    lines = [words(rng, 10) + "\n" for _ in range(9)]
    passages = [words(rng, 70) for _ in range(5)]
    rows = [(k, lines[k] + words(rng, 40)) for k in range(9)]
    # Lines that occur one by one before they stand together twice.
    rows += [(10, words(rng, 30) + "\n" + "".join(lines[:7]) + words(rng, 30)), (11, words(rng, 20) + "\n" + "".join(lines[:7]) + words(rng, 5))]
    for k in range(20, 60):
        parts = [words(rng, rng.randint(1, 60)) for _ in range(3)] + rng.sample(passages, 2)
        rng.shuffle(parts)
        rows.append((k, rng.choice([" ", "\n"]).join(parts)))
    rows += [(70, passages[0] + " " + passages[0] + " " + passages[0]), (71, "same " * 200), (72, "x" * 5000), (73, "y" * 40), (74, "x" * 5000), (80, None), (81, ""), (82, words(rng, 2500) + passages[1])]
    got = substrings.repeated_spans(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["start"], r["length"], r["words"], r["source_id"], r["owned_words"]) for r in got) == brute_spans(rows)
    assert any(r["doc_id"] == 11 and r["source_id"] == 10 for r in got) and not any(r["doc_id"] == 10 for r in got)


def test_rows_that_share_an_id_are_cut_by_their_own_spans(spark):
    rng = random.Random(13)
    passage, other = words(rng, 90), "é" * 700 + " " + words(rng, 300)
    rows = [(1, passage), (2, passage + " end"), (2, other), (3, "Ü " + other), (4, None), (None, passage), (2, passage + " end")]
    docs = frame(spark, rows).withColumnRenamed("lang", "span_doc").withColumnRenamed("source", "span_cuts")
    cut = substrings.without_spans(docs, substrings.repeated_spans(docs)).collect()
    texts = sorted((r["doc_id"] or 0, r["text"] or "") for r in cut)
    assert (2, other) in texts and (0, passage) in texts and (1, passage) in texts and (4, "") in texts and len(texts) == len(rows)
    assert all(len(t.split()) < 30 for i, t in texts if i == 3 or i == 2 and t != other)
    none = frame(spark, []).limit(0)
    assert substrings.without_spans(none, substrings.repeated_spans(none)).count() == 0


def test_toxicity_of_a_text_ignores_its_neighbours():
    rng = random.Random(14)
    rows = [(f"{words(rng, 6)} {w} {words(rng, 5)}.", int(w == "wxother")) for _ in range(200) for w in ("wxother", "kettle")]
    model = toxicity.ToxicityModel(rows)
    texts = ["ends in a", "z w x o t h e r there", "", None, "a b c", "w x o t h", "e r", "calm words only"]
    alone = [model.scores(pa.array([t], pa.string()))[0] for t in texts]
    assert np.allclose(model.scores(pa.array(texts, pa.string())), alone) and alone[1] > 0.5 > alone[-1]


def test_chunk_ends_ignore_what_stands_before():
    rng = random.Random(3)
    a, b = words(rng, 200).encode(), words(rng, 30).encode()
    alone = substrings.chunk_ends(np.frombuffer(a, np.uint8), np.array([0, len(a)]))
    after = substrings.chunk_ends(np.frombuffer(b + a, np.uint8), np.array([0, len(b), len(b) + len(a)]))
    assert (after[after > len(b)] - len(b)).tolist() == alone.tolist()


@pytest.mark.parametrize("name, folds", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_encoder_equals_the_library(name, folds):
    texts = [t for _, t in corpus()] + ["a b　c  d\r\n e", "<|endoftext|> ~ x~y", " lead", "trail \n", "it's I'LL 123abc!!"]
    enc = encoder(vocabulary(name), folds)
    ids, offsets = enc.encode(pa.array(texts), 1)
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == [*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]


def test_packing_covers_all_ids_within_limits(spark):
    limits = packing.Limits(256, 8, 200)
    docs = frame(spark, corpus()).selectExpr("*", "5L AS prompt")
    rows = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), limits=limits, prompt_tokens_col="prompt", with_ids=True).collect()
    enc = encoder(vocabulary("byte_bpe_50k.json"))
    want = sorted(tuple([*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for _, t in corpus())
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        total = sum(r["length"] for r in own)
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert total <= 256 and len(own) <= 8 and sum(r["loss_tokens"] for r in own) <= 200 and total & (total - 1) == 0
    assert sum(r["length"] for r in rows) == sum(map(len, want)) and sorted(i for r in rows for i in r["ids"]) == sorted(i for t in want for i in t)
    assert sum(r["loss_tokens"] for r in rows) == sum(max(0, len(t) - 5) for t in want)


@pytest.mark.parametrize("n", [5000, 200_000, 2 * wavelet.BLOCK_BITS])
def test_wavelet_shard_answers(n):
    rng = np.random.default_rng(5)
    ids = np.sort(rng.integers(0, 300, n)).astype(np.uint32) if n % 2 else rng.integers(0, 300, n).astype(np.uint32)
    shard = wavelet.Shard(wavelet.encode_shard(ids, [4, None], np.array([2000, n - 2000])))
    assert (shard.ids() == ids).all() and shard.documents()[0] == [4, None]
    for i in (0, 511, 512, n // 2, n - 1):
        assert shard.access(i) == ids[i]
    for token in (0, 17, 299, 300, 5000):
        where = np.flatnonzero(ids == token)
        assert shard.count(token) == len(where) and shard.rank(token, n // 2) == (where < n // 2).sum()
        assert [shard.select(token, j) for j in range(3)] == [*where[:3].tolist(), -1, -1, -1][:3]
        assert shard.select(token, len(where)) == -1 and (not len(where) or shard.select(token, len(where) - 1) == where[-1])


def test_wavelet_access_reads_a_block_of_each_plane():
    ids = np.random.default_rng(6).integers(0, 256, 8 * wavelet.BLOCK_BITS).astype(np.uint32)
    shard = wavelet.Shard(wavelet.encode_shard(ids, [1], np.array([len(ids)])))
    assert shard.access(300_000) == ids[300_000] and len(shard._kept) <= shard.bits == 8


def test_wavelet_rows_without_or_with_one_id(spark, tmp_path):
    rows = [(None, "a b"), (None, "c"), (5, "x y"), (5, "x y"), (5, ""), (2, None)]
    path = vocabulary("word_bpe_49k.json")
    got = wavelet.read_documents(wavelet.write_shards(frame(spark, rows), str(tmp_path / "w"), path, folds=True)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 2, 5, 5, 5] and sum(r["n_tokens"] for r in got) == got[-1]["start"] + got[-1]["n_tokens"]
    assert wavelet.read_documents(wavelet.write_shards(frame(spark, []).limit(0), str(tmp_path / "e"), path, folds=True)).count() == 0


def test_wavelet_round_trip(spark, tmp_path):
    docs = frame(spark, [r for r in corpus() if r[0] is not None])
    got = wavelet.read_documents(wavelet.write_shards(docs, str(tmp_path / "w"), vocabulary("word_bpe_49k.json"), shard_tokens=100, folds=True)).orderBy("start").collect()
    enc, at = encoder(vocabulary("word_bpe_49k.json"), True), 0
    for (i, t), r in zip(sorted((r for r in corpus() if r[0] is not None), key=lambda r: (r[0], r[1] or "")), got, strict=True):
        ids = np.array([*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_decontamination_finds_edited_items(spark):
    rng = random.Random(6)
    item, other = words(rng, 40), words(rng, 25)
    edited = item.split()
    edited[20] = "changed"
    rows = [(0, words(rng, 30) + " " + item + " " + words(rng, 10)), (1, " ".join(edited)), (2, words(rng, 200)), (3, None), (4, " ".join(item.split()[:12])), (5, other.upper())]
    items = spark.createDataFrame([(1, item), (2, other), (3, None), (4, " "), (None, item)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(spark, rows), items).collect()}
    assert got == {(0, 1), (1, 1), (5, 2)}
    assert {r["doc_id"] for r in decontaminate.without_contaminated(frame(spark, rows), items).collect()} == {2, 3, 4}


def test_contaminated_rows_that_share_an_id_part_by_text(spark):
    rng = random.Random(12)
    item, clean = words(rng, 40), words(rng, 90)
    rows = [(1, words(rng, 20) + " " + item), (1, clean), (1, clean), (2, item), (None, item), (1, None)]
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    docs = frame(spark, rows).withColumnRenamed("sig", "found_id").withColumnRenamed("token", "text_key")
    left = decontaminate.without_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"] or 0), r["text"] or "") for r in left.collect()) == sorted([(1, clean), (1, clean), (0, item), (1, "")])
    assert "text_key" not in decontaminate.contaminated(docs, items).columns


def brute_contaminated(rows, items, width=5, threshold=0.8):
    """All (doc, item) whose best window of the item's words has the threshold's share of its shingles' weight."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda w: {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}
    sets = {i: grams(split(t)) for i, t in items}
    having = {}
    for own in sets.values():
        for g in own:
            having[g] = having.get(g, 0) + 1
    weight = {g: 1 + math.log(len(items) / n) for g, n in having.items()}
    out = set()
    for d, t in rows:
        w = split(t)
        for i, text in items:
            n = len(split(text))
            for a in range(max(1, len(w) - n + 1)):
                own = sets[i] & grams(w[a : a + n])
                if own and sum(weight[g] for g in own) >= threshold * sum(weight[g] for g in sets[i]) - 1e-12:
                    out.add((d, i))
                    break
    return out


def test_decontamination_matches_brute_force(spark, monkeypatch):
    rng = random.Random(21)
    common = words(rng, 12)
    items = [(k, " ".join([words(rng, rng.randint(4, 40)), *([common] if k % 4 == 0 else [])])) for k in range(30)]
    rows = []
    for d in range(150):
        w = items[rng.randrange(30)][1].split()
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
            w[rng.randrange(len(w))] = f"z{rng.randrange(99)}"
        if rng.random() < 0.3:
            del w[rng.randrange(len(w))]
        rows.append((d, " ".join([words(rng, rng.randint(0, 60)), *w, words(rng, rng.randint(0, 60))])))
    rows.append((900, " ".join(items[k % 30][1] for k in range(3000))))  # a very long text full of items
    table = spark.createDataFrame(items, "item_id long, text string")
    run = lambda: {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(frame(spark, rows), table).collect()}
    got, want = run(), brute_contaminated(rows, items)
    # The radius may lose pairs just above the threshold: none is wrong, and few are missed.
    assert got.keys() <= want and len(got) >= 0.95 * len(want) and {i for d, i in got if d == 900} == set(range(30))
    # Groups of items change nothing.
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 7)
    again = run()
    assert again.keys() == got.keys() and all(math.isclose(again[k], got[k]) for k in got)


def test_hamming_index_is_complete():
    rng = random.Random(8)
    items = decontaminate.Items([(k, words(rng, 20)) for k in range(50)], 5)
    for _ in range(200):
        mark = int(items.marks[rng.randrange(50)])
        for b in rng.sample(range(64), rng.randint(0, 25)):
            mark ^= 1 << b
        want = {k for k, m in enumerate(items.marks.tolist()) if (m ^ mark).bit_count() <= decontaminate.RADIUS}
        assert set(items.near(mark)) == want


def test_nearest_on_whole_windows(spark):
    rng = np.random.default_rng(9)
    rows = [(int(k), [float(x) for x in v]) for k, v in enumerate(rng.standard_normal((300, 16)))]
    rows += [(1000 + k, rows[0][1]) for k in range(20)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0]), (None, [1.0] * 16)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), curves=6).collect()
    good = [(i, np.array(v)) for i, v in rows if i is not None and i < 2000]
    for q, x in good:
        if q % 50 == 0:
            sims = sorted(((-round(float(x @ v / np.sqrt(x @ x) / np.sqrt(v @ v)), 9), i) for i, v in good if i != q))[:5]
            own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
            assert [r["vec_id"] for r in own] == [i for _, i in sims]


def test_hilbert_neighbours_touch():
    side = np.arange(16)
    grid = np.array([(a, b, c) for a in side for b in side for c in side])
    keys = ann.hilbert_keys(grid, 4)
    path = grid[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(16**3)) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "a</s> \\l [x"), (1, 0, "user", "u [INST]"), (1, 2, "tool\nx", "<s>"), (2, 0, None, None), (2, None, "system", "s\\"), (3, 0, "user", "p"), (3, 0, "user", "p"), (None, 0, "assistant", "é😀")]
    out = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for r in out.values():
        assert r["turns"] == r["recovered"]
        taken, at = [], 0
        for m in r["loss_mask"]:
            at += m["skip"]
            taken.append(r["formatted"][at : at + m["take"]])
            at += m["take"] + m["then_skip"]
        assert at == len(r["formatted"])
        plain = [t.replace("\\l", "<").replace("\\b", "[").replace("\\e", "\\") if "\\" in t else t for t in taken]
        assert "".join(plain) == "".join(t["text"] for t in r["turns"] if t["role"] == "assistant")
    assert [t["text"] for t in out[1]["turns"]] == ["u [INST]", "a</s> \\l [x", "<s>"] and len(out[3]["turns"]) == 2
    assert out[2]["turns"][0]["role"] == "system" and "\\" not in out[3]["formatted"]


def labelled(spark, n=300):
    rng = random.Random(10)
    docs, labels = [], []
    for k in range(n):
        toxic = k % 3 == 0
        w = words(rng, 40).split()
        if toxic:
            for bad in ("zqxwor", "kvylum"):
                w.insert(rng.randrange(40), bad)
        low = k % 4 == 0
        docs.append((k, " | ".join(w) if low else " ".join(w)))
        labels.append((k, int(not low), int(toxic)))
    return frame(spark, [*docs, (n, None), (n + 1, "z-q-x w zqx_wor!"), (n + 2, "ZQXxWOR")]), spark.createDataFrame([*labels, (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_learns_and_tolerates_gaps(spark):
    docs, labels = labelled(spark)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    held = [r for r in got.values() if r["held_out"] and r["doc_id"] < 300]
    assert sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in held) >= 0.95 * len(held)
    assert got[300]["predicted"] == 0 and got[301]["predicted"] == 1 and got[302]["predicted"] == 1


def test_toxic_examples_are_the_worst_sentences_and_all_found_toxic():
    rows = [("calm day. zqxwor here. kvylum there too", 1), ("calm day again. tea now", 0), ("", 0), ("a b", 0)]
    own = toxicity.Sentences(rows)
    value = np.array([{"zqxwor": 0.5, "kvylum": 2.0}.get(w, -1.0) for w in own.terms])
    toxic, clean = own.worst(value)
    assert {own.terms[k]: n for k, n in toxic.items()} == {"zqxwor": 1, "kvylum": 1}
    assert {own.terms[k]: n for k, n in clean.items()} == {"calm": 1}
    toxic, _ = own.worst(np.full(len(own.terms), -1.0))
    assert {own.terms[k]: n for k, n in toxic.items()} == {"calm": 1}


def test_folded_machine_equals_the_kernel_with_its_landmarks():
    rng = random.Random(15)
    names = ["".join(rng.choices("abcdez", k=rng.randrange(3, 12))) for _ in range(40)]
    marks = [toxicity.features(w) for w in names[:9]]
    alpha = [rng.uniform(-1, 1) for _ in marks]
    model = toxicity.ToxicityModel([])
    model._fold(marks, alpha)

    def brute(a, b):  # every pair of three-letter subsequences, letter by letter
        def all_of(w):
            out = {}
            for i, j, k in itertools.combinations(range(len(w)), 3):
                if k - i < toxicity.SPAN:
                    out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], 0) + toxicity.DECAY ** (k - i + 1)
            return out

        x, y = all_of(a), all_of(b)
        norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        return sum(v * y.get(u, 0) for u, v in x.items()) / norm

    want = [sum(a * brute(w, m) for a, m in zip(alpha, names[:9], strict=True)) for w in names]
    # Windows without a shared gain keep the bias alone.
    assert np.allclose(model.words(names), [max(v, 0) for v in want], atol=1e-5)


def test_samples_hold_long_texts_whole_within_their_characters(spark):
    docs = frame(spark, [(k, f"{k} " * 30_000 if k == 3 else f"text {k}") for k in range(8)] + [(8, ""), (9, None)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(10)], "doc_id long, y int")
    got = labelled_rows.sample(docs, labels, "y", F.lit(True))
    assert len(got) == 8 and ("3 " * 30_000, 1) in got
    few = labelled_rows.sample(docs, labels, "y", F.lit(True), chars=14)
    assert [y for _, y in few].count(0) == 2 and all(len(t) < 10 for t, _ in few)
    assert len({y for _, y in labelled_rows.sample(docs, labels, "y", F.lit(True), rows=1)}) == len(labelled_rows.sample(docs, labels, "y", F.lit(True), rows=1))  # at most one of each


def test_quality_sizes_match_one_frame_a_block():
    rng = random.Random(16)
    rows = [(words(rng, 60) if k % 2 else "".join(rng.choices("#|{}0", k=300)), k % 2) for k in range(120)]
    model = quality.QualityModel(rows)
    text = (words(rng, 6000) + " " + "#|" * 900).encode()
    sizes = []
    for raw in (model.good, model.bad):
        # One compressor a block, so nothing can be carried over.
        blocks = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw), level=quality.LEVEL, write_content_size=False, write_dict_id=False).compress(text[a : a + quality.BLOCK]) for a in range(0, len(text), quality.BLOCK)]
        plain = [zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)).decompress(b, max_output_size=quality.BLOCK) for b in blocks]
        assert b"".join(plain) == text
        sizes.append(sum(map(len, blocks)))
    want = (sizes[1] - sizes[0]) / len(text), min(sizes) / len(text)
    assert len(text) > 20_000 and np.allclose(model.features(text), want) and model.features(b"") == (0.0, 0.0)
    # Rows that no dictionary holds.
    fresh = [(words(rng, 60) if k % 2 else "".join(rng.choices("#|{}0", k=300)), k % 2) for k in range(60)]
    score = model.scores(np.array([model.features(t.encode()) for t, _ in fresh]))
    assert np.mean((score >= 0.5) == np.array([y for _, y in fresh])) > 0.95


def test_classifiers_with_repeated_rows_long_texts_and_clashing_columns(spark):
    docs, labels = labelled(spark, 150)
    long = ("calm words " * 20_000, "calm words " * 20_000 + "zqxwor kvylum")
    more = docs.unionByName(frame(spark, [(500, long[0]), (501, long[1]), (501, long[1])]))
    odd = more.withColumns({"score": F.lit("x"), "label": F.lit(1), "held_out": F.lit(None).cast("string"), "toxic": F.lit(9), "quality": F.lit(9)})
    plain = sorted(map(tuple, toxicity.score_toxicity(more, labels).collect()), key=str)
    assert sorted(map(tuple, toxicity.score_toxicity(odd, labels).collect()), key=str) == plain
    assert [r[3] for r in plain if r[0] == 500] == [0] and [r[3] for r in plain if r[0] == 501] == [1, 1]
    plain = sorted(map(tuple, quality.score_quality(more, labels).collect()), key=str)
    assert sorted(map(tuple, quality.score_quality(odd, labels).collect()), key=str) == plain and len([r for r in plain if r[0] == 501]) == 2


def test_quality_learns(spark):
    docs, labels = labelled(spark)
    got = [r for r in quality.score_quality(docs, labels).collect() if r["held_out"] and r["doc_id"] < 300]
    assert sum(r["predicted"] == (r["doc_id"] % 4 != 0) for r in got) >= 0.95 * len(got)


def test_brown_counts_and_base(spark):
    rows = [(i, t) for i, t in corpus() if i is not None and i != 9]
    got = {r["doc_id"]: r for r in brown.score_texts(frame(spark, rows)).collect()}
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in rows}
    train = [w for i, ws in split.items() if zlib.crc32(str(i).encode()) % 10 for w in [*ws, None]]
    counts = {w: train.count(w) for w in set(train)}
    floor = len(train) + 0.1 * (len(counts) + 1)
    for i, ws in split.items():
        base = sum(math.log10((counts.get(w, 0) + 0.1) / floor) for w in [*ws, None])
        r = got[i]
        assert (r["n_tokens"], r["train_tokens"], r["n_known"]) == (len(ws) + 1, len(train), sum(w in counts for w in [*ws, None]))
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0


def test_brown_exchange_size_is_a_parameter(spark, monkeypatch):
    rows = [(k, " ".join(f"w{(k * j) % 50}" for j in range(1, 60))) for k in range(1, 30)]
    given = {r["doc_id"]: r for r in brown.score_texts(frame(spark, rows), exchanged=32).collect()}
    plain = {r["doc_id"]: r for r in brown.score_texts(frame(spark, rows)).collect()}
    monkeypatch.setattr(brown, "FREQUENT", 32)
    same = {r["doc_id"]: r for r in brown.score_texts(frame(spark, rows)).collect()}
    assert all(abs(given[k]["score"] - same[k]["score"]) < 1e-9 for k in given)
    assert any(abs(given[k]["score"] - plain[k]["score"]) > 1e-6 for k in given)
    assert all(abs(given[k]["base_score"] - plain[k]["base_score"]) < 1e-9 for k in given)
    for wrong in (16, 100):
        with pytest.raises(ValueError, match="power of two"):
            brown.score_texts(frame(spark, rows), exchanged=wrong)


def test_brown_score_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(brown, "FREQUENT", 32)
    rng = random.Random(31)
    kinds = [[f"{k}{i}" for i in range(12)] for k in "abc"]
    rows = [(i, " ".join([*(rng.choice(kinds[k % 3]) for k in range(rng.randint(0, 25))), *([f"once{i}"] if i % 3 else [])])) for i in range(60)] + [(100, None), (101, "never seen a0")]
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 10]
    model, _, classes = brown.learn(frame(spark, train))
    other, end = int(model.state[-1]), int(model.state[-1]) + 1
    of = dict(zip(model.table.to_pylist(), model.state.tolist(), strict=False)) | {r["word"]: r["class"] for r in classes.collect()}
    counts, pairs, single = {}, np.zeros((end + 1, end + 1)), np.zeros(end + 1)
    for _, t in train:
        before = end
        for w in [*(t or "").split(), None]:
            c = end if w is None else of.get(w, other)
            pairs[before, c] += 1
            single[c] += w is not None
            before = c
            if w is not None:
                counts[w] = counts.get(w, 0) + 1
    share = (pairs.sum(axis=0) + 0.5) / (pairs.sum(axis=0) + 0.5).sum()
    step = np.log10((pairs + 5 * share) / (pairs.sum(axis=1, keepdims=True) + 5))
    once, twice = sum(n == 1 for n in counts.values()), sum(n == 2 for n in counts.values())
    discount = min(max(once / (once + 2 * twice), 0.05), 0.95)
    rare = sum(of.get(w, other) == other for w in counts)
    got = {r["doc_id"]: r["score"] for r in brown.score_texts(frame(spark, rows)).collect()}
    for i, t in rows:
        before, want = end, 0.0
        for w in (t or "").split():
            c = of.get(w, other)
            n = counts.get(w, 0)
            mass = (n - discount if n else discount * rare) if c == other else n
            want += step[before, c] + math.log10(mass / single[c])
            before = c
        assert math.isclose(got[i], want + step[before, end], rel_tol=1e-9), i


def test_exchange_finds_alternating_classes():
    pairs = np.zeros((8, 8))
    for a in range(3):
        for b in range(3, 6):
            pairs[a, b] = pairs[b, a] = 50
    of = brown.exchange_clusters(pairs, classes=2)
    assert len(set(of[:3].tolist())) == 1 and len(set(of[3:6].tolist())) == 1 and of[0] != of[3]


def test_bitmaps_never_differ_in_more_cells_than_sets_do():
    rng = np.random.default_rng(5)
    for n in (1, 5, 40, 300, 5000):
        base = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for changed in (0, 1, n // 10, n // 2, n):
            other = np.unique(np.concatenate([base[changed:], rng.integers(0, 1 << 63, changed).astype(np.uint64)]))
            mine = np.unique(base)
            differ = jaccard.differing(jaccard.parity(mine, 1024), jaccard.parity(other, 4096))
            assert differ <= len(np.setxor1d(mine, other))
            assert changed or differ == 0


def test_brown_gives_words_behind_the_frequent_ones_classes(spark, monkeypatch):
    rng = random.Random(4)
    kinds = [[f"{k}{i}{'x' * (50 if i == 7 else 0)}" for i in range(60)] for k in "abc"]
    rows = [(i, " ".join(rng.choice(kinds[k % 3]) for k in range(30))) for i in range(120)]
    monkeypatch.setattr(brown, "FREQUENT", 32)
    monkeypatch.setattr(brown, "CLASSES", 3)

    def scores():
        return {r["doc_id"]: r["score"] for r in brown.score_texts(frame(spark, rows)).collect()}

    whole = scores()
    model, _, classes = brown.learn(frame(spark, rows))
    of = {r["word"]: r["class"] for r in classes.collect()} | dict(zip(model.table.to_pylist(), model.state.tolist(), strict=False))
    # Words of a kind stand in the same places, so no class has words of two kinds; all but the end and rarer words have one.
    sets = [{of[w] for w in kind} for kind in kinds]
    assert len(of) == 180 and sum(map(len, sets)) == len(set.union(*sets)) and int(model.state[-1]) not in set.union(*sets)
    # Without the table all classes come from joins, with the same scores.
    monkeypatch.setattr(brown, "TABLE_WORDS", 40)
    joined = scores()
    assert all(math.isclose(whole[i], joined[i], rel_tol=1e-9) for i in whole)


def test_brown_writes_one_row_for_each_text(spark, monkeypatch):
    written = {}
    stored = brown.stored

    def counted(df, name):
        out = stored(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(brown, "stored", counted)
    monkeypatch.setattr(brown, "FREQUENT", 32)
    monkeypatch.setattr(brown, "TABLE_WORDS", 40)
    rows = [(i, " ".join(f"w{(i * j) % 90}" for j in range(1, 40))) for i in range(1, 40)]
    brown.score_texts(frame(spark, rows))
    # Words outside the table meet their classes before texts are written, so no pair of words is.
    assert set(written) == {"word-counts", "word-classes", "coded-texts"} and written["coded-texts"] == len(rows)


def test_brown_assigns_words_whose_rows_lie_in_several_batches(spark):
    rng = random.Random(8)
    joint = np.array([[rng.randint(0, 90) for _ in range(6)] for _ in range(6)], float)
    rows, want = [], {}
    for k in range(12):
        counts = np.zeros(12)
        near = [[(s := rng.randrange(12), n := rng.randint(1, 9), counts.__setitem__(s, counts[s] + n))[:2] for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 9))]
        known = k % 4 != 3
        rows += ([(f"w{k:02}", [], 5 + k)] if known else []) + [(f"w{k:02}", [s << 40 | n for s, n in some], None) for some in near]
        smooth = joint + 5 * np.outer(joint.sum(axis=1) + 1, joint.sum(axis=0) + 1) / (joint.sum() + 1) ** 2
        fit = np.concatenate([np.log(smooth / smooth.sum(axis=1, keepdims=True) / smooth.sum(axis=0, keepdims=True))[:, :4], np.log(smooth / smooth.sum(axis=1, keepdims=True))[:4].T])
        if known:
            want[f"w{k:02}"] = (5 + k, int(np.argmax(np.round(counts @ fit, 6))))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        frame_ = spark.createDataFrame(rows, "word string, near array<bigint>, c long").coalesce(1)
        got = {r["word"]: (r["c"], r["class"]) for r in brown._assign(frame_, joint, 4).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want
