"""Periodic runs, centroid clusters and token counts against brute force and the tokenizers library."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from notelake.llm import clusters, counting, queries, runs
from notelake.llm.tokens import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns whose names are also those of results.
SCHEMA = "doc_id long, text string, runs int, collapsed int, n_tokens long, n_words string"


def documents(spark, folder, rows):
    spark.createDataFrame([(i, t, 1, 2, 3, "x") for i, t in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/documents.parquet")


def texts():
    rng = random.Random(5)
    pick = lambda n, a: " ".join(rng.choice("abcdefghij"[:a]) for _ in range(n))
    rows = [(k, pick(rng.randint(0, 60), rng.randint(1, 6))) for k in range(120)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (None, "x y " * 9), (203, "a b c d " * 3000), (204, pick(4000, 10)), (205, "q"), (206, "a  a\na\ta a a b"), (206, "a  a\na\ta a a b"), (-7, "é漢 " * 12 + "end"), (207, "z " * 5000)]
    return rows


def brute_runs(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(all(words[x] == words[x + d] for x in range(i, i + length - d)) for d in range(1, q)):
                found.append((i, length, q))
            i = j
    return sorted(found)


def brute_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    own = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *own, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_op11_matches_brute_force(spark, tmp_path):
    documents(spark, tmp_path, texts())
    got = queries.op11_periodic_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    want = [brute_row(i, t) for i, t in texts()]
    assert ordered(map(tuple, got)) == ordered(want)
    assert sum(r[1] for r in want) > 30 and any(i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts())


def test_runs_keep_the_smallest_period_and_lags_looked_at_first_lose_none(monkeypatch):
    rng = random.Random(2)
    cases = []
    for _ in range(600):
        n, a = rng.randint(0, 70), rng.randint(1, 4)
        ids = [rng.randrange(a) for _ in range(n)]
        if n and rng.random() < 0.7:
            s, p = rng.randrange(n), 1 + rng.randrange(7)
            ids = [ids[i] if i < s or s + (i - s) % p >= n else ids[s + (i - s) % p] for i in range(n)]
        cases.append(np.array(ids, np.int64))
    want = [brute_runs(c.tolist()) for c in cases]
    assert [runs.runs_of(c) for c in cases] == want
    monkeypatch.setattr(runs, "LOOK_FIRST", 0)
    assert [runs.runs_of(c) for c in cases] == want


def test_runs_of_a_long_text_with_a_hidden_run():
    ids = np.random.default_rng(3).integers(0, 5000, 90_000)
    ids[40_000:48_000] = np.tile(ids[40_000:41_500], 6)[:8000]
    assert any(q == 1500 and s <= 40_000 and s + n >= 48_000 for s, n, q in runs.runs_of(ids))


def test_runs_and_counts_of_empty_tables(spark, tmp_path):
    documents(spark, tmp_path, [])
    assert queries.op11_periodic_runs(spark, str(tmp_path)).count() == 0
    assert queries.op13_token_counts(spark, str(tmp_path)).count() == 0


def test_op13_matches_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    parts = ["a", "b", "the", " ", "  ", "\n", "\t", ".", ",", "'s", "'ll", "é", "ß", "漢", "🙂", "<|endoftext|>", "<|", "1", "23", " ", " ", "-", "_", "aaaa", "(", "http://", "\x00", "\x1c", "\x85"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for k in range(400)]
    rows += [(900, None), (901, ""), (None, "no id"), (902, "a" * 5000), (903, "ab" * 3000), (904, "".join(rng.choice("abcdefgh") for _ in range(20_000))), (905, " " * 3000), (906, "same words " * 4000), (906, "same words " * 4000), (907, "<|endoftext|>" * 9)]
    documents(spark, tmp_path, rows)
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows]
    got = queries.op13_token_counts(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    assert ordered(map(tuple, got)) == ordered(want)


def test_counts_follow_ranks_on_every_length():
    """Each sequence by itself, one lowest-ranked leftmost pair after another."""
    pairs = counting.BytePairs(vocabulary("byte_bpe_50k.json"))

    def slow(data):
        ids = pairs.byte_ids[np.frombuffer(data, np.uint8)].tolist()
        while len(ids) > 1:
            ranks = pairs.rank(np.array(ids[:-1]), np.array(ids[1:]))
            k = int(np.argmin(ranks))
            if ranks[k] == counting._NONE:
                break
            ids[k : k + 2] = [int(pairs.made[ranks[k]])]
        return len(ids)

    rng = random.Random(7)
    own = ["".join(rng.choice("aabcehinort ") for _ in range(rng.randint(0, 400))).encode() for _ in range(120)] + [b"a" * n for n in (1, 2, 3, 127, 128, 129, 300)]
    offsets = np.cumsum([0, *map(len, own)])
    assert pairs.count(np.frombuffer(b"".join(own), np.uint8), offsets).tolist() == list(map(slow, own))


def test_counter_forgets_nothing_when_its_cache_is_full():
    path = vocabulary("byte_bpe_50k.json")
    column = pa.array(["one two three", None, "two  three.", "four   five", ""])
    small, large = counting.Counter(path, pieces=2), counting.Counter(path)
    assert small.column(column).tolist() == large.column(column).tolist() == large.texts(["one two three", "", "two  three.", "four   five", ""]).tolist()


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        counting.BytePairs(vocabulary("word_bpe_49k.json"))


VECTORS = "vec_id long, embedding array<float>, label int, cluster string, distance string, vec string"


def vectors(rng, n):
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    rows = [(k, [c + rng.gauss(0, 0.4) for c in rng.choice(centres)]) for k in range(n)]
    rows += [(1000 + k, rows[3][1]) for k in range(60)]  # a hot vector
    rows += [(5, rows[5][1]), (2000, None), (2001, [0.5] * 63), (2002, [0.5] * 63 + [None]), (2003, [0.5] * 63 + [math.nan]), (2004, [math.inf] * 64), (2005, [0.0] * 64), (2006, []), (2007, [1e30] * 64)]
    return [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def brute_clusters(rows):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v) and max(map(abs, v)) < 1e6]
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))][:40]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(5):
        own = [nearest(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, own, strict=True) if c == k]
            if mine:
                centroids[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [nearest(v) for _, v in kept]
    total = {k: sum(d for d, c in last if c == k) for _, k in last}
    return [(i, k, d, total[k], sum(total.values()), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, last, strict=True)]


@pytest.mark.parametrize("n", [0, 7, 400])
def test_op12_matches_brute_force(spark, tmp_path, n):
    rows = vectors(random.Random(8), n) if n > 7 else vectors(random.Random(8), 8)[:n]
    spark.createDataFrame([(i, v, 0, "a", "b", "c") for i, v in rows], VECTORS).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op12_centroid_clusters(spark, str(tmp_path)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert ordered(map(tuple, got)) == ordered(brute_clusters(rows))


def test_exponion_keeps_ties_and_skips_most():
    """Integers on a small grid, so that many distances tie; then well-parted vectors."""
    rng = np.random.default_rng(4)
    for spread, k in ((3, 30), (2, 12), (40, 25)):
        v = rng.integers(0, spread, (500, 3))
        centroids = rng.integers(0, spread, (k, 3))
        cluster, upper, lower = clusters.Exponion(centroids).first(v)
        for _ in range(6):
            after = np.array([v[cluster == c].sum(axis=0) // max(1, (cluster == c).sum()) if (cluster == c).any() else centroids[c] for c in range(k)])
            drift = np.sqrt(((after - centroids) ** 2).sum(axis=1).astype(float))
            upper, lower = clusters.moved_bounds(cluster, upper, lower, drift)
            centroids = after
            search = clusters.Exponion(centroids)
            cluster, upper, lower = search.step(v, cluster, upper, lower)
            assert (cluster == np.argmin(clusters.squared(v, centroids), axis=1)).all()
    v = np.repeat(np.arange(20), 50)[:, None] * 1000 + rng.integers(0, 9, (1000, 4))
    centroids = np.arange(20)[:, None] * 1000 + np.zeros((1, 4), int)
    search = clusters.Exponion(centroids)
    search.step(v, *search.first(v))
    assert search.scanned == 20 * 1000  # the first scan alone


def test_large_integers_stay_exact():
    v = np.array([[2**27, -(2**27)], [2**27 - 1, 5]])
    assert clusters.squared(v, v).tolist() == [[0, 1 + (2**27 + 5) ** 2], [1 + (2**27 + 5) ** 2, 0]]
