"""One query for each operator, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm import ann, brown, chat, clusters, counting, decontaminate, jaccard, packing, quality, runs, substrings, toxicity, wavelet
from notelake.llm.common import shared_dir
from notelake.llm.tokens import vocabulary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_spans(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_wavelet_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/wavelet-{uuid.uuid4().hex}"
    return wavelet.read_documents(wavelet.write_shards(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), folds=True))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_classes(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id AS long) AS conv_id", "cast(turn AS long) AS turn", "role", "text")
    added = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    return chat.digests(chat.format_conversations(rows.unionByName(added)))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_texts(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.periodic_runs(runs.repeated_tails(table(spark, sf_dir, "documents"))))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return clusters.with_inertia(clusters.cluster_vectors(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dim=64, scale=256, order=order))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = counting.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_packing, op3_wavelet_output, op4_ngram_jaccard_join, op5_decontamination, op6_nearest_neighbours, op7_toxicity, op8_quality, op9_chat_formatting, op10_lm_scoring, op11_periodic_runs, op12_centroid_clusters, op13_token_counts)}

_ESC = "replace(replace(replace({0}, '\\', '\\e'), '<', '\\l'), '[', '\\b')"



def _clusters_sql(k: int = 40, rounds: int = 5) -> str:
    """The centroids of every round, one CTE after another."""
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v AS m FROM kept ORDER BY sha256('2:' || vec_id), v LIMIT {k})",
    ]
    nearest = "SELECT r, min({'d': list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::BIGINT, 'c': c}) AS b FROM kept CROSS JOIN"
    for t in range(1, rounds + 1):
        steps.append(f"a{t} AS MATERIALIZED ({nearest} c{t - 1} GROUP BY r)")
        steps.append(f"s{t} AS (SELECT c, p, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT b.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM kept JOIN a{t} USING (r)) GROUP BY c, p)")
        steps.append(f"c{t} AS MATERIALIZED (SELECT c, coalesce(w, m) AS m FROM c{t - 1} LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS w FROM s{t} GROUP BY c) USING (c))")
    last = f"f AS MATERIALIZED ({nearest} c{rounds} GROUP BY r)"
    return f"""WITH {", ".join([*steps, last])}
SELECT vec_id, b.c::INT AS cluster, b.d AS distance, sum(b.d) OVER (PARTITION BY b.c)::BIGINT AS cluster_inertia, sum(b.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM kept JOIN f USING (r) JOIN c{rounds} ON c = b.c"""


ORACLE_SQL = {
    "op12_centroid_clusters": _clusters_sql(),
    "op9_chat_formatting": rf"""
WITH source AS (
    SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
    SELECT *, (contains(t, '<s>') OR contains(t, '</s>') OR contains(t, '[INST]') OR contains(t, '[/INST]') OR contains(t, '<<SYS>>') OR contains(t, '<</SYS>>')) AS flag
    FROM source
), sized AS (
    SELECT *, 7 + CASE WHEN flag THEN 1 + length({_ESC.format("t")}) ELSE length(t) END
        + CASE r WHEN 'user' THEN 7 WHEN 'assistant' THEN 8 WHEN 'system' THEN 8 ELSE 9 + length(replace({_ESC.format("r")}, chr(10), '\w')) END AS size
    FROM marked
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
    coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
    sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
""",
}
