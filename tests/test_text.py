from pyspark.sql import functions as F

from notelake.functions import text as X
from notelake.functions.fingerprints import fingerprint_similarity, simhash


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_query_tokens_drop_fields_and_operators(spark):
    assert one(spark, "title:deploy AND token body:rotation", X.query_tokens) == ["deploy", "token", "rotation"]


def test_distinct_tokens_cut_a_query_into_words_once(spark):
    words = lambda c: X.distinct_tokens(X.query_tokens(c))
    assert one(spark, "b A a B c A title:C Ä ä", words) == ["b", "A", "c", "Ä"]
    assert one(spark, "", words) == [] and one(spark, None, words) is None
    plan = spark.sql("SELECT 'x' AS x FROM range(2)").select(words(F.col("x")).alias("y"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") == 1


def test_stems_are_safe(spark):
    rows = spark.createDataFrame([(w,) for w in ("ci", "JWT", "403", "db", "rotating", "tokens")], "t string")
    assert [r["s"] for r in rows.select(X.stem(F.col("t")).alias("s")).collect()] == [None, None, None, None, "rotat", "token"]


def test_fold_and_terms(spark):
    assert one(spark, "Ação_ñandú É", X.index_terms) == ["acao", "nandu", "e"]


def test_slug_and_redaction(spark):
    assert one(spark, " Deploy: 403! ", X.slug) == "deploy-403"
    assert one(spark, "??", X.slug) == "untitled"
    assert one(spark, "key AKIA" + "A" * 16 + " end", X.redact) == "key [REDACTED:AWS access key] end"
    assert one(spark, "ghp_" + "a" * 26, X.redact) == "[REDACTED:GitHub token]"


def test_fit_marks_what_it_cuts(spark):
    assert one(spark, "abcdefghijklmnopqrst", lambda c: X.fit(c, F.lit(18))) == "abcde\n[truncated]\n"
    assert one(spark, "abc", lambda c: X.fit(c, F.lit(0))) == ""


def test_near_texts_have_near_fingerprints(spark):
    rows = spark.createDataFrame([(1, "rotate the deploy token after a 403 from the gateway"), (2, "rotate the deploy token after a 403 from a gateway"), (3, "quarterly budget planning for the sales team"), (4, "")], "id int, t string")
    f = {r["id"]: r["fingerprint"] for r in simhash(rows, "id", "t").collect()}
    assert 4 not in f
    pair = spark.createDataFrame([(f[1], f[2], f[3])], "a long, b long, c long")
    near, far = pair.select(fingerprint_similarity(F.col("a"), F.col("b")), fingerprint_similarity(F.col("a"), F.col("c"))).first()
    assert near >= 0.65 > far
