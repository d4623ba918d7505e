import re

from pyspark.sql import functions as F

from rankweave.functions import text as X
from rankweave.functions.understand import understand


def one(spark, query):
    return understand(spark.createDataFrame([("q", query)], "query_id string, query string")).first()


def column(spark, value, use):
    return spark.createDataFrame([(value,)], "v string").select(use(F.col("v")).alias("r")).first()["r"]


def test_tokens_come_with_their_parts(spark):
    assert column(spark, "the parseJson a_b.c x", X.tokenize) == ["the", "the", "parsejson", "parse", "json", "a_b.c", "a", "b", "c", "x", "x"]
    assert column(spark, "", X.tokenize) == [] and column(spark, "café", X.tokenize) == ["caf", "caf"]


def test_identifiers_keep_order_and_spelling(spark):
    assert column(spark, "Show user_id and fooBar of JWT and user_id", X.extract_identifiers) == ["Show", "user_id", "fooBar", "JWT"]


def test_versions_compare_as_numbers(spark):
    rows = spark.createDataFrame([("v2",), ("v10",), ("v2.1",), ("V2.0 ",), ("latest",)], "v string")
    keys = {r[0]: r[1] for r in rows.select("v", X.version_key(F.col("v"))).collect()}
    assert keys["v10"] > keys["v2.1"] > keys["V2.0 "] > keys["v2"] and keys["latest"] is None


def test_version_intent(spark):
    for query, kind, version in (("latest version of parse", "latest", None), ("the current one", "latest", None), ("version 2 of parse", "specific", "v2"), ("parse v3.1 now", "specific", "v3.1"), ("parse", "none", None)):
        got = one(spark, query)
        assert (got["version_intent"], got["version"]) == (kind, version)


def test_phrases_are_bounded(spark):
    assert column(spark, "Jwt  expiration validation", X.technical_phrases) == ["jwt expiration validation", "jwt expiration"]
    assert column(spark, "xjwt expirations", X.technical_phrases) == []


def test_intents(spark):
    assert one(spark, "jwt expiration validation of a bearer token")["primary_intent"] == "authentication"
    assert one(spark, "parameterized database query insert sql")["primary_intent"] == "database"
    vague = one(spark, "normalization")
    assert vague["primary_intent"] == "general_code_search" and vague["confidence"] <= 0.49
    assert one(spark, "")["keywords"] == []


def test_expansions_need_context(spark):
    assert one(spark, "normalize")["alias_expansions"] == []
    assert one(spark, "normalize input fields")["alias_expansions"] == ["normalize", "normalized", "preprocess", "preprocessing"]
    assert one(spark, "connection pool")["alias_expansions"] == ["connection", "database", "db"]
    assert one(spark, "retry the request")["alias_expansions"] == ["api", "payload", "request", "response", "retry"]
    assert one(spark, "token refresh")["alias_expansions"] == ["auth", "authenticate", "authentication", "jwt", "token"]


def test_lexical_query_drops_stopwords_once(spark):
    assert one(spark, "where is the parser of the parser")["lexical_query"] == "parser"


def test_squeeze_knows_unicode_space(spark):
    assert column(spark, "  A\u00a0\u2003b\tC ", X.squeeze) == re.sub(r"\s+", " ", "  A\u00a0\u2003b\tC ".strip().lower())
