import pytest
from pyspark.sql import functions as F

from corvina.functions import codec, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f("x").alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("is_valid_email", ["is", "valid", "email", "is_valid_email"]), ("binary_search", ["binary", "search", "binary_search"]), ("single", ["single"]), ("isPalindrome", ["is", "palindrome", "ispalindrome"]),
        ("getHTTPResponse", ["get", "http", "response", "gethttpresponse"]), ("OAuth2Token", ["oauth", "2", "token", "oauth2token"]), ("", []), ("___", ["___"]), ("foo_foo", ["foo", "foo_foo"]),
    ],
)
def test_split_identifier(spark, name, want):
    assert one(spark, name, text.split_identifier) == want


def test_tokens(spark):
    assert one(spark, "sha256(où) Sha256", text.tokenize_code) == ["sha256", "o", "sha", "256", "sha256"]
    assert one(spark, None, text.tokenize_code) == []
    assert one(spark, "a_b c", lambda c: text.tokenize_code(c, False)) == ["a_b", "c"]


def test_hashes(spark):
    a, b, c = "x = 1\n", "x = 1  # note\n", "y = 2"
    rows = spark.createDataFrame([(a,), (b,), (c,)], "x string").select(text.chunk_hash("x").alias("h"), text.content_hash("x").alias("s")).collect()
    assert rows[0]["h"] == rows[1]["h"] != rows[2]["h"] and len(rows[0]["s"]) == 64
    assert one(spark, "a  \r\nb\r", text.normalize_content) == "a\nb"
    with pytest.raises(ValueError):
        text.content_hash("x", "crc")


def test_queries(spark):
    assert one(spark, " Parse the JSON file quickly now please ", text.snake_name) == "parse_the_json_file_quickly"
    assert one(spark, "", text.hyde_queries) == []
    assert len(one(spark, "sort a list", text.hyde_queries)) == 3
    assert one(spark, "how to parse json", text.expand_query) == "how to parse json json.loads json.dumps"
    assert one(spark, "get_user", text.query_intent)["intent"] == "symbol_lookup"
    assert one(spark, "TypeError in loop", text.query_intent)["error"] == "typeerror"
    assert one(spark, None, text.query_intent)["confidence"] == 0.5
    w = one(spark, "get_user()", text.adaptive_weights)
    assert (w["dense"], w["sparse"]) == (0.4, 0.6)
    c = one(spark, "if a:\n    # no\n    for x in y:\n        pass\n", text.complexity)
    assert (c["cyclomatic"], c["depth"], c["lines"]) == (3, 2, 3)


def test_codec(spark):
    ids = [2, 5, 12, 105, 1000, 1 << 40]
    assert codec.decode_numbers(codec.encode_numbers(ids)).tolist() == ids
    assert codec.encode_numbers([]) == b"" and len(codec.decode_numbers(b"")) == 0
    with pytest.raises(ValueError):
        codec.encode_numbers([-1])
    df = spark.createDataFrame([(ids[:5],), ([],), (None,)], "v array<bigint>")
    df = df.withColumn("g", codec.gaps(F.col("v"))).withColumn("b", codec.vbyte_encode("g")).withColumn("r", codec.vbyte_decode("b"))
    rows = df.select("g", "v", codec.from_gaps(F.col("r")).alias("w")).collect()
    assert rows[0]["g"] == [2, 3, 7, 93, 895] and rows[0]["w"] == ids[:5] and rows[1]["w"] == [] and rows[2]["w"] is None
    import random

    rng = random.Random(2)
    p = [(t, k) for t in ("hot", "cold") for k in rng.sample(range(20_000), 3000 if t == "hot" else 3)]
    blocks = codec.postings_blocks(spark.createDataFrame(p, "term string, k bigint"), "term", "k")
    assert blocks.agg(F.max("n")).first()[0] <= codec.BLOCK and blocks.count() > 5
    assert sorted(map(tuple, codec.postings_of(blocks, "term", "k").collect())) == sorted(p)
