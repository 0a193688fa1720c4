from pyspark.sql import functions as F

from corpusloom.functions import python_udfs as P
from corpusloom.functions import text as T


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "t string").select(col(F.col("t")).alias("x")).first().x


def test_clean_is_idempotent(spark):
    raw = "“Led”\r\n\r\n\r\n\r\n  a\tteam — of  5 "
    once = one(spark, raw, T.clean)
    assert once == '"Led"\n\n a team - of 5' and one(spark, once, T.clean) == once
    assert one(spark, None, T.clean) == ""


def test_tokens_keep_trailing_dots_and_skip_numbers(spark):
    assert one(spark, "Node.JS and SQL. 42 c++ 3d", T.tokens) == ["node.js", "and", "sql.", "c++", "d"]
    assert one(spark, "The C of Go", T.content_tokens) == ["go"]
    assert one(spark, None, T.tokens) == []


def test_keys_and_normal_form(spark):
    assert one(spark, "Node.JS / React-Native!", T.normalise) == "node.js react native"
    assert one(spark, "Machine, Learning. ...", T.phrase_key) == "machine learning"


def test_bullets_and_first_word(spark):
    assert one(spark, "* Led it\n- Built. x\nplain", T.bullets) == ["Led it", "Built. x"]
    assert one(spark, "short\n" + "x" * 40, T.bullets) == ["x" * 40]
    assert one(spark, "1. Built. it", T.first_word) == "built" and one(spark, "9 lives", T.first_word) == ""


def test_chunks_fall_back_to_the_text(spark):
    assert one(spark, "tiny", T.chunks) == ["tiny"] and one(spark, "  ", T.chunks) == []
    assert one(spark, "This sentence is long enough. So is this other one here!", T.chunks) == ["This sentence is long enough.", "So is this other one here!"]


def test_rounding_and_bands(spark):
    got = spark.range(1).select(T.pct(F.lit(0.125)).alias("a"), T.pct(F.lit(2.0)).alias("b"), T.band(F.lit(70)).alias("c"), T.verdict(F.lit(54)).alias("d"), T.plural(F.lit(1), "skill").alias("e"), T.plural(F.lit(2), "skill").alias("f")).first()
    assert tuple(got) == (12, 100, "good", "stretch", "1 skill", "2 skills")


def test_python_udfs(spark):
    df = spark.createDataFrame([("ﬁn", bytearray(b"caf\xe9"), "kubernets", "kubernetes"), (None, None, None, "x")], "t string, b binary, x string, y string")
    a, b = df.select(P.nfkc("t").alias("n"), P.decode_text("b").alias("d"), P.indel_ratio("x", "y").alias("r")).collect()
    assert (a.n, a.d) == ("fin", "café") and abs(a.r - 100 * 18 / 19) < 1e-9 and (b.n, b.d, b.r) == (None, None, None)
    v = spark.createDataFrame([(["a", "a", "b"],), ([],)], "t array<string>").select(P.hash_embedding("t").alias("v")).collect()
    assert abs(sum(x * x for x in v[0].v) - 1) < 1e-9 and not any(v[1].v)
