import math

from pyspark.sql import functions as F

from lexigrove import functions as fn


def one(spark, ddl, row, *cols):
    return spark.createDataFrame([row], ddl).select(*cols).first()


def test_trim_removes_unicode_space(spark):
    r = one(spark, "a string, b string", ("  word\t ", "   "),
            fn.unicode_trim("a").alias("a"), fn.unicode_trim("b").alias("b"))
    assert tuple(r) == ("word", "")


def test_normalize_and_zero_vector(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = [r[0] for r in df.select(fn.l2_normalize("v")).collect()]
    assert [round(x, 6) for x in got[0]] == [0.6, 0.8] and got[1] == [0.0, 0.0]


def test_distances(spark):
    r = one(spark, "a array<double>, b array<double>", ([1.0, 0.0], [0.0, 2.0]),
            fn.sq_l2("a", "b"), fn.l2("a", "b"), fn.cosine_distance("a", "b"),
            fn.dot("a", "b"), fn.cosine_distance("a", F.array(F.lit(0.0), F.lit(0.0))))
    assert r[0] == 5.0 and math.isclose(r[1], math.sqrt(5)) and tuple(r[2:]) == (1.0, 0.0, 1.0)


def test_jaccard_third_empty_null(spark):
    df = spark.createDataFrame(
        [(["a", "b"], ["b", "c"]), ([], ["b"]), (None, ["b"])], "a array<string>, b array<string>"
    )
    got = [r[0] for r in df.select(fn.jaccard("a", "b")).collect()]
    assert math.isclose(got[0], 1 / 3) and got[1:] == [0.0, 0.0]


def test_char_ngrams(spark):
    r = one(spark, "w string, e string", ("ab", ""),
            fn.char_ngrams("w").alias("w"), fn.char_ngrams("e", 3, 4).alias("e"))
    assert r["w"] == ["<ab", "ab>", "<ab>"] and r["e"] == ["<>"]
    r = one(spark, "w string", ("where",), fn.char_ngrams("w", 3, 3).alias("w"))
    assert r["w"] == ["<wh", "whe", "her", "ere", "re>", "<where>"]


def test_truncate(spark):
    r = one(spark, "t array<int>", (list(range(20)),), fn.truncate_tokens("t").alias("t"))
    assert r["t"] == list(range(16))
