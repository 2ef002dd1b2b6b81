"""Inputs of the queries, derived from the whole of the given tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.functions import char_ngrams, unicode_trim
from lexigrove.operators.ranking import with_rank
from lexigrove.runtime import materialize, uniform_hash

LETTERS = r"(\p{L}+)"
LABELINGS = (("label", 10), ("mod5", 5), ("mod20", 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(1))


def word_counts(spark, sf_dir, *extra: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = docs.select(*extra, F.explode(tokens("text")).alias("word"))
    return words.groupBy("word", *extra).agg(F.count("*").cast("double").alias("frequency"))


def lexicon(spark, sf_dir) -> DataFrame:
    """``word, frequency`` of every word of every document."""
    return word_counts(spark, sf_dir)


def lexicon_dirty(spark, sf_dir) -> DataFrame:
    """Counts per language, with language-specific padding, and nulls for one word."""
    padded = (
        F.when(F.col("lang") == "fr", F.concat(F.lit(" "), "word"))
        .when(F.col("lang") == "de", F.concat("word", F.lit(" ")))
        .when(F.col("lang") == "es", F.concat("word", F.lit("\t")))
        .otherwise(F.col("word"))
    )
    return word_counts(spark, sf_dir, "lang").select(
        F.when(F.col("word") != "la", padded).alias("word"), "frequency"
    )


def vocab(spark, sf_dir) -> DataFrame:
    """``word, idx``: the words of all conversations in alphabetical order."""
    words = table(spark, sf_dir, "conversations").select(
        F.explode(tokens("text")).alias("word")
    )
    return with_rank(words.distinct(), [F.col("word")], "idx")


def points(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("word_id"), F.col("embedding").alias("features"))


def n_vectors(spark, sf_dir) -> int:
    return table(spark, sf_dir, "embeddings").count()


def weights(spark, sf_dir, vocabulary: DataFrame) -> DataFrame:
    """``idx, features``: a scaled embedding for every vocabulary index."""
    n = n_vectors(spark, sf_dir)
    scale = 1 + F.col("idx") % 3
    return (
        vocabulary.select("idx", (F.col("idx") % n).alias("vec_id"))
        .join(table(spark, sf_dir, "embeddings"), "vec_id")
        .select(
            "idx", F.transform("embedding", lambda x: (x * scale).cast("float")).alias("features")
        )
    )


def ngram_table(spark, sf_dir, words: DataFrame) -> DataFrame:
    """``ngram, features``: every n-gram of the lexicon with the vector of its hash bucket."""
    n = n_vectors(spark, sf_dir)
    grams = words.select(F.explode(char_ngrams("word")).alias("ngram")).distinct()
    vectors = (
        grams.withColumn("vec_id", F.pmod(uniform_hash(F.col("ngram"), "bucket"), F.lit(n)))
        .join(table(spark, sf_dir, "embeddings").hint("merge"), "vec_id")
        .select("ngram", F.col("embedding").alias("features"))
    )
    return materialize(vectors, "ngram-table")


def token_states(spark, sf_dir) -> DataFrame:
    """``word_id, pos, mask, hidden``: one token per conversation turn."""
    n = n_vectors(spark, sf_dir)
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("word_id"),
        F.col("turn").alias("pos"),
        (F.col("role") == "user").cast("int").alias("mask"),
        ((F.col("conv_id") * 31 + F.col("turn")) % n).alias("vec_id"),
    )
    return turns.join(table(spark, sf_dir, "embeddings"), "vec_id").select(
        "word_id", "pos", "mask", F.col("embedding").alias("hidden")
    )


def assignments(spark, sf_dir) -> DataFrame:
    """Three labelings of all vectors, long form."""
    e = table(spark, sf_dir, "embeddings")
    each = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("algorithm"),
                    F.lit(k).alias("k"),
                    (F.col("label") if name == "label" else F.col("vec_id") % k)
                    .cast("int")
                    .alias("cluster"),
                )
                for name, k in LABELINGS
            ]
        )
    ).alias("a")
    return e.select(F.col("vec_id").alias("word_id"), each).select("a.*", "word_id")


def word_pairs(spark, sf_dir) -> DataFrame:
    """``w1, w2``: neighbouring words of every document."""
    docs = table(spark, sf_dir, "documents").select(tokens("text").alias("t"))
    rest = F.size("t") - 1
    both = F.arrays_zip(F.slice("t", 1, rest).alias("w1"), F.slice("t", 2, rest).alias("w2"))
    return (
        docs.where(F.size("t") > 1).select(F.explode(both).alias("p")).select("p.w1", "p.w2")
    )


def senses(spark, sf_dir) -> DataFrame:
    """``word, lang, synset_id``: one sense per language a word occurs in."""
    sense = F.concat_ws("@", "word", "lang").alias("synset_id")
    return materialize(word_counts(spark, sf_dir, "lang").select("word", "lang", sense), "synsets")


def synsets(spark, sf_dir) -> DataFrame:
    return senses(spark, sf_dir).drop("lang")


def ontology(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """``word, synset_id`` and ``synset_id, hypernym_id``, from one count of the words."""
    named = senses(spark, sf_dir)
    return named.drop("lang"), hypernyms(named)


def hypernyms(named: DataFrame) -> DataFrame:
    """``synset_id, hypernym_id``: beginnings and endings of words as broader terms.

    word@lang -> first three letters -> first letter -> language, and
    word@lang -> last two letters -> last letter.
    """
    w = named.withColumnRenamed("synset_id", "sid")

    def name(kind: str, part: Column) -> Column:
        return F.concat(F.lit(kind + ":"), part, F.lit("@"), F.col("lang"))

    first3 = name("p3", F.left("word", F.lit(3)))
    first1 = name("p1", F.left("word", F.lit(1)))
    last2 = name("s2", F.right("word", F.lit(2)))
    last1 = name("s1", F.right("word", F.lit(1)))
    lang = F.concat(F.lit("lang:"), F.col("lang"))
    steps = [("sid", first3), (first3, first1), (first1, lang), ("sid", last2), (last2, last1)]
    edges = F.array(
        *[
            F.struct(
                (F.col(a) if isinstance(a, str) else a).alias("synset_id"), b.alias("hypernym_id")
            )
            for a, b in steps
        ]
    )
    return materialize(w.select(F.explode(edges).alias("e")).select("e.*").distinct(), "hypernyms")


def word_clusters(spark, sf_dir) -> DataFrame:
    """``algorithm, cluster, word``: three labelings of the whole lexicon.

    'hashed' spreads words over 2000 clusters, 'shape' groups by the first two letters,
    the last one and the length, and 'single' gives every word its own cluster.
    """
    words = lexicon(spark, sf_dir).select("word")
    shape = F.concat(
        F.left("word", F.lit(2)), F.right("word", F.lit(1)), F.length("word").cast("string")
    )
    tags = F.array(
        F.struct(
            F.lit("hashed").alias("algorithm"),
            F.pmod(uniform_hash(F.col("word"), "cluster"), F.lit(2000)).alias("cluster"),
        ),
        F.struct(F.lit("shape").alias("algorithm"), uniform_hash(shape, "shape").alias("cluster")),
        F.struct(
            F.lit("single").alias("algorithm"),
            uniform_hash(F.col("word"), "single").alias("cluster"),
        ),
    )
    tagged = words.select(F.explode(tags).alias("t"), "word").select("t.*", "word")
    return materialize(tagged, "word-clusters")


def metrics(spark, sf_dir) -> DataFrame:
    """A metric table per model from the averages of all line items."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(
        F.col("l_linestatus").alias("model"),
        (50 * (1 + F.col("l_linenumber") % 6)).cast("int").alias("k"),
        F.col("l_returnflag").alias("Algorithm"),
    ).agg(
        F.avg("l_extendedprice").alias("WCSS"),
        F.avg("l_discount").alias("Silhouette"),
        F.avg("l_tax").alias("Davies_Bouldin"),
        F.avg("l_quantity").alias("Calinski_Harabasz"),
    )


def vocab_lines(spark, sf_dir) -> DataFrame:
    """``line``: the padded words of the dirty lexicon, to be written in sorted order."""
    return lexicon_dirty(spark, sf_dir).where(F.col("word").isNotNull()).select(
        F.col("word").alias("line"), unicode_trim("word").alias("trimmed")
    )
