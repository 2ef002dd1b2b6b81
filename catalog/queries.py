"""One callable per registered query: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.functions import (
    cosine_distance,
    dot,
    jaccard,
    l2,
    l2_normalize,
    sq_l2,
    truncate_tokens,
)
from lexigrove.operators import (
    agglomerative as agg,
    gmm,
    kmeans as km,
    knn,
    lexicon as lex,
    metrics as met,
    minibatch as mb,
    ontology as ont,
    spectral as spc,
    vectors as vec,
)
from lexigrove.plans import report, suite
from lexigrove.runtime import materialize, scratch_path
from lexigrove.sources import (
    read_assignments,
    read_coherence,
    read_embeddings,
    read_first_match,
    read_lexicon,
    read_metrics,
    read_vocab,
    write_assignments,
    write_coherence,
    write_embeddings,
    write_metrics,
)
from lexigrove.streaming import load_centers, stream_minibatch

from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TOP_BEFORE = 10_000  # words of the 10k pipelines
TOP_AFTER = 20_000  # words of the whole-word pipeline
TOP_CUT = 5_000  # fewer than the vocabulary matches of the smallest tables
LABELING = ["algorithm", "k"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def micro(c: str) -> Column:
    """A vector as text: its values in millionths."""
    return F.array_join(
        F.transform(c, lambda x: F.round(x.cast("double") * 1e6).cast("bigint").cast("string")), ","
    )


# --- lexicon ---------------------------------------------------------------


@query
def lexicon_top_before(spark, sf_dir):
    return lex.select_words(fx.lexicon_dirty(spark, sf_dir), TOP_BEFORE, when="before")


@query
def lexicon_top_after(spark, sf_dir):
    return lex.select_words(
        fx.lexicon_dirty(spark, sf_dir), TOP_AFTER, when="after", vocab=fx.vocab(spark, sf_dir)
    )


@query
def lexicon_top_after_cut(spark, sf_dir):
    """The cut after the vocabulary match where it does cut."""
    return lex.select_words(
        fx.lexicon_dirty(spark, sf_dir), TOP_CUT, when="after", vocab=fx.vocab(spark, sf_dir)
    )


@query
def lexicon_all(spark, sf_dir):
    return lex.select_words(fx.lexicon_dirty(spark, sf_dir))


@query
def vocab_semi_join(spark, sf_dir):
    return lex.filter_by_vocab(fx.lexicon(spark, sf_dir), fx.vocab(spark, sf_dir))


@query
def coverage_report(spark, sf_dir):
    out = lex.coverage_report(fx.lexicon(spark, sf_dir), fx.vocab(spark, sf_dir))
    return out.withColumn("coverage", r6("coverage"))


@query
def null_tokens(spark, sf_dir):
    """Round trip of the dirty lexicon through a CSV with padded header names."""
    path = scratch_path(spark, "lexicon-csv")
    fx.lexicon_dirty(spark, sf_dir).select(
        F.coalesce("word", F.lit("NA")).alias(" Word "),
        F.col("frequency").alias("Frequency "),
        F.lit("x").alias("Other"),
    ).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    return read_lexicon(spark, path)


@query
def first_match(spark, sf_dir):
    """A lexicon written in parts, its folder found by root and pattern."""
    path = scratch_path(spark, "roots")
    fx.lexicon(spark, sf_dir).select(
        F.col("word").alias("Word"), F.col("frequency").alias("Frequency")
    ).write.option("header", True).csv(f"{path}/deep/words")
    return read_first_match(
        spark, [f"{path}-absent", path], ["*34k*.csv", "part-*.csv"], whole_folder=True
    )


@query
def read_vocab_lines(spark, sf_dir):
    path = scratch_path(spark, "vocab")
    lines = fx.vocab_lines(spark, sf_dir).orderBy("trimmed", "line").select("line")
    lines.write.text(path)
    return read_vocab(spark, path)


# --- vectors ---------------------------------------------------------------


@query
def word_vectors(spark, sf_dir):
    """Whole-word vectors: vocabulary match, cut, lookup, unit length."""
    vocab = fx.vocab(spark, sf_dir)
    out = vec.whole_word_embeddings(
        fx.lexicon(spark, sf_dir), vocab, fx.weights(spark, sf_dir, vocab), TOP_AFTER
    )
    return out.select("word_id", "word", micro("features").alias("features"))


@query
def char_ngrams(spark, sf_dir):
    grams = vec.word_ngrams(lex.select_words(fx.lexicon(spark, sf_dir)))
    return grams.groupBy("ngram").agg(
        F.count("*").alias("n_words"), F.min("word").alias("first_word")
    )


@query
def subword_sum(spark, sf_dir):
    words = lex.select_words(fx.lexicon(spark, sf_dir))
    out = vec.subword_vectors(words, fx.ngram_table(spark, sf_dir, words))
    return out.select("word_id", "word", micro("features").alias("features"))


@query
def subword_embeddings(spark, sf_dir):
    """Unit-length subword vectors of the most frequent words, cut before cleaning."""
    words = lex.select_words(fx.lexicon_dirty(spark, sf_dir), TOP_BEFORE, when="before")
    out = vec.subword_embeddings(words, fx.ngram_table(spark, sf_dir, words))
    return out.select("word_id", "word", micro("features").alias("features"))


@query
def masked_mean_pool(spark, sf_dir):
    out = vec.masked_mean_pool(fx.token_states(spark, sf_dir), max_length=4)
    return out.select("word_id", micro("features").alias("features"))


@query
def contextual_embeddings(spark, sf_dir):
    """Pooled letters of every word under a small encoder made from the letters themselves."""

    def encoder():
        def encode(words, max_length):
            words = [w[:max_length] for w in words]
            longest = max(1, max(len(w) for w in words))
            codes = np.zeros((len(words), longest))
            for i, w in enumerate(words):
                codes[i, : len(w)] = [ord(c) for c in w]
            hidden = np.stack([codes, codes % 7, codes % 11], axis=2)
            return hidden, (codes > 0).astype(float)

        return encode

    words = lex.select_words(fx.lexicon(spark, sf_dir))
    out = vec.contextual_embeddings(words, encoder, max_length=16)
    return out.select("word_id", "word", micro("features").alias("features"))


@query
def token_truncation(spark, sf_dir):
    """First 16 words of every conversation turn."""
    turns = fx.table(spark, sf_dir, "conversations")
    cut = truncate_tokens(fx.tokens("text"), 16)
    return turns.select("conv_id", "turn", F.array_join(cut, " ").alias("tokens"))


@query
def normalized_vectors(spark, sf_dir):
    vocab = fx.vocab(spark, sf_dir)
    weights = fx.weights(spark, sf_dir, vocab)
    return weights.select("idx", micro_of(l2_normalize("features")).alias("features"))


def micro_of(c: Column) -> Column:
    return F.array_join(
        F.transform(c, lambda x: F.round(x.cast("double") * 1e6).cast("bigint").cast("string")), ","
    )


@query
def pair_distances(spark, sf_dir):
    """Distances of every vector to the mean vector of its label."""
    e = fx.points(spark, sf_dir)
    a = fx.assignments(spark, sf_dir).where(F.col("algorithm") == "label")
    centers = met.centroids(a, e)
    rows = a.join(e, "word_id").join(centers, ["algorithm", "k", "cluster"])
    return rows.select(
        "word_id",
        "cluster",
        r6(l2("features", "centroid")).alias("l2"),
        r6(sq_l2("features", "centroid")).alias("sq_l2"),
        r6(cosine_distance("features", "centroid")).alias("cosine"),
        r6(dot("features", "centroid")).alias("dot"),
    )


@query
def embeddings_round_trip(spark, sf_dir):
    path = scratch_path(spark, "embeddings")
    e = fx.points(spark, sf_dir).withColumn("word", F.concat(F.lit("w"), "word_id"))
    write_embeddings(e, path)
    back = read_embeddings(spark, [f"{path}-absent", path])
    return back.select("word_id", "word", micro("features").alias("features"))


# --- cluster quality ---------------------------------------------------------


def _grid(spark, sf_dir):
    return fx.assignments(spark, sf_dir), fx.points(spark, sf_dir)


@query
def cluster_centroids(spark, sf_dir):
    c = met.centroids(*_grid(spark, sf_dir))
    return c.select(*LABELING, "cluster", "n", F.posexplode("centroid").alias("pos", "value")).select(
        *LABELING, "cluster", "n", "pos", r6("value").alias("value")
    )


@query
def wcss(spark, sf_dir):
    return met.wcss(*_grid(spark, sf_dir)).withColumn("wcss", r6("wcss"))


@query
def inertia(spark, sf_dir):
    """About centres that differ from the member means: means rounded to one digit."""
    a, e = _grid(spark, sf_dir)
    rounded = F.transform("centroid", lambda x: F.round(x, 1)).alias("center")
    centers = met.centroids(a, e).select(*LABELING, "cluster", rounded)
    return met.inertia(a, e, centers).withColumn("inertia", r6("inertia"))


@query
def silhouette_exact(spark, sf_dir):
    return met.silhouette(*_grid(spark, sf_dir)).withColumn("silhouette", r6("silhouette"))


@query
def silhouette_samples(spark, sf_dir):
    s = met.silhouette_samples(*_grid(spark, sf_dir))
    return s.select(
        *LABELING, "word_id", "cluster_size",
        r6("a").alias("a"), r6("b").alias("b"), r6("silhouette").alias("silhouette"),
    )


@query
def silhouette_sampled(spark, sf_dir):
    """The sampled form: 300 points by a seeded hash."""
    s = met.silhouette(*_grid(spark, sf_dir), sample_size=300, seed=42)
    return s.withColumn("silhouette", r6("silhouette"))


@query
def davies_bouldin(spark, sf_dir):
    d = met.davies_bouldin(*_grid(spark, sf_dir))
    return d.withColumn("davies_bouldin", r6("davies_bouldin"))


@query
def calinski_harabasz(spark, sf_dir):
    c = met.calinski_harabasz(*_grid(spark, sf_dir))
    return c.withColumn("calinski_harabasz", r6("calinski_harabasz"))


@query
def cluster_count_check(spark, sf_dir):
    """Against a requested k of twice the clusters."""
    a = fx.assignments(spark, sf_dir).withColumn("k", F.col("k") * 2)
    return met.cluster_count_check(a)


@query
def evaluate_grid(spark, sf_dir):
    e = met.evaluate(*_grid(spark, sf_dir))
    names = ("wcss", "silhouette", "davies_bouldin", "calinski_harabasz")
    return e.select(*LABELING, "n_points", "n_clusters", *[r6(m).alias(m) for m in names])


# --- graphs and clustering ---------------------------------------------------


@query
def knn_graph(spark, sf_dir):
    g = knn.knn_graph(fx.points(spark, sf_dir), 10)
    return g.withColumn("distance", r6("distance"))


@query
def knn_approximate(spark, sf_dir):
    """Neighbours in the eight nearest cells, and whether the exact graph has them."""
    points = fx.points(spark, sf_dir)
    near = knn.knn_graph(points, 10, method="approximate", probe=8, block_rows=64)
    exact = knn.knn_graph(points, 10).select("src", "dst", F.lit(True).alias("exact"))
    found = near.join(exact, ["src", "dst"], "left").fillna(False, ["exact"])
    return found.withColumn("distance", r6("distance"))


@query
def normalized_affinity(spark, sf_dir):
    a = knn.normalized_affinity(knn.knn_graph(fx.points(spark, sf_dir), 10))
    return a.withColumn("norm_w", r6("norm_w"))


def label_means(spark, sf_dir) -> np.ndarray:
    """Mean vector of each label: ten rows."""
    a = fx.assignments(spark, sf_dir).where(F.col("algorithm") == "label")
    rows = met.centroids(a, fx.points(spark, sf_dir)).orderBy("cluster").collect()
    return np.array([r["centroid"] for r in rows])


@query
def kmeans_fixed_init(spark, sf_dir):
    """Five full-batch steps from the label means."""
    fit = km.lloyd(fx.points(spark, sf_dir), label_means(spark, sf_dir), max_iter=5, tol=0.0)
    return fit.labels


@query
def minibatch_kmeans(spark, sf_dir):
    """Eight batches of about 100 from the label means."""
    return mb.minibatch_kmeans(
        fx.points(spark, sf_dir), 10, seed=42, batch_size=100, steps=8,
        max_no_improvement=None, init_centers=label_means(spark, sf_dir),
    ).labels


@query
def minibatch_stream(spark, sf_dir):
    """Centres and counts after the vectors came as a stream of files, from the label means."""
    files = spark.readStream.schema("vec_id long, embedding array<float>").parquet(f"{sf_dir}/embeddings.parquet*")
    points = files.withColumnsRenamed({"vec_id": "word_id", "embedding": "features"})
    state = scratch_path(spark, "stream")
    stream_minibatch(points, label_means(spark, sf_dir), state).awaitTermination()
    centers, seen, _ = load_centers(spark, state)
    rows = [(i, int(n), j, float(v)) for i, (c, n) in enumerate(zip(centers, seen)) for j, v in enumerate(c, 1)]
    moved = spark.createDataFrame(rows, "cluster int, seen long, place int, value double")  # k x d numbers
    return moved.withColumn("value", r6("value"))


@query
def gmm_diag(spark, sf_dir):
    """Three EM iterations from the given labels."""
    labels = fx.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("word_id"), F.col("label").alias("cluster")
    )
    return gmm.gmm_diag(
        fx.points(spark, sf_dir), 10, max_iter=3, tol=-1.0, init_labels=labels
    ).labels


@query
def dendrogram(spark, sf_dir):
    d = agg.dendrogram(fx.points(spark, sf_dir))
    return d.withColumn("height", r6("height"))


@query
def agglomerative(spark, sf_dir):
    return agg.agglomerative(fx.points(spark, sf_dir), [5, 8, 20])


@query
def kmeans_best_of_n(spark, sf_dir):
    return km.kmeans(fx.points(spark, sf_dir), 10, seed=42, n_init=10).labels


@query
def spectral(spark, sf_dir):
    return spc.spectral(fx.points(spark, sf_dir), 10, seed=42).labels


@query
def spectral_power_iteration(spark, sf_dir):
    """Labels by power iteration on the affinity graph, without eigenvectors."""
    return spc.power_iteration(fx.points(spark, sf_dir), 10)


@query
def sweep(spark, sf_dir):
    """All five algorithms at two k, scored: the metric table."""
    points = fx.points(spark, sf_dir)
    return suite.metric_table(suite.sweep(points, [5, 10]), points)


@query
def run_suite(spark, sf_dir):
    return suite.run_suite(fx.points(spark, sf_dir), 10)


@query
def subword_kmeans_metrics(spark, sf_dir):
    """Words to metrics: ranked words, subword vectors, k-means at two k, scores."""
    words = lex.select_words(fx.lexicon(spark, sf_dir), TOP_BEFORE, when="before")
    vectors = materialize(vec.subword_embeddings(words, fx.ngram_table(spark, sf_dir, words)), "subword-vectors")
    fits = suite.sweep(vectors, [50, 200], ["Voronoi_Partition"])
    return suite.metric_table(fits, vectors, sample_size=10_000)


# --- ontology ----------------------------------------------------------------


@query
def synset_pairs(spark, sf_dir):
    pairs = ont.canonical_pairs(fx.word_pairs(spark, sf_dir))
    return ont.synset_pairs(pairs, fx.synsets(spark, sf_dir))


def _sense_pairs(spark, sf_dir, synsets):
    pairs = ont.canonical_pairs(fx.word_pairs(spark, sf_dir))
    return ont.synset_pairs(pairs, synsets, listed=False)


@query
def hypernym_jaccard(spark, sf_dir):
    synsets, hypernyms = fx.ontology(spark, sf_dir)
    out = ont.hypernym_jaccard(_sense_pairs(spark, sf_dir, synsets), hypernyms)
    return out.withColumn("jaccard", r6("jaccard"))


@query
def jaccard_arrays(spark, sf_dir):
    """Set overlap of the words of neighbouring conversation turns."""
    turns = fx.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", fx.tokens("text").alias("t")
    )
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("u"))
    return turns.join(following, ["conv_id", "turn"]).select(
        "conv_id", "turn", r6(jaccard("t", "u")).alias("jaccard")
    )


@query
def path_similarity(spark, sf_dir):
    synsets, hypernyms = fx.ontology(spark, sf_dir)
    out = ont.path_similarity(_sense_pairs(spark, sf_dir, synsets), hypernyms)
    return out.withColumn("path_sim", r6("path_sim"))


@query
def path_similarity_deep(spark, sf_dir):
    """Chains of 40 part keys, two of which meet above their ends."""
    key = F.col("p_partkey")
    part = fx.table(spark, sf_dir, "part").select(key.cast("long").alias("p_partkey"))
    over = F.when(key % 40 == 39, F.concat(F.lit("g"), F.floor(key / 80))).otherwise(F.concat(F.lit("p"), key + 1))
    hypernyms = part.select(F.concat(F.lit("p"), key).alias("synset_id"), over.alias("hypernym_id"))
    pairs = part.where(key % 80 < 40).select(
        F.concat(F.lit("p"), key).alias("s1"), F.concat(F.lit("p"), key + 40).alias("s2")
    )
    return ont.path_similarity(pairs, hypernyms).withColumn("path_sim", r6("path_sim"))


@query
def pair_similarity(spark, sf_dir):
    out = ont.pair_similarity(fx.word_pairs(spark, sf_dir), *fx.ontology(spark, sf_dir))
    return out.withColumn("sim", r6("sim"))


def _coherence(fn, spark, sf_dir, **options):
    return fn(fx.word_clusters(spark, sf_dir), *fx.ontology(spark, sf_dir), **options)


@query
def cluster_coherence(spark, sf_dir):
    out = _coherence(ont.cluster_coherence, spark, sf_dir)
    return out.withColumn("coherence", r6("coherence"))


@query
def cluster_coherence_jaccard(spark, sf_dir):
    """Hypernym overlap only, with pairs of similarity 0 in the mean."""
    out = _coherence(ont.cluster_coherence, spark, sf_dir, use_path=False, count_zero=True)
    return out.withColumn("coherence", r6("coherence"))


@query
def coherence_summary(spark, sf_dir):
    return _coherence(ont.coherence_summary, spark, sf_dir, use_path=False)


@query
def coherence_chart_data(spark, sf_dir):
    """The summary through a file, without the algorithms that have no value."""
    path = scratch_path(spark, "coherence")
    write_coherence(_coherence(ont.coherence_summary, spark, sf_dir), path)
    return report.coherence_chart_data(read_coherence(spark, path))


# --- reports and files ---------------------------------------------------------


@query
def metrics_long(spark, sf_dir):
    return report.metrics_long(fx.metrics(spark, sf_dir)).withColumn("value", r6("value"))


@query
def metric_curves(spark, sf_dir):
    """Both models read as one table, so points with two rows are averaged."""
    both = fx.metrics(spark, sf_dir).drop("model")
    return report.metric_curves(both).withColumn("value", r6("value"))


@query
def best_by_metric(spark, sf_dir):
    return report.best_by_metric(fx.metrics(spark, sf_dir)).withColumn("value", r6("value"))


@query
def metric_deltas(spark, sf_dir):
    d = report.metric_deltas(fx.metrics(spark, sf_dir))
    return d.withColumn("value", r6("value")).withColumn("delta", r6("delta"))


@query
def compare_models(spark, sf_dir):
    m = fx.metrics(spark, sf_dir)
    sizes = {
        r["l_linestatus"]: r["count"]
        for r in fx.table(spark, sf_dir, "lineitem").groupBy("l_linestatus").count().collect()
    }
    parts = {s: m.where(F.col("model") == s).drop("model") for s in sizes}
    out = report.compare_models(parts, sizes)
    return out.select("model", "k", "Algorithm", *[r6(c).alias(c) for c in out.columns[3:]])


@query
def metrics_round_trip(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    write_metrics(fx.metrics(spark, sf_dir), path)
    back = read_metrics(spark, [f"{path}-absent", path])
    return back.select("model", "k", "Algorithm", *[r6(m).alias(m) for m in report.METRIC_DIRECTIONS])


@query
def read_write_assignments(spark, sf_dir):
    path = scratch_path(spark, "assignments")
    write_assignments(fx.assignments(spark, sf_dir), path)
    return read_assignments(spark, path)


@query
def assignment_files(spark, sf_dir):
    """One CSV per algorithm, named after it; a file without a cluster column is skipped."""
    path = scratch_path(spark, "assignment-files")
    a = fx.assignments(spark, sf_dir)
    for name, _ in fx.LABELINGS:
        one = a.where(F.col("algorithm") == name)
        one.select(
            F.concat(F.lit("w"), "word_id").alias("Word"), F.col("cluster").alias("Cluster")
        ).write.option("header", True).csv(f"{path}/{name}_clusters.csv")
    a.select(F.col("word_id").alias("word")).write.option("header", True).csv(
        f"{path}/other_clusters.csv"
    )
    return read_assignments(spark, f"{path}/*_clusters.csv")
