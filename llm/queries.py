"""Registered queries: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.runtime import scratch_path

from . import ann, bpe, chat, langid, lexical, merkle, mixing, ngram_join, quality, repair, substring, suffix, toxicity

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def remainder(id_col: str, n: int):
    """crc32 of the id as text, modulo ``n``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_components(_table(spark, sf_dir, "documents"), n=3, percent=90)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 3) == 1
    model = langid.train(docs, held_out)
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs, window=20).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256")
    )


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bpe.encode(docs, tokenizer_path(), decoded_col="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op6_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with its first assistant reply in place of the last."""
    rows = chat.conversations(_table(spark, sf_dir, "conversations"))
    mine = F.filter("turns", lambda t: t["role"] == chat.ASSISTANT)
    swapped = F.transform(
        "turns",
        lambda t: F.when(
            (t["role"] == chat.ASSISTANT) & (t["turn"] == F.col("last.turn")),
            F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.col("first.text").alias("text")),
        ).otherwise(t),
    )
    pairs = rows.select(
        "*", F.get(mine, F.lit(0)).alias("first"), F.get(mine, F.size(mine) - 1).alias("last")
    ).select("conv_id", F.col("turns").alias("chosen"), swapped.alias("rejected"))

    def spans(name):
        shown = F.transform(name, lambda s: F.concat_ws("-", s["start"], s["stop"]))
        return F.array_join(shown, ",").alias(name)

    return chat.preference_pairs(pairs).select(
        "conv_id", "n_prompt", "prompt", "chosen", "rejected", spans("chosen_spans"), spans("rejected_spans")
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select("doc_id", *quality.COUNTS, "base_failed", "kept", "posterior")


def op8_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-shards")
    repair.write(_table(spark, sf_dir, "documents"), path, tokenizer_path())
    return repair.read_checksums(spark, path)


def op9_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.search(_table(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(20)) == 0, k=20)
    return found.withColumnRenamed("id", "vec_id")


def op10_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 5) == 0
    machine = toxicity.train(docs, _table(spark, sf_dir, "labels"), held_out)
    return toxicity.score(docs, machine).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix.remove_repeated_bytes(docs, length=50).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    more = [F.try_add("n_chars", F.lit(1)) if c == "n_chars" else F.col(c) for c in merkle.FIELDS]
    docs = docs.withColumn("tampered", F.when(remainder("doc_id", 7) == 0, merkle.leaf_hash(*more)))
    found = merkle.manifest(docs, keep=["tampered"])
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("siblings"), F.col("place"))
    return found.select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
        (folded == F.col("root")).alias("verified"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_language_id": op2_language_id,
    "op3_source_mixing": op3_source_mixing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_preference_format": op6_preference_format,
    "op7_quality_rules": op7_quality_rules,
    "op8_repair_shards": op8_repair_shards,
    "op9_permutation_index": op9_permutation_index,
    "op10_toxicity_fm": op10_toxicity_fm,
    "op11_lexical_search": op11_lexical_search,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
    "pipeline": pipeline,
}
