"""Registered queries of this package: each applies one operator to its whole table."""

import public_tokenizers
from pyspark.sql import functions as F

from webmill.llm import (
    bpe_trie, embedding_dedup, hard_negatives, line_frequency, logistic, minhash_dedup, packing, quality, rp_forest,
    sharding, token_alignment, token_counts, toxicity, url_rules)
from webmill.session import use_utc


def table(spark, folder, name):
    return use_utc(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_line_frequency(spark, folder):
    judged = line_frequency.judge(table(spark, folder, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & ~F.col("depleted")).alias("kept"), "removed_words")


#: (verdict, host, path)
URL_RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
    ("block", "com", "/de/"))


def op2_url_rules(spark, folder):
    judged = url_rules.judge(table(spark, folder, "pages"), URL_RULES, longest=None, most=5)
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_confidence", "allow_confidence")


def op3_sharding(spark, folder):
    return sharding.shards(sharding.sized(table(spark, folder, "documents")), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", logistic.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_packing(spark, folder):
    cut = packing.pieces(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(cut)


def op6_token_counts(spark, folder):
    counts = token_counts.count(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op7_minhash_dedup(spark, folder):
    found = minhash_dedup.near_duplicates(table(spark, folder, "documents"), width=2)
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(False))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


def op8_embedding_dedup(spark, folder):
    found = embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(False))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), kept.alias("kept"))


def op9_quality(spark, folder):
    docs = table(spark, folder, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, folder, "labels")))


def op10_bpe_trie(spark, folder):
    return bpe_trie.digests(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_token_alignment(spark, folder):
    """Columns of the contract; ``n_group_links`` counts the links inside groups."""
    return token_alignment.weighed(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_rp_forest(spark, folder):
    return rp_forest.nearest(table(spark, folder, "embeddings"), F.col("id") % 50 == 0, k=5)


def op13_hard_negatives(spark, folder):
    relabel = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, relabel)


QUERIES = {
    "op1_line_frequency": op1_line_frequency,
    "op2_url_rules": op2_url_rules,
    "op3_sharding": op3_sharding,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_token_counts": op6_token_counts,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_quality": op9_quality,
    "op10_bpe_trie": op10_bpe_trie,
    "op11_token_alignment": op11_token_alignment,
    "op12_rp_forest": op12_rp_forest,
    "op13_hard_negatives": op13_hard_negatives,
}
