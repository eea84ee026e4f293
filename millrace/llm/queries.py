"""Registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, bpe, chat, fingerprints, lm, merkle, oracle, packing, quality, repeats, sharding, simhash, trie, url_rules
from .common import table


def op1_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digest=True)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_neighbours(table(spark, sf_dir, "documents"))


def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"), shards=16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), length=400, digest=True)


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score(table(spark, sf_dir, "documents"), order=3, alpha=0.4)
    return found.withColumns({"log_score": F.round("log_score", 6), "mean_log_score": F.round("mean_log_score", 9)})


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(hit, merkle.leaf(docs, merkle.COLUMNS, {"text": lower}))
    return merkle.manifest(docs, tampered=tampered)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, lengths = trie.rebuilt(trie.turn_rows(table(spark, sf_dir, "conversations")))
    return trie.prefix_trie(turns, lengths)


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = r"\\### Assistant: </turn> ok"
    extra = spark.range(2).selectExpr("-7L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", f"'{odd}' as text")
    return chat.read_back(chat.examples(talks.unionByName(extra)))


QUERIES = {
    "op1_adaptive_scan": op1_adaptive_scan,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_url_rules": op3_url_rules,
    "op4_harmonic_packing": op4_harmonic_packing,
    "op5_bpe": op5_bpe,
    "op6_quality": op6_quality,
    "op7_fingerprints": op7_fingerprints,
    "op8_kd_shards": op8_kd_shards,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_lm_scores": op10_lm_scores,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_chat_format": op13_chat_format,
}

#: The others rest on XXH64, trained models, tokenizers or an approximate index; tests hold them
#: against brute force, the libraries or held-out labels.
ORACLE_SQL = {
    "op3_url_rules": oracle.OP3,
    "op9_suffix_dedup": oracle.OP9,
    "op10_lm_scores": oracle.OP10,
    "op11_merkle_manifest": oracle.OP11,
    "op12_prefix_trie": oracle.OP12,
    "op13_chat_format": oracle.OP13,
}
