"""One query per operator, over its whole table; the digest columns are derived from the operators' outputs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import chat, decontam, hadamard, hardneg, langid, mixing, pii, quality, rules, simhash, substring, tokenout, urlfilter
from tapeloom.llm.common import held_out, stash, table

TOKENIZER = "byte_bpe_50k.json"


def op1_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    s = quality.score(docs, model, score_col="score")
    return s.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    return mixing.mix(stash(docs, "sizes")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


def op4_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "host_trust", "host_distrust")


def op5_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.select("doc_id", "lang", "text"))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op6_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = rules.measure(table(spark, sf_dir, "documents").select("doc_id", "text"))
    led = rules.apply_policy(rules.apply_policy(led, "base-1", out="base_kept"), "corpus-1", out="policy_kept")
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), (F.col("base_kept") & F.col("policy_kept")).alias("kept"), "rule_bits")


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents")).select("doc_id", simhash.hex_fp().alias("fingerprint"), "component_id")


def op8_arrow_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, manifest = tokenout.write(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(TOKENIZER))
    return tokenout.read_documents(spark, path, manifest)


def op9_chat_prefix_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.write(turns.unionByName(more)))


def op10_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = decontam.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return hit.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_gnat_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_rabin_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.dedupe(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), F.size("removed").cast("long").alias("n_intervals"))


def op13_walsh_hadamard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = hadamard.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("centroid_sha256", hadamard.digest(centroids, F.col("cluster")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality_mil, op2_source_mixing, op3_pii_bootstrap, op4_url_trust, op5_language_ppm, op6_rule_ledger, op7_simhash_groups, op8_arrow_tokens, op9_chat_prefix_target, op10_wu_manber, op11_gnat_negatives, op12_rabin_karp, op13_walsh_hadamard, pipeline)}
