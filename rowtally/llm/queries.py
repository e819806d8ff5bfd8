"""Registered queries of the operators: thin, each on the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtally.llm import alignment, chat, contamination, embeddings, jaccard, licences, merkle, packing, sharding, substrings, token_counts, toxicity, warc
from rowtally.session import scratch_folder, stored

TOKENIZER = "word_bpe_49k.json"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs, window=20)


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.fit(docs, toxicity.training_labels(table(spark, sf_dir, "labels"), held_out()))
    scored = toxicity.with_score(docs, machine)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def op3_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", sharding.text_size(F.col("text")).alias("size"), sharding.text_crc32(F.col("text")).alias("text_crc32"), F.lit("key").alias("law"))
    even = {s: 1.0 for s in range(16)}
    out = sharding.shard_by_key(rows, "doc_id", even, {**even, 16: 1.0})
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op4_decontamination(spark, sf_dir):
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark, sf_dir):
    return token_counts.length_histogram(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_warc(spark, sf_dir):
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_records(index, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_licence_scan(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"), n=4, percent=85)


def op9_embedding_dedup(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), capacity=2048)


def op11_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    leaf = lambda n_chars: merkle.record_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = F.when(chosen & F.col("n_chars").isNotNull(), leaf(F.col("n_chars") + 1))
    rows = docs.select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), tampered.alias("tampered"))
    proved = merkle.prove(rows, "lang", "doc_id", "leaf")
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof"))
    out = proved.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_token_alignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return alignment.aligned(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_chat_format(spark, sf_dir):
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                    F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    template = chat.Template()
    examples = stored(chat.format_chats(turns, template), scratch_folder(spark, "chats"))
    one = F.struct("block", "turn", F.when(F.col("last"), F.col("chat")).alias("whole"), chat.trained_text(template).alias("reply"))
    size, rest = (F.char_length("before") + F.char_length("chat")).cast("long"), F.col("loss_end").isNull()
    # examples with all their context, and what comes behind the last one; rows that end an earlier block repeat nothing new
    behind = F.max_by(F.when(rest, size).otherwise(0), F.struct("block", rest.alias("rest")))
    read = examples.groupBy("conv_id").agg((F.coalesce(F.sum(F.when(~rest, size)), F.lit(0)) + behind).alias("formatted_chars"), F.sort_array(F.collect_list(one)).alias("rows"))
    joined = lambda name: F.array_join(F.transform("rows", lambda r: r[name]), "")
    read = read.select("conv_id", template.turns(joined("whole")).alias("said"), joined("reply").alias("reply"), "formatted_chars")
    lines = F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("said").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                       F.char_length("reply").cast("long").alias("loss_chars"), F.sha2("reply", 256).alias("loss_sha256"), "formatted_chars")


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_toxicity, op3_sharding, op4_decontamination, op5_token_counts,
    op6_warc, op7_licence_scan, op8_jaccard_join, op9_embedding_dedup, op10_packing,
    op11_merkle_manifest, op12_token_alignment, op13_chat_format)}
