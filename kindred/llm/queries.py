"""One registered query per operator over the benchmark tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kindred.llm import (
    ball_search, bpe, chat, conversation_repair, decontamination, fingerprint, licenses, near_dedup, quality, secret_scan,
    sharding, simhash_dedup, substring,
)
from kindred.llm.common import table, two_columns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_columns(table(spark, sf_dir, "documents"))


@query
def op1_license_scan(spark, sf):
    return licenses.license_matches(documents(spark, sf))


@query
def op2_quality_classifier(spark, sf):
    return quality.quality_scores(documents(spark, sf))


@query
def op3_near_dedup(spark, sf):
    return near_dedup.near_duplicates(documents(spark, sf), k=4)


@query
def op4_benchmark_decontamination(spark, sf):
    return decontamination.leaks(documents(spark, sf), table(spark, sf, "benchmark").select("item_id", "text"))


def _listed(spans):
    """kind:start:end of an array of spans, in its order, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


@query
def op5_secret_scan(spark, sf):
    out = secret_scan.scan_secrets(documents(spark, sf))
    base = F.filter("spans", lambda x: x["layer"] == "")
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("bigint")
    return out.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda x: x["layer"]), ",").alias("span_layers"),
        F.col("layers").cast("bigint").alias("n_layers"), F.col("oversized").cast("bigint").alias("n_oversized"),
    )


@query
def op6_document_fingerprints(spark, sf):
    return fingerprint.fingerprint_report(documents(spark, sf))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


@query
def op7_bpe(spark, sf):
    out = bpe.encode(documents(spark, sf), vocabulary(), digests=True)
    return out.select(
        "doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256")
    )


@query
def op8_substring_dedup(spark, sf):
    out = substring.drop_repeats(documents(spark, sf))
    return out.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


@query
def op9_chat_format(spark, sf):
    return chat.chat_texts(table(spark, sf, "conversations"))


@query
def op10_sharding(spark, sf):
    out = sharding.assign_shards(documents(spark, sf))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op11_ranked_search(spark, sf):
    return ball_search.ranked_search(documents(spark, sf), table(spark, sf, "benchmark").select("item_id", "text"))


@query
def op12_conversation_repair(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.repair_report(conversation_repair.damaged(turns), turns)


@query
def op13_simhash_dedup(spark, sf):
    out = simhash_dedup.simhash_classes(documents(spark, sf))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
