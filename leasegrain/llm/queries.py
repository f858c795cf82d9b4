"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leasegrain.llm import decontamination, exact_index, langid, licenses, manifest, mixing, oracles, personal, search, sharding, simhash, substrings, token_files, toxicity
from leasegrain.llm.common import table
from leasegrain.session import shared_folder

BYTE_BPE = "byte_bpe_50k.json"


def tokenizer_path(name: str = BYTE_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fresh(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/leasegrain-tables/{label}-{uuid.uuid4().hex}"


def op1_interleaved_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    return sharding.interleave(docs, 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


def op2_range_coded_tokens(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh(spark, "tokens")
    token_files.write_tokens(table(spark, folder, "documents"), path, tokenizer_path())
    return token_files.read_tokens(spark, path)


def op3_near_components(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_components(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", "group_size")


def op4_live_digests(spark: SparkSession, folder: str) -> DataFrame:
    return exact_index.exact_groups(table(spark, folder, "documents"))


def op5_template_leaks(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "windows", "n_windows", "contained", "slots_changed")


def op6_weak_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_induced_repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, folder, "documents"), passages=True)
    return found.withColumn("has_repeat", F.col("n_removed") > 0)


def op8_code_languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op9_license_rules(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.with_licenses(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def op10_apportioned_mixture(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    parts = F.filter(F.transform("shard_words", lambda n, k: F.struct(k.alias("shard"), n.alias("n"))), lambda p: p["n"] > 0)
    shards = F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["shard"], p["n"])), ",").alias("shards")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", shards)


def op11_anchored_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = personal.scan(table(spark, folder, "documents"))
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in personal.BASE]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*personal.BASE))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op12_shared_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_bitmap_manifest(spark: SparkSession, folder: str) -> DataFrame:
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = manifest.prove(table(spark, folder, "documents"), other=manifest.leaf_digest(changed))
    sides = (F.col("lefts"), F.col("rights"))
    folded = manifest.folded(F.col("other"), *sides)
    proof = manifest.proof_digest(*sides).alias("proof_sha256")
    found = found.select("doc_id", "leaf", "subroot", "root", proof, folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {
    f.__name__: f
    for f in (op1_interleaved_shards, op2_range_coded_tokens, op3_near_components, op4_live_digests, op5_template_leaks, op6_weak_toxicity, op7_induced_repeats, op8_code_languages, op9_license_rules, op10_apportioned_mixture, op11_anchored_personal_data, op12_shared_search, op13_bitmap_manifest)
}
ORACLES: dict[str, str] = {
    "op4_live_digests": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY text)
    """,
    "op12_shared_search": oracles.SEARCH,
    "op13_bitmap_manifest": oracles.MANIFEST,
}
