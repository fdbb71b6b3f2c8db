"""The registered queries of this package, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    conversations, fingerprints, jaccard, licences, manifest, mixing, personal, quality, sentence_pieces, token_files, topk, toxicity,
    urls,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every document, the licence that it is, and the notices among its lines."""
    return licences.scan(table(spark, sf_dir, "documents"), licences.known_digests(spark), licences.KEYWORD)


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best partners of every 20th vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document and the text they decode to, as counts and digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentence_pieces.encode_decode(docs, vocabulary("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learnt from the labels that are not held out."""
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page's url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urls.judge(pages, urls.listing(spark, urls.RULES, urls.LISTED))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.with_copies(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return personal.digests(personal.find(table(spark, sf_dir, "documents")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and whether the base rules and the proven cutoffs keep it."""
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near copies of every document."""
    return jaccard.link_components(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, from files of patched frame-of-reference blocks."""
    return token_files.token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document, and how like it the edited text and the next document are."""
    compared = fingerprints.compare_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return compared.withColumn("edited_sha256", F.sha2("edited_text", 256)).drop("edited_text")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, and its cheapest repair."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.repair(conversations.damaged(rows))


def op13_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and verdict of every document in the manifest of its language and of the whole table."""
    return manifest.verified(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_licence_scan": op1_licence_scan,
    "op2_top_k": op2_top_k,
    "op3_sentence_pieces": op3_sentence_pieces,
    "op4_toxicity": op4_toxicity,
    "op5_url_filter": op5_url_filter,
    "op6_mixing": op6_mixing,
    "op7_personal_data": op7_personal_data,
    "op8_quality_rules": op8_quality_rules,
    "op9_shingle_join": op9_shingle_join,
    "op10_token_files": op10_token_files,
    "op11_fingerprints": op11_fingerprints,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_dataset_manifest": op13_dataset_manifest,
}

ORACLES: dict[str, str] = {
    "op1_licence_scan": licences.ORACLE, "op2_top_k": topk.ORACLE, "op5_url_filter": urls.ORACLE, "op6_mixing": mixing.ORACLE,
    "op9_shingle_join": jaccard.ORACLE, "op11_fingerprints": fingerprints.ORACLE,
    "op12_conversation_repair": conversations.ORACLE, "op13_dataset_manifest": manifest.ORACLE,
}
