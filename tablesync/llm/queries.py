"""One query per operator, over whole tables; ORACLE has the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablesync.llm.chat import best_paths, format_chat, read_loss, read_turns
from tablesync.llm.common import read_table, whole
from tablesync.llm.fingerprint import as_text, edited_documents, likeness, with_fingerprint
from tablesync.llm.langid import language_id
from tablesync.llm.lines import line_dedup
from tablesync.llm.mixing import mix
from tablesync.llm.merkle import document_leaves, merkle_proofs, proof_text, verified
from tablesync.llm.oracle import ORACLE  # noqa: F401 - part of this module's interface
from tablesync.llm.pii import KINDS, find_personal_data
from tablesync.llm.pieces import round_trip
from tablesync.llm.quality import quality_rules
from tablesync.llm.secrets import secret_scan
from tablesync.llm.simhash import simhash_components
from tablesync.llm.suffixes import repeated_substrings
from tablesync.llm.trie import digested, prefix_trie, rebuilt

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every text, the secrets themselves as digests."""
    found = secret_scan(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "score", "kept")


@query
def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = with_fingerprint(edited_documents(read_table(spark, sf_dir, "documents")), "edited", "edited_print")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op4_cube_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )


@query
def op5_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation is a tree in which each turn answers the one before."""
    given = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")),
                          F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("t"),
    ).select("conv_id", "t.turn", "t.role", F.lit(fixed).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    messages = given.unionByName(extra).select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"),
        place.alias("id"),
        (place - 1).alias("parent"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )
    chats = format_chat(best_paths(messages))
    read = chats.select(
        F.expr("nullif(tree, '')").cast("long").alias("conv_id"),
        "formatted",
        read_turns(F.col("formatted")).alias("turns"),
        F.array_join(read_loss(F.col("formatted"), F.col("loss_mask")), "").alias("loss"),
    )
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return repeated_substrings(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", spans.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and the text decoded from them."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(whole(F.col("text")), 256).alias("kept_sha256"))


@query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *(f"n_{kind}" for kind in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans"
    )


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of every document, verified against texts of which half have lost their line breaks."""
    docs = read_table(spark, sf_dir, "documents")
    odd = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0
    leaves = document_leaves(docs, tampered=F.when(odd, F.translate(docs["text"], "\n", "")).otherwise(docs["text"]))
    return verified(merkle_proofs(leaves), "claim").select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"),
        "folded_root", "verified",
    )


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie(*rebuilt(digested(read_table(spark, sf_dir, "conversations"))))


@query
def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read_table(spark, sf_dir, "documents"))
