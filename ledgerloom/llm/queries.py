"""The registered queries: every operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import best_fit, compact_windows, line_runs, order_minhash, parity_join, periodic_runs, prefix_tree, quality_fm, raking, rules_forest, simhash_gph, suffix_dedup, zone_negatives
from ledgerloom.llm.frames import stage


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    # Workers of a session that was started elsewhere find the package where the driver found it.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_fm(spark: SparkSession, folder: str) -> DataFrame:
    """Every document scored by a classifier that never saw its held-out third."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    machine = quality_fm.train(docs, labels.filter(~quality_fm.held_out()))
    return quality_fm.score(docs, machine).select(
        "doc_id", quality_fm.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_simhash_gph(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of every document and the smallest document that links reach."""
    found = simhash_gph.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_rules_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Rule counts of every document, the base rules, and the forest's verdict on the rest."""
    docs = table(spark, folder, "documents")
    forest = rules_forest.train(docs, table(spark, folder, "labels"))
    return rules_forest.judge(docs, forest).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "anomaly", "kept")


CAPACITY = 2048


def packed(docs: DataFrame) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    cut = best_fit.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, CAPACITY)
    cut = stage(cut.select("item", "doc_id", "piece", "start", F.expr("octet_length(ids) div 4").cast("long").alias("length"),
                           F.crc32("ids").alias("ids_crc32")), "pieces")
    return cut.join(best_fit.pack(cut.select("item", "length"), CAPACITY), "item").drop("item")


def op4_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packed(table(spark, folder, "documents"))


def op5_prefix_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation as read back from the token ids of its tree."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    path = public_tokenizers.path("byte_bpe_50k.json")
    nodes, members = prefix_tree.build(turns.union(probe), path, public_tokenizers.PATTERN)
    return prefix_tree.read_back(stage(nodes, "forest"), members, path)


def op6_compact_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Class of every document by near-duplicate passages of 50 words or more."""
    return compact_windows.classes(table(spark, folder, "documents"))


def op7_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are."""
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = order_minhash.with_next(docs, ["text", "mark"], lambda rows: order_minhash.with_fingerprint(rows, "text", "mark"))
    pairs = pairs.select("doc_id", "mark", "next_mark", F.length("text").cast("long").alias("n_chars"),
                         order_minhash.edited(F.col("text"), F.col("next_text")).alias("edited"))
    done = order_minhash.with_fingerprint(pairs, "edited", "edited_mark")
    return done.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), order_minhash.as_text(F.col("mark")).alias("fingerprint"),
        order_minhash.as_text(F.col("edited_mark")).alias("edited_fingerprint"),
        order_minhash.likeness(F.col("mark"), F.col("edited_mark")).alias("near_edited"),
        order_minhash.likeness(F.col("mark"), F.col("next_mark")).alias("near_next"))


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every text without strings of 400 bytes that occur twice."""
    done = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    return done.select("doc_id", "n_bytes", F.expr("aggregate(spans, 0L, (a, s) -> a + s.size)").alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_line_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without lines that repeat earlier ones."""
    done = line_runs.drop_copies(table(spark, folder, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op10_raking(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its weight under the target marginals and whether it was drawn."""
    mixed = raking.mix(table(spark, folder, "documents"), dims={"topic": raking.topic_of(F.col("text"))})
    return mixed.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "topic", "tokens",
                        F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "sampled")


def op11_zone_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every anchor's positives. Every seventh row has the next label, as the contract asks."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return zone_negatives.hard_negatives(table(spark, folder, "embeddings"), label=label)


def op12_parity_join(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under links of 80 per cent of its five-word shingles."""
    return parity_join.jaccard_components(table(spark, folder, "documents"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of every document, a tenth of which is made periodic, and the text with its runs collapsed."""
    return periodic_runs.periodic_runs(table(spark, folder, "documents"), change=periodic_runs.broken)


TOPIC_SQL = """CASE WHEN coalesce(length(text), 0) < 400 THEN 'brief' WHEN contains(text, ' | ') THEN 'table'
  WHEN length(text) < 4000 THEN 'article' ELSE 'long read' END"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_fm": op1_quality_fm,
    "op2_simhash_gph": op2_simhash_gph,
    "op3_rules_forest": op3_rules_forest,
    "op4_best_fit": op4_best_fit,
    "op5_prefix_tree": op5_prefix_tree,
    "op6_compact_windows": op6_compact_windows,
    "op7_order_minhash": op7_order_minhash,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_line_runs": op9_line_runs,
    "op10_raking": op10_raking,
    "op11_zone_negatives": op11_zone_negatives,
    "op12_parity_join": op12_parity_join,
    "op13_periodic_runs": op13_periodic_runs,
}

SQL: dict[str, str] = {
    "op9_line_runs": line_runs.oracle(line_runs.LineParams()),
    "op10_raking": raking.oracle(raking.MixParams(), TOPIC_SQL),
}
