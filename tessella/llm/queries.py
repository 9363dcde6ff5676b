"""The registered queries of the corpus operators, and their rows in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.llm import chosen_path, context_tree, divergence, fingerprints, mixing, neighbours, packing, parity, resampling, secrets, spelling, thresholds, tokens
from tessella.llm.common import table


def op1_importance_resampling(spark, sf_dir):
    return resampling.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_context_tree_lm(spark, sf_dir):
    return context_tree.score_documents(table(spark, sf_dir, "documents"))


def op3_orc_token_ids(spark, sf_dir):
    return tokens.token_file_digest(table(spark, sf_dir, "documents"), tokens.vocabulary("word_bpe_49k.json"))


def op4_risk_thresholds(spark, sf_dir):
    return thresholds.rule_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_weighted_epochs(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op6_blob_ledger(spark, sf_dir):
    return secrets.find_in_two_versions(table(spark, sf_dir, "documents"))


def op7_vector_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokens.vocabulary("byte_bpe_50k.json"))


def op8_learned_partitions(spark, sf_dir):
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op9_parity_join(spark, sf_dir):
    return parity.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=90)


def op10_fingerprint_index(spark, sf_dir):
    kept = fingerprints.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op11_source_divergence(spark, sf_dir):
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_chosen_path_join(spark, sf_dir):
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"), k=5, percent=85)


QUERIES = {
    f.__name__: f
    for f in (
        op1_importance_resampling,
        op2_context_tree_lm,
        op3_orc_token_ids,
        op4_risk_thresholds,
        op5_weighted_epochs,
        op6_blob_ledger,
        op7_vector_packing,
        op8_learned_partitions,
        op9_parity_join,
        op10_fingerprint_index,
        op11_source_divergence,
        op12_spelling_variants,
        op13_chosen_path_join,
    )
}
ORACLES = {
    "op4_risk_thresholds": thresholds.ORACLE,
    "op5_weighted_epochs": mixing.ORACLE,
    "op6_blob_ledger": secrets.ORACLE,
    "op10_fingerprint_index": fingerprints.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
}
