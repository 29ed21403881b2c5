"""The operators of this subpackage bound to the tables, as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    op1_rule_ensemble,
    op2_hash_tree,
    op3_tag_path_ratios,
    op4_partenum_join,
    op5_suffix_repetition,
    op6_toxicity_cnn,
    op7_bpe,
    op8_cross_entropy,
    op9_spaced_seeds,
    op10_cross_parsing,
    op11_spelling_variants,
    op12_fill_middle,
    op13_recompression,
    oracles,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = op1_rule_ensemble.learn_quality(docs, _table(spark, sf_dir, "labels"))
    return op1_rule_ensemble.score_quality(docs, model)


def op2_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_hash_tree.shard_documents(_table(spark, sf_dir, "documents"), shards=8)


def op3_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_tag_path_ratios.extract_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_partenum_join.link_sets(_table(spark, sf_dir, "documents"))


def op5_suffix_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered_words", "longest_repeat"]
    return op5_suffix_repetition.quality_statistics(_table(spark, sf_dir, "documents")).select(columns)


def op6_cnn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = op6_toxicity_cnn.learn_toxicity(docs, _table(spark, sf_dir, "labels"))
    return op6_toxicity_cnn.score_toxicity(docs, model)


def tokenizer_path() -> str:
    """The public byte-level BPE file; the only tokenizer the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_bpe.encode_and_check(_table(spark, sf_dir, "documents"), op7_bpe.ByteBpe.read(tokenizer_path()))


def op8_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as good."""
    good = _table(spark, sf_dir, "labels").where("quality = 1")
    return op8_cross_entropy.score_documents(_table(spark, sf_dir, "documents"), good)


def op9_spaced_seed_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op9_spaced_seeds.contaminated_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumns({c: F.col(c).cast("long") for c in ("n_agree", "n_window")})


def op10_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return op10_cross_parsing.predict_language(docs, op10_cross_parsing.learn_languages(docs))


def op11_even_partition_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_spelling_variants.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_fill_middle_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = op12_fill_middle.transform_and_check(_table(spark, sf_dir, "documents"))
    return made.withColumnsRenamed({"prefix_units": "prefix_chars", "middle_units": "middle_chars"})


def op13_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = op13_recompression.drop_repeats(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {
    "op1_rule_ensemble_quality": op1_rule_ensemble_quality,
    "op2_hash_tree_shards": op2_hash_tree_shards,
    "op3_tag_path_text": op3_tag_path_text,
    "op4_partenum_jaccard": op4_partenum_jaccard,
    "op5_suffix_repetition_rules": op5_suffix_repetition_rules,
    "op6_cnn_toxicity": op6_cnn_toxicity,
    "op7_pair_index_bpe": op7_pair_index_bpe,
    "op8_cross_entropy_difference": op8_cross_entropy_difference,
    "op9_spaced_seed_leaks": op9_spaced_seed_leaks,
    "op10_cross_parsing_language": op10_cross_parsing_language,
    "op11_even_partition_spelling": op11_even_partition_spelling,
    "op12_fill_middle_batches": op12_fill_middle_batches,
    "op13_recompression_dedup": op13_recompression_dedup,
}

ORACLE_SQL: dict[str, str] = {"op4_partenum_jaccard": oracles.OP4, "op9_spaced_seed_leaks": oracles.OP9, "op11_even_partition_spelling": oracles.OP11, "op12_fill_middle_batches": oracles.OP12, "op13_recompression_dedup": oracles.OP13}
