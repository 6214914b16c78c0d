"""The training-data queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwise.llm.bpe import encoding_digests
from weftwise.llm.common import read_table
from weftwise.llm.fingerprints import edit_probe
from weftwise.llm.importance import good_ids, resample
from weftwise.llm.license_scan import scan_licenses
from weftwise.llm.near_dup import near_duplicates
from weftwise.llm.oracle import ORACLE  # noqa: F401
from weftwise.llm.packing import pack_documents
from weftwise.llm.phrases import collocations
from weftwise.llm.pii import replace_entities
from weftwise.llm.preferences import format_preferences, masks, pair_neighbours
from weftwise.llm.quality import judge
from weftwise.llm.repeats import remove_repeats
from weftwise.llm.vector_codes import compress_vectors
from weftwise.llm.warc import archive_round_trip


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def vocabulary_path() -> str:
    """The published vocabulary's file, as installed on every node."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir), vocabulary_path(), size=2048, separator=0)


#: Share of the documents that resampling keeps.
KEEP_SHARE = 0.85


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_documents(spark, sf_dir), good_ids(read_table(spark, sf_dir, "labels")), KEEP_SHARE)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op4_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(_documents(spark, sf_dir), vocabulary_path())


def op7_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_probe(_documents(spark, sf_dir))


def op8_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = format_preferences(pair_neighbours(read_table(spark, sf_dir, "conversations")))
    return made.select(
        "pair_id", "prefix_turns", "prompt", "chosen", "rejected", masks(F.col("chosen_segments")).alias("chosen_mask"), masks(F.col("rejected_segments")).alias("rejected_mask"), "usable"
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir), length=200).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: The key of the surrogates; a production run brings its own.
SURROGATE_KEY = "a key that each run sets for itself"


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(_documents(spark, sf_dir), SURROGATE_KEY).select("doc_id", "n_entities", "entity_kinds", "text")


def op11_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(read_table(spark, sf_dir, "pages"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, _ = compress_vectors(read_table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents").select("text", "lang"), most=3, least=10, first=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_importance_resampling": op2_importance_resampling,
    "op3_license_scan": op3_license_scan,
    "op4_minhash_near_dup": op4_minhash_near_dup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op7_edit_fingerprints": op7_edit_fingerprints,
    "op8_preference_pairs": op8_preference_pairs,
    "op9_quality_rules": op9_quality_rules,
    "op10_pii_surrogates": op10_pii_surrogates,
    "op11_warc_round_trip": op11_warc_round_trip,
    "op12_vector_codes": op12_vector_codes,
    "op13_phrase_collocations": op13_phrase_collocations,
}
