"""The registered queries of the training-data operators: thin digests over the operators' own outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import remainder, table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words_per_shingle=3, percent=85)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit, predict

    docs, held_out = table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 3) == 1
    return predict(docs, fit(docs.where(~held_out)), held_out)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive, indexed

    pages = table(spark, sf_dir, "pages")
    number = lambda c: F.col(c).cast(pages.schema["page_id"].dataType).alias(c)
    return indexed(archive(pages)).select(number("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import private_spans

    return private_spans(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_report

    return quality_report(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import fit, score

    docs, held_out = table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 5) == 0
    return score(docs, fit(docs, table(spark, sf_dir, "labels"), ~held_out), held_out)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of each conversation and the next with the same opening, or of the next opening (the tables have no rejected conversations)."""
    from .preferences import conversations_of, preference_pairs, with_other_replies

    pairs = preference_pairs(with_other_replies(conversations_of(table(spark, sf_dir, "conversations"))))
    mask = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c)
    digest = lambda c: F.sha2(c, 256).alias(f"{c}_sha256")
    return pairs.select(F.col("pair_id").alias("conv_id"), F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"), digest("prompt"), digest("chosen"), mask("chosen_mask"), digest("rejected"), mask("rejected_mask"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resampled

    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import alignment

    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixture

    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return ORACLES
