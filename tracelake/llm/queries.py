"""The queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, filter_audit, langid, lexical, lm, ogg, oracle, packing, quality, quality_gam, simhash, substring_bytes, substring_words, token_counts
from ._store import cut


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.fit(documents(spark, sf_dir))
    return langid.identify_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), model)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=2)
    slim = pieces.select("doc_id", "piece", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"))
    return packing.pack(slim, capacity=1024)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rules = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.assess(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_bytes.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(bpe.encode_decode(documents(spark, sf_dir), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


def op7_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.from_media(ogg.to_media(documents(spark, sf_dir))).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "duration_ms",
    )


def op8_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_words.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), shingle=3, most=2)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"), limit=4096)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = filter_audit.failure_counts(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return filter_audit.audit(counts, list(filter_audit.FILTERS))


def op12_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_gam.classify(docs, quality_gam.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = cut(lexical.index(documents(spark, sf_dir)))
    return lexical.search(blocks, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=20)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_score": op1_lm_score,
        "op2_language_id": op2_language_id,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_quality_rules": op4_quality_rules,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_ogg_media": op7_ogg_media,
        "op8_recompression_dedup": op8_recompression_dedup,
        "op9_simhash": op9_simhash,
        "op10_token_counts": op10_token_counts,
        "op11_filter_audit": op11_filter_audit,
        "op12_quality_gam": op12_quality_gam,
        "op13_lexical_search": op13_lexical_search,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_suffix_dedup": oracle.BYTE_REPEATS, "op8_recompression_dedup": oracle.WORD_REPEATS, "op11_filter_audit": oracle.FILTER_AUDIT, "op13_lexical_search": oracle.LEXICAL_SEARCH}
