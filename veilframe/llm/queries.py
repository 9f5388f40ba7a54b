"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import chunking, leakage, lookalike, mixing, mojibake, neardup, pii, sentences
from veilframe.session import table

VAULT_THRESHOLD = 0.6  # the vault's own threshold


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_pairs(table(spark, sf_dir, "document_entries"), VAULT_THRESHOLD).select("doc_id_a", "doc_id_b")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, sf_dir, "document_entries"), VAULT_THRESHOLD)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).where("pieces > 1").select("extraction_id").distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.split_oversized(table(spark, sf_dir, "extractions"), table(spark, sf_dir, "stream_scanners"))
    return made.withColumnRenamed("id", "extraction_id")


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again from their pieces, and whether every piece fits its limit and repeats at most half of it."""
    made = p2_pieces(spark, sf_dir)
    fresh = F.expr("substring(piece, overlap_chars + 1)")
    repeated = F.octet_length(F.expr("substring(piece, 1, overlap_chars)"))
    sound = (F.octet_length("piece") <= F.col("limit_bytes")) & (repeated * 2 <= F.col("limit_bytes")) & (F.col("pieces") > F.col("piece_no"))
    whole = made.groupBy("extraction_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", fresh.alias("fresh")))).alias("p"), F.every(sound).alias("sound"))
    return whole.select("extraction_id", F.array_join(F.col("p.fresh"), "").alias("text"), "sound")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [table(spark, sf_dir, name).select(F.lit(name).alias("origin"), F.col(record_id).alias("record_id"), "text") for name, record_id in (("extractions", "extraction_id"), ("scan_results", "result_id"))]
    return both[0].union(both[1])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.same_look_pairs(_records(spark, sf_dir), "record_id", origin="origin").select("origin", "id_a", "id_b")


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.with_form(_records(spark, sf_dir).distinct()).select("origin", "record_id", "uniform_text")


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_leaks(spark, sf_dir).where("kind = 'exact'").select("doc_id", "item_id")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "extractions").select("text").union(table(spark, sf_dir, "scan_results").select("text"))


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pii.fit(_texts(spark, sf_dir))
    made = [pii.redact(table(spark, sf_dir, name), model, record_id).select(F.lit(name).alias("origin"), F.col("id").alias("record_id"), "findings", "redacted_text") for name, record_id in (("extractions", "extraction_id"), ("scan_results", "result_id"))]
    return made[0].union(made[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p3_redacted(spark, sf_dir).select("origin", "record_id", F.explode("findings").alias("f"))
    return found.select("origin", "record_id", "f.kind", "f.span_start", "f.span_end").distinct()


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = mojibake.fit(table(spark, sf_dir, "documents"))
    return mojibake.repair(table(spark, sf_dir, "extractions"), model).withColumnRenamed("id", "extraction_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_restored(spark, sf_dir).select("extraction_id").distinct()


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split_sentences(table(spark, sf_dir, "documents")).select("doc_id", "span_start", "span_end")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_pieces, p2_restored, p3_found, p3_redacted, p4_found, p4_restored, p5_found, p5_forms, p6_found, p6_leaks, p7_mix, p7_shares, p8_found)}


def oracle_sql() -> dict[str, str]:
    from veilframe.llm import sql

    return sql.ORACLES
