"""The queries of the operators, one for each, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.llm import ann, band_join, decontam, filter_audit, int8_links, jaccard, langid, lm, oracles, packing, quality, shared, substring, token_store, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.neighbours(vectors, vectors.where("vec_id % 50 = 0"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.last - s.first + 1)")
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identified(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), langid.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.groups(table(spark, sf_dir, "documents"), size=4, num=85, den=100)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.with_removals(table(spark, sf_dir, "documents"), digest=True)
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.scratch(spark, "warc")
    files = warc.write_pages(table(spark, sf_dir, "pages"), folder)
    return warc.read_pages(spark, folder, files, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lm.learn(docs.where(~lm.held_out(F.col("doc_id"))))
    found = lm.scored(docs, model, keep=["doc_id"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"), lm.held_out(F.col("row.doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classified(table(spark, sf_dir, "documents"), keep=["doc_id"], labels=table(spark, sf_dir, "labels"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_votes", "weak_score", "score", "keep", "toxic_score", "toxic")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.scratch(spark, "ids")
    files = token_store.write_ids(table(spark, sf_dir, "documents"), folder)
    return token_store.read_ids(spark, folder, files, digest=True)


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return int8_links.grouped(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_price_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return band_join.near_lines(table(spark, sf_dir, "items"), table(spark, sf_dir, "sale_lines"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_audit.flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.interactions(filter_audit.joint_failures(rows))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (
        op1_packing, op2_nearest_neighbours, op3_decontamination, op4_language_id, op5_jaccard_join, op6_substring_dedup, op7_warc, op8_lm_scoring, op9_quality, op10_token_ids,
        op11_embedding_dedup, op12_price_band_join, op13_filter_audit,
    )
    return {f.__name__: f for f in all_}


def oracle_sql() -> dict[str, str]:
    """Packing, neighbours, language, scores, quality and tokens go beyond SQL: tests hold them against brute force."""
    return {
        "op3_decontamination": oracles.DECONTAMINATION, "op5_jaccard_join": oracles.JACCARD, "op6_substring_dedup": oracles.SUBSTRING, "op7_warc": oracles.WARC,
        "op11_embedding_dedup": oracles.EMBEDDING, "op12_price_band_join": oracles.PRICE_BAND, "op13_filter_audit": oracles.FILTER_AUDIT,
    }
