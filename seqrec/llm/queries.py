"""The ten contract queries over the synthetic tables; each applies its operator to the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqrec.llm.license_scan import scan_licenses

    out = scan_licenses(table(spark, sf_dir, "documents"))
    names = F.array_join(F.array_distinct(F.transform("matches", lambda m: m["license"])), ",")
    best = F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)), 6)
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("matches").cast("long").alias("n_matches"), names.alias("licenses"), best.alias("best_containment"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqrec.llm.mixing import plan_mix

    return plan_mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqrec.llm.chat import chat_digest, format_chats

    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_digest(format_chats(turns))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqrec.llm.url_filter import Rule, filter_urls, url_labels

    rules = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]
    pages = table(spark, sf_dir, "pages")
    marked = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return filter_urls(pages, marked.unionByName(url_labels(pages, rules)), rules).select("page_id", "host", "path", "rule", "verdict")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqrec.llm.quality_rules import SIGNALS, host_quality

    return host_quality(table(spark, sf_dir, "documents")).select("doc_id", *SIGNALS, "base_failed", "kept")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqrec.llm.folds import held_out
    from seqrec.llm.quality_pu import fit, score_quality

    docs = table(spark, sf_dir, "documents")
    out = score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqrec.llm.folds import held_out
    from seqrec.llm.language_id import fit, identify

    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqrec.llm.decontaminate import find_contamination

    out = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"] + 1)
    out = out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqrec.llm.line_dedup import apply_removals, duplicate_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_removals(docs, duplicate_lines(docs))
    n_lines = F.coalesce(F.size(F.split("row.text", "\n")), F.lit(0)).cast("long")
    removed = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    return out.select("row.doc_id", n_lines.alias("n_lines"), removed.alias("n_removed"), F.array_join("gone", ",").alias("removed_lines"), F.sha2("new_text", 256).alias("text_sha256"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqrec.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_source_mix": op2_source_mix,
    "op3_chat_format": op3_chat_format,
    "op4_quality": op4_quality,
    "op5_language_id": op5_language_id,
    "op6_decontaminate": op6_decontaminate,
    "op7_line_dedup": op7_line_dedup,
    "op8_near_dedup": op8_near_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_host_rules": op10_host_rules,
    "pipeline": pipeline,
}
