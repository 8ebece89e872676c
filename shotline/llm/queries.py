"""The thin queries over the text tables: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import licence_scan

    return licence_scan(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import kd_shards

    out = kd_shards(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op5_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import score, train

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(~held_out), F.col("quality"))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against its own history with the next one's last reply."""
    from .chat_format import borrowed_replies, preference_pairs

    return preference_pairs(borrowed_replies(table(spark, sf_dir, "conversations")), F.col("pair_id"), F.col("chosen"), "id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import shared_dir
    from .warc import read_warc, write_warc

    folder = f"{shared_dir(spark)}/shotline-warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import with_rules

    own = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return with_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*own)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import without_repeats

    found = without_repeats(table(spark, sf_dir, "documents"))
    n_removed, n_spans = F.col("n_bytes") - F.length("kept_bytes"), F.size("spans").cast("long")
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), n_spans.alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, of which one in ten has a period of its own put into its later words."""
    from .common import let, words
    from .periodic_runs import longest_run, with_runs

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("w")
    docs = docs.select("doc_id", words(F.col("text")).alias("w"))
    a = g % n
    docs = docs.withColumn("a", F.when((h % 10 == 0) & (n > 0), a)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    planted = let(F.col("w"), lambda w: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, at(i))))
    found = with_runs(docs.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("w")).alias("w")), F.col("w")).drop("w")
    line = lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])
    text = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    found = found.withColumn("best", longest_run())
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_decontamination": op2_decontamination,
    "op3_kd_shards": op3_kd_shards,
    "op4_html_text": op4_html_text,
    "op5_entropy_mix": op5_entropy_mix,
    "op6_quality_model": op6_quality_model,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_preference_pairs": op8_preference_pairs,
    "op9_warc": op9_warc,
    "op10_quality_rules": op10_quality_rules,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_lexical_search": op12_lexical_search,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op7_near_duplicates": sql.NEAR_DUPLICATES,
    "op8_preference_pairs": sql.PREFERENCE_PAIRS,
    "op9_warc": sql.WARC,
    "op10_quality_rules": sql.QUALITY_RULES,
    "op12_lexical_search": sql.LEXICAL_SEARCH,
    "op13_periodic_runs": sql.PERIODIC_RUNS,
}
