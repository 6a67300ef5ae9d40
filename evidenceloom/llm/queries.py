"""The registered queries: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, chat, decontaminate, linededup, maxent, merkle, mixing, quality, simhash, substrings, tokenfile, warc


def tokenizer_files() -> SimpleNamespace:
    """Places of the public vocabulary files of the installation, and the pre-token pattern."""
    import public_tokenizers as p

    return SimpleNamespace(words=p.path("word_bpe_49k.json"), ranks=p.path("byte_bpe_50k.tiktoken"), pattern=p.PATTERN)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenfile.round_trip(docs, tokenizer_files().words, end_id=2)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedupe(docs).drop("text")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    n_items = F.size("items").cast("long").alias("n_items")
    return found.select("doc_id", "n_words", "n_hit", n_items, F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenizer_files()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, files.ranks, files.pattern)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, keep=["doc_id"])


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model learns from the roles of four fifths of the conversations; the turns of all are recovered from the texts alone.

    held_out marks those that it did not learn from, by which its accuracy is to be judged.
    """
    turns = table(spark, sf_dir, "conversations")
    held = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    model = chat.Model.from_counts(chat.count_labelled(turns.where(~held)))
    return chat.parse(turns.drop("role"), model).withColumn("held_out", held)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).drop("text")


def op11_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.plan(docs).select("doc_id", "size", "source_size", "target", "taken")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_maxent, op2_token_file, op3_substrings, op4_line_dedup, op5_decontaminate, op6_byte_bpe, op7_warc, op8_simhash, op9_chat, op10_quality, op11_fair_mix, op12_centroids, op13_merkle)}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": linededup.SQL, "op5_decontaminate": decontaminate.SQL, "op7_warc": warc.SQL, "op11_fair_mix": mixing.SQL, "op12_centroids": centroids.SQL, "op13_merkle": merkle.SQL}
