"""From raw documents to token ids: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents; where a stage shortens a
text, n_chars follows. Repeated rows of one id and text count as copies and leave one row.

Defined results: null, empty and short texts go with the first stage (under 50 words); rows without an id are documents that come
last in every choice by id; an empty table gives an empty one and an empty benchmark hits nothing; further columns pass through,
and what the stages add gives way where a column has its name (a leading underscore).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidenceloom.llm import bpe, decontaminate, linededup, quality, simhash
from evidenceloom.llm.columns import free
from evidenceloom.llm.queries import table, tokenizer_files
from evidenceloom.llm.shared import written


def _as_documents(df: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """df's rows in docs' columns, with another column as the text; rows whose text is gone go."""
    new = F.col(f"`{text}`")
    columns = {"text": new.alias("text"), "n_chars": F.length(new).cast("long").alias("n_chars")}
    return df.where(new.rlike(r"[^\x20\x09-\x0D]")).select(*(columns.get(c, F.col(f"`{c}`")) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the rules' posterior or the hard limits reject goes."""
    return quality.judge(docs).where(F.col(free(docs, "kept"))).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go from the texts, and so do documents of nothing else."""
    return _as_documents(linededup.dedupe(docs), docs, free(docs, "kept_text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays: the one with the smallest id."""
    found, comp, group = simhash.similar(docs), free(docs, "component_id"), free(docs, "component_key")
    kept = written(found.where(F.col("doc_id").eqNullSafe(F.col(comp))).select(*docs.columns, group), "kept")
    # rows that repeat an id of a group; most tables have none, and then no text is moved for them
    again = kept.groupBy("doc_id", group).count().where("count > 1").select(F.col("doc_id").alias("r"), F.col(group).alias("g"))
    if again.isEmpty():
        return kept.drop(group)
    same = kept["doc_id"].eqNullSafe(F.col("r")) & kept[group].eqNullSafe(F.col("g"))
    once = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", group])
    return kept.join(again, same, "left_anti").unionByName(once).drop(group)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in benchmark windows are cut out of the texts."""
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    return _as_documents(found, docs, free(docs, "kept_text"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its token ids, and whether they decode to its text."""
    files = tokenizer_files()
    ids, raw = free(docs, "token_ids"), free(docs, "decoded")
    decoded = bpe.encode(docs, files.ranks, files.pattern, then=(bpe.decoding(files.ranks, ids),))
    same = F.col(raw) == F.col("text").cast("binary")
    new = {"n_tokens": F.size(ids).cast("long"), "token_ids": F.col(ids), "round_trip": same}
    return decoded.select(*docs.columns, *(c.alias(free(docs, n)) for n, c in new.items()))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: Expectation-maximisation and BPE merges can't be said in SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None
