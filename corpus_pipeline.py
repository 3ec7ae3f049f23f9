"""Cleaning of a training corpus in five stages, each one operator over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet in the shared folder and
read again as the next one's docs.  The first four return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionlake.llm import toxicity
from motionlake.llm.common import cut, remove, scratch, table
from motionlake.llm.decontamination import contaminated
from motionlake.llm.minhash import near_duplicates
from motionlake.llm.queries import piece_model
from motionlake.llm.secrets_scan import find_secrets, redact
from motionlake.llm.sentencepieces import encode_documents


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.5 or more; a null or empty text has a clean one's score."""
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=toxicity.learnable)
    carried = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    return toxicity.score_documents(carried, scorer, keep=("row",)).where("score < 0.5").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates by five-word shingles: that of the smallest id.

    Documents without words are in no group and stay, as do rows with a null id; rows that repeat a
    kept id stay together.
    """
    gone = near_duplicates(docs).where("not kept and id is not null and n_shingles > 0").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a passage of a benchmark item."""
    gone = cut(contaminated(docs, table(spark, sf_dir, "benchmark")).where("id is not null").select(F.col("id").alias("doc_id")).distinct())
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With every secret's span replaced, and n_chars counted anew where that happened."""
    carried = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    found = find_secrets(carried, keep=("row",))
    hit = F.size("spans") > 0
    clean = found.withColumn("clean", redact(F.col("row.text"), F.col("spans")))
    new = {"text": F.col("clean"), "n_chars": F.when(hit, F.char_length("clean")).otherwise(F.col("row.n_chars"))}
    types = dict(docs.dtypes)
    return clean.select(*((new[c].cast(types[c]) if c in new else F.col("row")[c]).alias(c) for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids, byte offsets of the pieces' ends, decoded text's digest."""
    found = encode_documents(docs, piece_model(), outputs=("n_tokens", "ids", "ends", "decoded"))
    return found.select(F.col("id").alias("doc_id"), "n_tokens", "ids", "ends", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("sentencepiece", encode),
]

#: No stage can be expressed in SQL; tests hold each against a slow version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table goes once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
