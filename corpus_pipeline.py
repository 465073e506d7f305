"""A corpus from documents to training sequences: five stages, each written as Parquet and read by the next.

Every stage but the last returns the columns of its input. Language ID drops
what it calls ``und`` and fills in missing labels; near-duplicate groups keep
one document; documents that hold a benchmark item go; secrets are replaced in
the text; what is left is packed into sequences.

Defined cases: a null text has no letter and goes with the language stage; rows
repeated whole are near-duplicates of each other; rows of one id with different
texts are told apart; a table without n_chars has none corrected; columns of
any other name pass through; empty tables give empty stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm import decontaminate, language_id, packing, secret_scan, simhash
from docframe.llm.common import drop_written, lean_batches, materialize, table


def plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table under names of the stage's own, so that no column of docs can clash with what a stage adds; old names to new ones."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean_batches(spark)
    own, at = plain(docs)
    net = language_id.fit(own.select(F.col(at["doc_id"]).alias("id"), F.col(at["text"]).alias("text"), F.col(at["lang"]).alias("lang")), F.lit(True))
    found = language_id.predict(own, net, own.columns, at["text"]).where("_lang <> 'und'")
    return found.withColumn(at["lang"], F.coalesce(at["lang"], "_lang")).select(*(F.col(n).alias(c) for c, n in at.items()))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean_batches(spark)
    return simhash.deduplicate(docs)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark")
    lean_batches(spark)
    return decontaminate.drop_leaks(docs, benchmark)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean_batches(spark)
    own, at = plain(docs)
    found = secret_scan.scan_secrets(own, at["text"], at["source"], at["doc_id"], keep=tuple(own.columns)).withColumn("_clean", secret_scan.redact(F.col(at["text"]), F.col("kept")))
    new = {"text": F.col("_clean")}
    if "n_chars" in at:
        new["n_chars"] = F.when(F.col("kept").isNotNull(), F.length("_clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(at["n_chars"]))
    return found.select(*(new.get(c, F.col(n)).alias(c) for c, n in at.items()))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean_batches(spark)
    return packing.pack_documents(docs, packing.vocabulary())


STAGES = [
    ("language_id", known_language),
    ("near_dedup", unique),
    ("decontaminate", clean_of_benchmarks),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: No stage of these has an SQL form as a whole; tests hold stages against brute force and run() against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES, start=1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = materialize(docs)
            drop_written(spark, but_last=1)  # what the stage and the one before wrote has been read
    return docs
