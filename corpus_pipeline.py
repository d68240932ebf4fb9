"""The corpus pipeline: STAGES over documents, each written as Parquet and read back.

1. quality rules: failing lines go, then documents that the rules reject;
2. SimHash near-dedup: of documents linked by five-word shingles of similarity 0.8 or
   more, the smallest id of each group stays;
3. substring dedup: runs of 50 words or more that stand in an earlier document are cut;
4. benchmark decontamination: documents holding a window of the benchmark go;
5. SentencePiece: each text's ids, and the text decoded from them.

Stages 1 to 4 return the columns of documents, with n_chars as the text is then; the last
returns doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and text (decoded).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenstrand.llm import decontaminate, pieces, quality, scratch, similar, substring


def _recount(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recount(quality.clean(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.drop_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recount(substring.remove_repeats(docs))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    both = pieces.round_trip(docs.select("doc_id", "text"), pieces.default_model())
    return both.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece", sentencepiece),
]
#: SQL can't express components or SentencePiece ids; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
