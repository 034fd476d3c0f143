"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .avi import text_media
from .common import documents
from .cotraining import fit_quality, with_quality
from .forest import nearest
from .lines import WIDE, dedup_lines
from .mixing import OP2_SQL, mix
from .packing import pack
from .passages import passage_digest
from .sharding import shard_slots
from .simhash import near_duplicates
from .toxicity import fit_toxicity, held_out, with_toxicity


def op8_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_slots(documents(spark, sf_dir), shards=24)


def op2_hash_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", taken)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), capacity=2048)


def op6_pigeonring_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=4, limit=4)


def op9_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


def op10_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_quality(docs, model)
    return scored.select("doc_id", "quality_score", (F.col("quality_score") >= 0.5).alias("keep"))


def op5_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_toxicity(docs, model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "toxic_by_language",
    )


def op7_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(documents(spark, sf_dir))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return dedup_lines(docs, limit=WIDE, least_words=1, counts=("n_lines", "n_removed"), runs=True)


def op3_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_digest(documents(spark, sf_dir), width=400)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_hash_mixing": op2_hash_mixing,
    "op3_run_length_index": op3_run_length_index,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_toxicity_cnn": op5_toxicity_cnn,
    "op6_pigeonring_simhash": op6_pigeonring_simhash,
    "op7_avi_media": op7_avi_media,
    "op8_jump_sharding": op8_jump_sharding,
    "op10_cotrained_quality": op10_cotrained_quality,
    "op9_projection_forest": op9_projection_forest,
}

ORACLE_SQL: dict[str, str] = {
    "op2_hash_mixing": OP2_SQL,
}
