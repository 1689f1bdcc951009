"""A training corpus from documents: quality, near duplicates, decontamination, mixing, token files."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import decontaminate, mixing, near_dup, quality, token_store
from tarn.llm.common import discard, materialize, recording, relieve
from tarn.llm.queries import tokenizer_path


_made: list[str] = []  # scratch tables of stages that have been written


def stage(function):
    """A stage that first deletes the scratch tables of the stages before (their results are written by
    now), but for those that its own input still reads, and lets go of what the driver kept for them."""

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(_made, unless=docs)
        relieve(spark)
        with recording(_made):
            return function(spark, docs, sf_dir)

    return run


@stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels, prefix="_judged_").filter("_judged_keep").select(*docs.columns)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dup.keep_one(docs)


@stage
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them."""
    return mixing.mix_rows(docs)


@stage
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and the index read back from them."""
    return token_store.encode_and_index(docs, tokenizer_path())


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources", mix_sources),
    ("token output", write_tokens),
]

#: Token ids and the classifier's model are not SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
