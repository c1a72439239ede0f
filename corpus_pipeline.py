"""The training-data pipeline: stages over documents, each written and read again before the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import stages
from docloom.session import shared_folder

STAGES = [
    ("toxicity", stages.toxicity),
    ("near_duplicates", stages.near_duplicates),
    ("suffix_array", stages.suffix_array),
    ("decontamination", stages.decontamination),
    ("packing", stages.packing),
]

#: None: a fitted classifier decides the first stage, and tokens fill the last one; SQL can express neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; the rows of the last one."""
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES, 1):
        place = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
