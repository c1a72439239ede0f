"""Stages of the training-data pipeline: each takes (spark, docs, sf_dir) and returns documents, the last one pieces.

All columns of docs pass through, except that n_chars follows a text that a stage has changed. Rows are
judged one by one by their own text, also where a doc_id is null or shared; of rows that repeat a text one stays, while
null, empty and blank texts all stay. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import containment, ordinal, repeats, superminhash
from docloom.llm import packing as packer
from docloom.llm.tables import ready, table

#: A repeated passage that the pipeline removes has so many words, and so many bytes, which leave words of three letters room.
PASSAGE_WORDS, PASSAGE_BYTES = 50, 200
#: Bands of five rows miss a pair of texts at the threshold of 80 % with a chance of (1 - 0.8^5)^35, below one in a million.
BANDS = 35


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labelled ones among them, takes for toxic go."""
    ready(spark)
    model = ordinal.train(docs, table(spark, sf_dir, "labels"))
    return ordinal.severity(docs, model, docs.columns).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: one with the smallest doc_id, null last."""
    ready(spark)
    return superminhash.one_of_each(docs, bands=BANDS)


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of fifty words or more that occur more than once are cut out of all texts; the documents stay."""
    ready(spark)
    return repeats.cut_repeats(docs, PASSAGE_BYTES, PASSAGE_WORDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text contains a test item go."""
    ready(spark)
    return containment.clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, packed into windows."""
    ready(spark)
    return packer.pack(docs)
