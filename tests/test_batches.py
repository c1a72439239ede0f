"""Memory of a Python worker goes by the batch, whatever the table."""

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__


def _prepared(spark):
    return __spark_entry__._prepared(lambda session, folder: session.range(3000, numPartitions=1))(spark, "")


def test_batches_are_bounded_by_rows(spark):
    rows = _prepared(spark).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n bigint").collect()
    assert sum(r.n for r in rows) == 3000 and max(r.n for r in rows) <= 500


def test_batches_of_long_rows_are_bounded_by_bytes(spark):
    @F.pandas_udf("bigint")
    def held(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    long_texts = _prepared(spark).withColumn("text", F.repeat(F.lit("x"), F.lit(100_000)))
    assert long_texts.select(held("text").alias("n")).agg(F.max("n")).first()[0] <= 5 << 20
    vectors = _prepared(spark).withColumn("v", F.array_repeat(F.lit(1.0), 10_000))
    sizes = F.pandas_udf(lambda v: pd.Series([len(v)] * len(v)), "bigint")
    assert vectors.select(sizes("v").alias("n")).agg(F.max("n")).first()[0] <= 60
