"""Parquet table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """Give heavy per-row work at least one task per core.

    Only a scan with fewer splits than cores (a small file), or with fewer row groups than cores (a split
    without the middle of a row group reads nothing), is redistributed; other tables are returned unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits < cores:
        return df.repartition(cores)
    return df.repartition(-(-splits // cores) * cores) if _row_groups(df, cores) < cores else df


def _row_groups(df: DataFrame, enough: int) -> int:
    """Row groups of the files read, counted from their footers until there are enough."""
    files = df.inputFiles()
    if len(files) >= enough:
        return len(files)
    context = df.sparkSession.sparkContext
    jvm, settings, found = context._jvm, context._jsc.hadoopConfiguration(), 0
    for file in files:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, settings))
        found += reader.getRowGroups().size()
        reader.close()
        if found >= enough:
            break
    return found


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
