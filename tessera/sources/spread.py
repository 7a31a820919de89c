"""Giving small inputs enough partitions."""

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Shuffles an input that is read from fewer files than the cluster has cores.

    A table of many files is returned as it is. Only names of files are looked at; nothing is run.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
