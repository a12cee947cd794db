"""Helpers shared by the operators: tables, bounded lookups, lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: A lookup table above this many rows is no lookup table.
LOOKUP_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup_rows(df: DataFrame, limit: int = LOOKUP_ROWS) -> list[Row]:
    """All rows of a fixed lookup table; raises if it has more than ``limit``, so that nothing that grows gets to the driver."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a lookup table may have {limit} rows at most")
    return rows


def shared_folder(spark: SparkSession) -> str:
    """The folder of the session's spark.checkpoint.dir, which all executors share.

    Where that is unset, as in local tests, a temporary folder is used; a cluster must name a shared one.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir", "")
        if not folder:
            if not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = "file://" + os.path.join(tempfile.gettempdir(), "spanloom-checkpoints")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in shared_folder.

    Spark removes it once ``df`` is collected where spark.cleaner.referenceTracking.cleanCheckpoints is set; else it stays with the folder.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out to all cores if it is a scan of fewer partitions than there are cores, as files of one row group give; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():  # to count its partitions would run it
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def heavy_keys(df: DataFrame, *key: str, most: int = 64, least: int = 10_000) -> list[int]:
    """Hashes of the ``most`` most frequent values of ``key`` at most, by a sketch over all rows, that have ``least`` rows or more. For salted_join."""
    top = df.select(F.xxhash64(*key).alias("h")).agg(F.expr(f"approx_top_k(h, {most}, {16 * most})").alias("top")).first().top
    return [x["item"] for x in top or [] if x["count"] >= least]


def salted_join(left: DataFrame, right: DataFrame, key: list[str], heavy: list[int], how: str = "inner", salts: int = 64) -> DataFrame:
    """``left`` joined to ``right`` by ``key``: rows of ``left`` whose key is heavy, or null, spread over ``salts`` partitions, and the few rows of ``right`` that meet them are repeated there.

    ``heavy`` is a bounded list of heavy_keys; which keys are in it changes no result. ``how`` is inner, left or left_semi. ``right`` should be unique by key.
    """
    hot: Column = F.xxhash64(*key).isin(heavy) if heavy else F.lit(False)
    lacking: Column = F.lit(False)
    for c in key:
        lacking = lacking | F.col(c).isNull()
    share = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    a = left.withColumn("__salt", F.when(hot | lacking, share).otherwise(F.lit(0)))
    b = right.withColumn("__salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return a.join(b, [*key, "__salt"], how).drop("__salt")
