"""Where intermediate results go."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df computed once, in the folder that spark.checkpoint.dir names (a temporary one only where it is unset)."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="glotmill-"))
    return df.checkpoint(eager=True)
