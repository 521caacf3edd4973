"""Tables that several later steps read are computed once, into the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, without its lineage. The folder is the session's ``spark.checkpoint.dir``; only a
    session without one (a local test) gets a temporary folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="seqloom-checkpoints-"))
    return df.checkpoint(eager=True)
