"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed reliably: in the folder that spark.checkpoint.dir names, else (local runs and tests) in a temporary one."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        at = sc.getConf().get("spark.checkpoint.dir", "")
        if not at and sc.master.partition("[")[0] != "local":
            raise ValueError("executors share no temporary folder: set spark.checkpoint.dir")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="platen-"))
    return df.checkpoint()
