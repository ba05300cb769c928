"""What the operators of this package share: results kept outside the lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder that the cluster names in spark.checkpoint.dir.

    Where that is unset, a temporary folder is used in local mode only (driver and executors are one process, as in tests); on a cluster it is an error."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp())
    return df.checkpoint()
