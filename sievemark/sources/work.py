"""Results that are read more than once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder that the cluster shares (``spark.checkpoint.dir``).

    Where that is unset a local session gets a temporary folder; on a cluster it is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir", None) or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="sievemark-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()
