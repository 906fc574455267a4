"""Results that a plan reads more than once, kept in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(rows: DataFrame) -> DataFrame:
    """The rows as a checkpoint: planned and computed once, and still there when an executor is lost.

    The folder is that of ``spark.checkpoint.dir``; one of our own is made only on a local master where none is set.
    """
    sc = rows.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        there = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not there:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            there = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(there)
    return rows.checkpoint()
