"""Cutting long plans where several later steps read one result."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(frame: DataFrame) -> DataFrame:
    """``frame`` written once to the session's ``spark.checkpoint.dir``.

    Lost executors then cost a read, and plans don't multiply. Only where that setting is
    missing and the session runs on one machine, a folder of that machine stands in for it.
    """
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or f"{tempfile.gettempdir()}/checkpoints/{context.applicationId}")
    return frame.checkpoint()
