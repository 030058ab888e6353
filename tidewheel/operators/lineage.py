"""Ends of lineage: rows written to the shared folder, from which plans and recovery begin anew."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in spark.checkpoint.dir. Where none is set and all run on one machine (tests), a temporary
    folder; on a cluster that is an error, since executors would write where no other one reads."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="tidewheel-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
