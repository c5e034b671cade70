"""Tables between steps, where a plan would hold its beginning many times over."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df computed once and written as Parquet to spark.checkpoint.dir, which survives lost executors; its plan begins anew there.

    Where the setting is unset, a single machine takes a folder of its own, and a
    cluster fails.  DataFrame.checkpoint would run the last stage twice, and
    write rows as they lie in memory.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="strandline-"))
    path = f"{context.getCheckpointDir()}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
