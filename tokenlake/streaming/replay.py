"""Runs a streaming query over a table that is already there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame


def replay(table: DataFrame, query: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Writes the table to the shared folder, streams it from there until all is read, and returns what the query wrote.

    Source, sink and state lie below the session's checkpoint folder, so any executor can go on where another was lost.
    """
    spark = table.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tokenlake-")
    folder = f"{root.rstrip('/')}/replay-{uuid.uuid4().hex}"
    table.write.parquet(f"{folder}/in")
    out = query(spark.readStream.schema(table.schema).parquet(f"{folder}/in"))
    run = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
