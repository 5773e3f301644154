"""Bundles as they arrive in a folder: the same fact tables, continuously. Stateless, so restarts need the checkpoint only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import bundles

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, kind: str, layout: str | None = None, per_trigger: int = 64) -> DataFrame:
    """A streaming fact table of kind; per_trigger bounds the files of one micro-batch."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_trigger).load(path)
    return bundles.facts(files, kind, layout)


def keep(stream: DataFrame, target: str, checkpoint: str):
    """Append the stream to Parquet at target; each file's rows are written once."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
