"""Curation and rule extraction over a folder that raw issues keep arriving in. Both are projections, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from threadloom.operators import curate, extract
from threadloom.sources.files import RAW_ISSUE

STREAM_SCHEMA = f"snapshot_id bigint, repository string, {RAW_ISSUE}"


def raw_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """JSON lines of raw issues as they arrive."""
    return spark.readStream.schema(STREAM_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)


def artifact_stream(raw: DataFrame) -> DataFrame:
    """Artifacts of the comments of each raw issue."""
    return extract.extract(curate.curate(raw, distinct=True))


def run_available(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived to parquet, exactly once per input file, and stop."""
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q
