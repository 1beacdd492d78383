"""Apply plans fitted on batch data to a stream.

Every plan is a stateless projection, so it runs unchanged on `readStream` input; only
aggregation and splitting plans, which group or join, are for batch use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from martloom.operators.plan import Plan
from martloom.session import scratch_path


def write_applied(stream: DataFrame, plan: Plan, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Append the transformed rows of everything available now to a Parquet table.

    A job that is to resume after a failure passes its own lasting checkpoint folder.
    """
    checkpoint = checkpoint or scratch_path(stream.sparkSession, "stream")
    return (
        plan.apply(stream)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
