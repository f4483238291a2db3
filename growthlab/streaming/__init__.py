"""The operators that also run on streams.

The analysis itself is over finished experiments, so nothing here keeps state: rows are annotated as they come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from growthlab.operators import annotate_volume


def annotate_stream(rows: DataFrame, path: str, checkpoint: str, dialect: str = "day04") -> StreamingQuery:
    """Annotates a stream of measurement rows into Parquet, exactly once, until its present input ends."""
    out = annotate_volume(rows, dialect)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
