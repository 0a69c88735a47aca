"""Routing of a stream of queries against a static catalogue.

Routing is a narrow map of rows, so it needs neither watermark nor state; it works on a streaming
DataFrame as it does on a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Router


def route_stream(router: Router, queries: DataFrame, sink: str, checkpoint: str, **route) -> StreamingQuery:
    """Append routed rows of a streaming (query_id, query) to Parquet at ``sink``, once for each input file or batch."""
    return router.route(queries, **route).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
