"""Classification of reads as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import classify
from ..operators.index import MinimizerIndex


def classify_stream(reads: DataFrame, index: MinimizerIndex, path: str, checkpoint: str, trigger: dict | None = None, **options) -> StreamingQuery:
    """Append each micro-batch of a stream of reads, classified, to a Parquet table at path.

    A read's spans come from one row, so a batch needs no state of another.
    Batches are written to a folder of their number: one that is repeated
    after a failure replaces what it had written.
    """

    def put(batch: DataFrame, number: int) -> None:
        out = classify.classify(batch, index, **options)
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = reads.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def arrivals(reads: DataFrame, time: str, delay: str, window: str) -> DataFrame:
    """window, reads, letters of a stream of reads with an arrival time; late rows wait for `delay`."""
    t = reads.withWatermark(time, delay).groupBy(F.window(time, window).alias("window"))
    return t.agg(F.count(F.lit(1)).alias("reads"), F.sum(F.length("nucleotides")).alias("letters"))
