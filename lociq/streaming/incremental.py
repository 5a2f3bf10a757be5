"""Summary statistics as they arrive: each new file is cleaned by the same rules as a table at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lociq.operators.clean import munge


def munge_stream(spark: SparkSession, folder: str, schema: str, ref: DataFrame, out: str, checkpoint: str, **options: float) -> StreamingQuery:
    """Clean every Parquet file that appears in a folder and append it to ``out``; ends when all that is there is done.

    A micro-batch is a frame at rest, so that the median that tells odds ratios is taken over it. Batches are
    written under their number: one that is repeated after a failure replaces itself.
    """

    def clean(batch: DataFrame, number: int) -> None:
        munge(batch, ref, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return source.writeStream.foreachBatch(clean).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
