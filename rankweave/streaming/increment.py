"""Document frequencies kept up to date as documents arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.corpus_stats import df_local, tokenized
from ..spec import CorpusSpec


def compacted(parts: DataFrame) -> DataFrame:
    return parts.groupBy("stripe", "term").agg(F.sum("df").alias("df"))


def maintain(documents: DataFrame, path: str, checkpoint: str, spec: CorpusSpec = CorpusSpec(), once: bool = True) -> StreamingQuery:
    """Write the document frequencies of every micro-batch under ``path``, one folder a batch.

    A batch that is run again after a failure overwrites its own folder, so it counts once. Readers sum the folders
    (``compacted``); nothing is rewritten as the corpus grows.
    """

    def write(batch: DataFrame, number: int) -> None:
        df_local(tokenized(batch, spec)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_latency(events: DataFrame, ts: str, value: str, keys: list[str], width: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Count, mean and maximum per tumbling window of event time; rows later than ``late`` behind the newest are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("largest"))
