"""Incremental ingest: a landing folder of parsed pages -> dedup -> analysis -> store, with Structured Streaming.

Micro-batches pull as much as the rate limit lets them (back-pressure); availableNow ends when all that landed is in. What
was seen is what the store holds, by its digests. A batch becomes visible together with its number, so one that is run again
after a failure is not added twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators.dedup import digest, first_seen
from gleaner.sources.store import Store

PAGES = "seq bigint, url string, title string, text string, status int"
NAME = "gleaner-ingest"


def read_pages(spark: SparkSession, path: str, schema: str = PAGES, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def unique_pages(pages: DataFrame) -> DataFrame:
    """Usable pages with a text not seen before in the stream."""
    usable = pages.where((F.col("status") == 200) & F.col("text").isNotNull())
    return usable.withColumn("digest", digest(F.col("text"))).dropDuplicates(["digest"])


def ingest(pages: DataFrame, store: Store, checkpoint: str, on_indexed: Callable[[int], None] | None = None, on_duplicate: Callable[[int], None] | None = None) -> StreamingQuery:
    """Start the stream (one at a time by its name); it ends when all that landed is indexed. on_indexed, on_duplicate: told
    the number of new and of known texts of each batch."""
    spark = pages.sparkSession
    if any(q.name == NAME for q in spark.streams.active):
        raise RuntimeError("an ingest is running")

    def add(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= store.last_batch(checkpoint):
            return
        usable = batch.where((F.col("status") == 200) & F.col("text").isNotNull()).withColumn("_at", F.struct("seq", "url"))
        new = first_seen(usable, "_at", seen=store.load().docs.select(F.col("content_hash").alias("digest")))
        n = store.append(new.select("seq", "url", "title", "text"), "seq", (checkpoint, batch_id))
        if on_indexed:
            on_indexed(n)
        if on_duplicate:
            on_duplicate(usable.count() - n)

    return pages.writeStream.queryName(NAME).foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def polite_fetch_times(requests: DataFrame, delay_s: float) -> DataFrame:
    """requests stream (host, url, at) -> (host, url, start_s): each host's clock is state, a fetch starts ``delay_s`` after
    the host's last."""
    import pandas as pd

    def step(key, batches, state):
        last = state.get[0] if state.exists else None
        for batch in batches:
            batch = batch.sort_values("at")
            starts = []
            for at in batch["at"]:
                last = at if last is None else max(at, last + delay_s)
                starts.append(last)
            yield pd.DataFrame({"host": key[0], "url": batch["url"].to_numpy(), "start_s": starts})
        if last is not None:
            state.update((float(last),))

    return requests.groupBy("host").applyInPandasWithState(step, "host string, url string, start_s double", "last double", "append", "NoTimeout")
