"""Count-based tumbling segments of ordered rows, in batch and as a stream with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomstone.sources.shared import scratch

SIZE = 16
OUT = "user_id long, seg long, n long, cents long, last long"


def _cents():
    return F.round(F.col("value") * 100).cast("long")


def batch_segments(events: DataFrame, size: int = SIZE) -> DataFrame:
    """(user_id, seg, n, cents, last): each user's events in order, in full segments of `size`."""
    seg = F.floor((F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1) / size)
    grouped = events.withColumn("seg", seg).groupBy("user_id", "seg").agg(F.count("*").alias("n"), F.sum(_cents()).alias("cents"), F.max("event_id").alias("last"))
    return grouped.where(F.col("n") == size)


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: number of segments closed, and the open segment's ids and cents. A micro-batch's rows
    come in no order, so they are sorted; an id below the last closed one, or none, is an error."""
    done, last, ids, cents = state.get if state.exists else (0, None, [], [])
    new = pd.concat([x for x in batches if len(x)], ignore_index=True)[["event_id", "cents"]]
    if new["event_id"].isna().any():
        raise ValueError(f"user {key[0]}: an event without an event_id has no place in the order")
    if last is not None and (new["event_id"] < last).any():
        raise ValueError(f"user {key[0]}: event {new['event_id'].min()} came after the segment that ends with {last} was closed")
    ids = np.concatenate([np.array(ids, np.int64), new["event_id"].to_numpy(np.int64)])
    cents = pd.concat([pd.Series(cents, dtype="Int64"), new["cents"].astype("Int64")], ignore_index=True)
    order = np.argsort(ids, kind="stable")
    n = len(ids) // SIZE
    full, rest = order[: n * SIZE].reshape(n, SIZE), order[n * SIZE :]
    ends = ids[full[:, -1]]
    sums = pd.Series(cents.fillna(0).to_numpy(np.int64)[full].sum(axis=1), dtype="Int64").where(cents.notna().to_numpy()[full].any(axis=1))
    state.update((done + n, int(ends[-1]) if n else last, ids[rest].tolist(), [None if c is pd.NA else int(c) for c in cents.iloc[rest]]))
    yield pd.DataFrame({"user_id": [key[0]] * n, "seg": np.arange(done, done + n), "n": SIZE, "cents": sums, "last": ends})


def segment_stream(events: DataFrame) -> DataFrame:
    """events: a streaming DataFrame with user_id, event_id and value, whose micro-batches follow each other in event_id order."""
    keyed = events.select("user_id", "event_id", _cents().alias("cents")).groupBy("user_id")
    return keyed.applyInPandasWithState(_update, OUT, "done long, last long, ids array<long>, cents array<long>", "append", GroupStateTimeout.NoTimeout)


def stream_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Runs the stream over all that the events table holds now, into a Parquet sink, and reads that."""
    at = scratch(spark, "segments")
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    # A stream reads folders: the glob takes the one table, be it a file or a folder of files. These are in no order
    # of event_id, so there is no limit of files a trigger: all that the table holds is one micro-batch.
    events = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/events.parquet*")
    query = segment_stream(events).writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{at}/rows")
