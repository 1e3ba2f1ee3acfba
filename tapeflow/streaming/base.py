"""Helpers shared by the streaming jobs."""

from __future__ import annotations

import heapq
import pickle
import tempfile
import uuid
from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tapeflow.session import checkpoint_dir, prepare

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare_streaming(spark: SparkSession) -> SparkSession:
    """State lives in RocksDB on the executors, checkpointed to shared storage."""
    prepare(spark).conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


def file_stream(spark: SparkSession, folder: str, schema, pattern: str, files_per_trigger: int = 64) -> DataFrame:
    """Landed Parquet files as a stream; a broker source gives the same columns."""
    return (
        prepare_streaming(spark).readStream.schema(schema).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    )


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, path: str | None = None, checkpoint: str | None = None, mode: str = "append") -> DataFrame:
    """Process what is available into Parquet and read it back."""
    spark = stream.sparkSession
    path = path or new_folder(spark, "stream-out")
    writer = stream.writeStream.option("checkpointLocation", checkpoint or new_folder(spark, "stream-cp")).trigger(availableNow=True)
    writer.outputMode(mode).format("parquet").start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_batches(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str | None = None, mode: str = "append"
) -> None:
    """Process what is available through ``handle(batch, batch_id)``."""
    spark = stream.sparkSession
    (
        stream.writeStream.option("checkpointLocation", checkpoint or new_folder(spark, "stream-cp"))
        .trigger(availableNow=True).outputMode(mode).foreachBatch(handle).start().awaitTermination()
    )


def gather(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame | None:
    """All rows of one key in one trigger, in order; a trigger is bounded by its source limits."""
    frames = [b for b in batches if len(b)]
    if not frames:
        return None
    return pd.concat(frames, ignore_index=True).sort_values(order, kind="mergesort").reset_index(drop=True)


#: Rows of one key that a worker sorts at once, and rows of one piece of a sorted run on disk.
HELD_ROWS, PIECE_ROWS = 50_000, 500


def in_order(batches: Iterable[pd.DataFrame], order: list[str]) -> Iterator[tuple]:
    """All rows of one key in one trigger as named tuples in order, ties as they came, nulls last.

    More than ``HELD_ROWS`` are sorted in runs, written to a temporary file of the worker and merged, so that memory does not
    grow with the rows of a key.
    """
    held: list[pd.DataFrame] = []
    runs: list[list[int]] = []
    with tempfile.TemporaryFile() as file:
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= HELD_ROWS:
                rows = list(gather(iter(held), order).itertuples(index=False, name=None))
                places = []
                for a in range(0, len(rows), PIECE_ROWS):
                    places.append(file.seek(0, 2))
                    pickle.dump(rows[a : a + PIECE_ROWS], file, pickle.HIGHEST_PROTOCOL)
                runs.append(places)
                names, held = list(batch.columns), []
        last = gather(iter(held), order)
        if not runs:
            yield from last.itertuples(index=False, name="Event") if last is not None else ()
            return
        at = [names.index(c) for c in order]

        def read(places: list[int]) -> Iterator[tuple]:
            for place in places:
                file.seek(place)
                yield from pickle.load(file)

        def key(row: tuple) -> list[tuple]:
            return [(True, 0) if row[i] is None or row[i] != row[i] else (False, row[i]) for i in at]

        streams = [read(places) for places in runs]
        if last is not None:
            streams.append(last[names].itertuples(index=False, name=None))
        yield from map(namedtuple("Event", names)._make, heapq.merge(*streams, key=key))
