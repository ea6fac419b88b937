"""The scheduled page ingestion as an incremental file stream.

The batch jobs find new work through a high-water mark. A page folder can keep that mark in
the stream checkpoint instead: each run takes the pages that arrived since the last one and
stops (``availableNow``). Which match ids were seen lies in the stream's state store, in small groups of
ids, so no run reads what earlier ones wrote.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from touchline.sources.pages import SCRAPED_COLUMNS, extract_games

# Worker functions travel with the job: executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAGE_SCHEMA = "page_id bigint, url string, html string"
_KEYED = "match_id string, page_id bigint, pos bigint, record string"
# Calling Python costs more than looking at an id, so ids share calls and state: a run makes at most so many calls.
# Fixed for the life of a checkpoint.
ID_GROUPS = 8_192


def page_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet page files of a folder as a stream."""
    reader = spark.readStream.schema(PAGE_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def _first(frame: pd.DataFrame) -> pd.DataFrame:
    """The first record of every match id; null is one id."""
    return frame.sort_values(["page_id", "pos"], kind="stable").drop_duplicates("match_id")


def _first_of_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Before the shuffle: a very frequent id (null above all) leaves one row a batch of rows."""
    for frame in frames:
        yield _first(frame)


def _unseen(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The first record of every id of a group that no earlier batch of the stream held."""
    seen = list(state.get[0]) if state.exists else []
    known, best = set(seen), None
    for frame in frames:
        fresh = frame[[i not in known for i in frame["match_id"]]]
        best = _first(fresh if best is None else pd.concat([best, fresh]))
    if best is not None and len(best):
        state.update((seen + best["match_id"].tolist(),))
        yield best.drop(columns="_group")


def new_games(pages: DataFrame, kind: str, provider: str, dates: DataFrame | None = None) -> DataFrame:
    """A stream of the scraped records whose match id is new to the stream; null counts as one id.

    Of records that arrive together the first page and position counts.
    """
    games = extract_games(pages, kind, provider, dates)
    layout = games.select(*SCRAPED_COLUMNS).schema
    keyed = games.select("match_id", "page_id", F.col("pos").cast("bigint").alias("pos"), F.to_json(F.struct(*SCRAPED_COLUMNS)).alias("record"))
    first = keyed.mapInPandas(_first_of_batches, _KEYED)
    grouped = first.withColumn("_group", F.pmod(F.xxhash64("match_id"), F.lit(ID_GROUPS)))
    unseen = grouped.groupBy("_group").applyInPandasWithState(
        _unseen, _KEYED, "seen array<string>", "append", GroupStateTimeout.NoTimeout
    )
    return unseen.select(F.from_json("record", layout).alias("record")).select("record.*")


def ingest_new_pages(
    pages: DataFrame,
    kind: str,
    provider: str,
    target: str,
    checkpoint: str,
    dates: DataFrame | None = None,
) -> StreamingQuery:
    """Extract the new pages and append the first record of every match id to ``target``.

    A record whose match id an earlier batch holds is left out. Files and state are committed
    together with the batch, so a restart after a lost executor or driver adds nothing twice. A checkpoint
    whose state is by single id (of an earlier layout) cannot be continued. Ids are kept for good: for many of them set ``spark.sql.streaming.stateStore.providerClass`` to the
    RocksDB store. Read the result with ``spark.read.parquet(target)``.
    """
    return (
        new_games(pages, kind, provider, dates)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
