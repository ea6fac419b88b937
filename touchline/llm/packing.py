"""Packing: mixture-controlled windows by deficit round-robin over source queues.

Every source is a queue of documents. In each window (round) a queue earns its share of the window
as quantum and serves the documents that its credit covers; what is left, or still missing for a
long document, is carried to the next window. A document whose end lies at token c of its queue is
therefore served in window ceil(c / quantum) - 1: two running sums place every document without
any queue being walked by one task, and deficits carry over windows and partitions alike.

The stream of windows is cut every ``capacity`` tokens, so no sequence has padding; the rest at its
end is cut into powers of two.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from touchline.llm.bpe import Ranks, added_pattern, chunks, encoding, json_ranks, little_endian, public_path  # noqa: F401
from touchline.llm.common import shuffle_tasks, stored, value_slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 2048
WINDOW_SEQUENCES = 64
CACHED_CHUNKS = 600_000
CACHED_LENGTH = 48


class ChunkIds(dict):
    """Little-endian 16- or 32-bit ids of a chunk."""

    def __init__(self, ranks: Ranks, width: str):
        super().__init__()
        self.encode = encoding(ranks).encode_ordinary
        self.width = width

    def __missing__(self, chunk: str) -> bytes:
        ids = little_endian(self.encode(chunk), self.width)
        if len(chunk) <= CACHED_LENGTH:
            if len(self) >= CACHED_CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids


def id_width(ranks: Ranks, end_id: int) -> str:
    most = max(end_id, *ranks.values(), *getattr(ranks, "added", {}).values(), 0)
    return "<u2" if most < 65536 else "<u4"


def _tokenise(shared, end_id: int, width: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = ChunkIds(shared.value, width)
        added = getattr(shared.value, "added", {})
        at_added = added_pattern(added)

        def ids_of_text(text: str) -> bytes:
            if at_added is None or at_added.search(text) is None:
                return b"".join([ids_of[chunk] for chunk in chunks(text)])
            parts = at_added.split(text)  # every second part is an added token
            return b"".join(
                little_endian([added[part]], width) if odd % 2 else b"".join([ids_of[chunk] for chunk in chunks(part)])
                for odd, part in enumerate(parts)
                if part
            )

        end = np.array([end_id], dtype=width).tobytes()
        for batch in batches:
            for piece in value_slices(batch):
                ids = []
                for text in piece.column(1).to_pylist():
                    ids.append(ids_of_text(text) + end if text else end)
                counts = [len(x) // int(width[2]) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(2), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                    names=["id", "source", "n", "ids"],
                )

    return run


def _local_sums(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            sums = np.cumsum(batch.column("n").to_numpy(), dtype=np.int64) + total
            total = int(sums[-1]) if len(sums) else total
            columns = [*batch.columns, pa.array(np.full(len(sums), task, dtype=np.int32)), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def running_sum(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with the sum of ``n`` up to and with each row, in the given order over all rows.

    One range shuffle; each partition adds up its own rows, and the totals of the partitions (one
    row per task) give the sum before each.
    """
    wide = T.StructType([*df.schema.fields, T.StructField("task", T.IntegerType()), T.StructField("local", T.LongType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in wide.fields])
    ranged = df.repartitionByRange(shuffle_tasks(df.sparkSession), *order).sortWithinPartitions(*order)
    summed = stored(ranged.mapInArrow(_local_sums(arrow), wide), "packing-sums")
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = summed.groupBy("task").agg(F.max("local").alias("total"))
    offsets = offsets.select("task", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    return summed.join(F.broadcast(offsets), "task").withColumn(name, F.col("local") + F.col("before")).drop("task", "local", "before")


def _quantum(weights: dict[str, float] | None, other_weight: float, window: int, all_tokens: int) -> Column:
    """Tokens a source earns in each window."""
    if weights is None:  # the mixture of the input
        return F.lit(float(window)) * F.col("source_tokens") / F.lit(float(max(1, all_tokens)))
    total = sum(weights.values()) or 1.0
    weight = F.lit(other_weight)
    for source, value in weights.items():
        weight = F.when(F.col("source") == source, F.lit(float(value))).otherwise(weight)
    return F.lit(float(window)) * weight / total


def placed(
    lengths: DataFrame,
    all_tokens: int,
    weights: dict[str, float] | None = None,
    other_weight: float = 1.0,
    window: int = WINDOW_SEQUENCES * CAPACITY,
) -> DataFrame:
    """(row, source, n), ``all_tokens`` in sum → window and place (tokens before the row in the whole stream)."""
    queued = running_sum(lengths, ["source", "row"], "upto")
    sources = queued.groupBy("source").agg(F.sum("n").alias("source_tokens"), F.min(F.col("upto") - F.col("n")).alias("source_start"))
    sources = sources.select(F.struct("source").alias("key"), "source_tokens", "source_start")
    served = (
        queued.withColumn("key", F.struct("source"))
        .join(sources, "key")
        .withColumn("in_source", F.col("upto") - F.col("source_start"))
        .withColumn("window", F.ceil(F.col("in_source") / _quantum(weights, other_weight, window, all_tokens) - 1e-9).cast("long") - 1)
        .select("row", "source", "n", "in_source", "window")
    )
    return running_sum(served, ["window", "source", "in_source"], "end").select(
        "row", "window", (F.col("end") - F.col("n")).alias("place")
    )


def sequence_ends(total: int, capacity: int) -> list[int]:
    """Ends of the sequences after the last full one: powers of two that add up to the rest."""
    full, ends = total // capacity * capacity, []
    rest = total - full
    at = full
    for power in reversed(range(rest.bit_length())):
        if rest >> power & 1:
            at += 1 << power
            ends.append(at)
    return ends


def _pieces(width: str, capacity: int, total: int, with_ids: bool, schema: pa.Schema):
    full = total // capacity
    ends = np.array([full * capacity, *sequence_ends(total, capacity)], dtype=np.int64)

    def cut(place: int, n: int) -> list[tuple[int, int, int]]:
        """(sequence, first, last) of every piece of the stream from place to place + n."""
        out, at, stop = [], place, place + n
        while at < stop:
            if at < ends[0]:
                number, end = at // capacity, (at // capacity + 1) * capacity
                begin = end - capacity
            else:
                tail = int(np.searchsorted(ends, at, side="right"))
                number, begin, end = full + tail - 1, int(ends[tail - 1]), int(ends[tail])
            last = min(stop, end)
            out.append((number, at, last, at - begin))
            at = last
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in value_slices(batch):
                rows, out, tokens = [], [], []
                for row, (place, n, ids) in enumerate(zip(*(piece.column(c).to_pylist() for c in ("place", "n", "ids")))):
                    wide = np.frombuffer(ids, dtype=width).astype("<u4")
                    for number, first, last, offset in cut(place, n):
                        part = wide[first - place : last - place]
                        rows.append(row)
                        out.append((first - place, last - first, zlib.crc32(part.tobytes()), n, number, offset))
                        if with_ids:
                            tokens.append(part.astype(np.int32))
                columns = zip(*out) if out else [()] * 6
                index = pa.array(rows, pa.int64())
                arrays = [piece.column("id").take(index), piece.column("source").take(index), piece.column("window").take(index)]
                arrays += [pa.array(c, pa.int64()) for c in columns]
                if with_ids:
                    arrays.append(pa.array(tokens, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def pack(
    docs: DataFrame,
    ranks: Ranks,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    capacity: int = CAPACITY,
    weights: dict[str, float] | None = None,
    other_weight: float = 1.0,
    window_sequences: int = WINDOW_SEQUENCES,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, source, window, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document is its text's ids (null: none) and ``end_id``; it may be cut at the end of a sequence
    only. Without ``weights`` every window gets the sources in the proportions of the whole input;
    else in those of the weights, as long as the queues last. A null source is a queue of its own.
    Added tokens of a :class:`Vocabulary` keep their ids wherever a text holds them. Rows that repeat
    an id are packed once each, texts whole, however long. Other columns are not read, so none can
    clash. An empty table gives no pieces.
    """
    spark = docs.sparkSession
    width = id_width(ranks, end_id)
    shared = spark.sparkContext.broadcast(ranks)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    id_field, source_field = plain.schema["id"], plain.schema["source"]
    tokens_type = T.StructType([id_field, source_field, T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])
    tokens = stored(
        plain.mapInArrow(_tokenise(shared, end_id, width), tokens_type).withColumn("row", F.monotonically_increasing_id()), "packing-tokens"
    )
    total = tokens.agg(F.sum("n")).first()[0] or 0
    places = placed(tokens.select("row", "source", "n"), total, weights, other_weight, window_sequences * capacity)
    out_type = T.StructType(
        [
            T.StructField(id_col, id_field.dataType),
            T.StructField("source", source_field.dataType),
            *(T.StructField(c, T.LongType()) for c in ("window", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")),
            *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []),
        ]
    )
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out_type.fields])
    return tokens.join(places, "row").mapInArrow(_pieces(width, capacity, total, with_ids, arrow), out_type)
