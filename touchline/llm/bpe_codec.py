"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are read in blocks of bounded size. A block keeps, for every document, the positions of its
pre-tokens as numbers of the block's distinct words. The distinct words alone are shuffled, by a
hash of the word, so that every occurrence of a word in the corpus meets in one bucket and is
encoded there once; the ids travel back to the blocks and are put in the places of the words.
Rows of the shuffles are lists of words or ids of one (block, bucket), not single words: a word
that every text holds is in a row of each block, spread over the bucket's stream.
Decoding joins the ids with the table of token bytes: the table, of the size of the vocabulary, is sent
to every task and the ids are joined where they are, in order, so neither ids nor bytes are shuffled.
"""

from __future__ import annotations

import hashlib
import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import zstandard
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from touchline.llm.bpe import Ranks, chunks, encoding, little_endian
from touchline.llm.common import shuffle_tasks, stored_by, value_slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A block ends after the text that takes it over this many characters.
BLOCK_CHARS = 4_000_000
CACHED_LENGTH = 48


def _squeezed(*arrays: np.ndarray | bytes) -> bytes:
    parts = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    sizes = np.array([len(parts), *map(len, parts)], dtype="<u8").tobytes()
    return zstandard.ZstdCompressor(level=9).compress(sizes + b"".join(parts))


def _parts(squeezed: bytes) -> list[bytes]:
    whole = zstandard.ZstdDecompressor().decompress(squeezed)
    head = 8 + 8 * int.from_bytes(whole[:8], "little")
    ends = np.cumsum(np.frombuffer(whole[8:head], dtype="<u8")).astype(int) + head
    return [whole[a:b] for a, b in zip([head, *ends[:-1].tolist()], ends.tolist())]


def _planes(values: np.ndarray) -> list[bytes]:
    """Numbers as byte planes, as many as the largest needs."""
    count = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return [(values >> np.uint32(8 * k)).astype(np.uint8).tobytes() for k in range(count)]


def _from_planes(planes: list[bytes]) -> np.ndarray:
    values = np.zeros(len(planes[0]), dtype="<u4")
    for k, plane in enumerate(planes):
        values |= np.frombuffer(plane, dtype=np.uint8).astype("<u4") << np.uint32(8 * k)
    return values


class _Chunks(dict):
    """Numbers of the words of a chunk, within one block."""

    def __init__(self, pattern: str):
        super().__init__()
        self.words: dict[str, int] = {}
        self.find = regex.compile(pattern).findall

    def __missing__(self, chunk: str) -> bytes:
        words = self.words
        numbers = little_endian([words.setdefault(w, len(words)) for w in self.find(chunk)], "<u4")
        if len(chunk) <= CACHED_LENGTH:
            self[chunk] = numbers
        return numbers


def _blocks(pattern: str, buckets: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def closed(ids: list[pa.Array], counts: list[int], numbers: list[bytes], seen: _Chunks) -> pa.RecordBatch:
        words = [w.encode() for w in seen.words]
        alphabetical = np.array(sorted(range(len(words)), key=words.__getitem__), dtype=np.int64)  # neighbours share beginnings
        bucket = np.array([zlib.crc32(w) % buckets for w in words], dtype=np.int64)
        order = alphabetical[np.argsort(bucket[alphabetical], kind="stable")]  # words of a bucket get neighbouring numbers
        renumbered = np.empty(len(words), dtype="<u4")
        renumbered[order] = np.arange(len(words))
        # In the sequence the most frequent words have the smallest numbers, which squeezes best.
        sequence = np.frombuffer(b"".join(numbers), dtype="<u4")
        frequent = np.argsort(-np.bincount(sequence, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), dtype="<u4")
        rank[frequent] = np.arange(len(words))
        lists = []
        for start, stop in zip(*_runs(bucket[order])):
            some = [words[i] for i in order[start:stop]]
            packed = _squeezed(*_planes(np.array([len(w) for w in some], dtype="<u4")), b"".join(some))
            lists.append({"bucket": int(bucket[order[start]]), "words": packed})
        columns = [[pa.concat_arrays(ids).to_pylist()], [counts], [_squeezed(*_planes(rank[sequence]))], [_squeezed(*_planes(renumbered[frequent]))], [lists]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, numbers, seen, size = [], [], [], _Chunks(pattern), 0
        for batch in batches:
            for piece in value_slices(batch, 64):
                ids.append(piece.column(0))
                for text in piece.column(1).to_pylist():
                    found = b"".join([seen[chunk] for chunk in chunks(text)]) if text else b""
                    counts.append(len(found) // 4)
                    numbers.append(found)
                    size += len(text or "")
                if size >= BLOCK_CHARS:
                    yield closed(ids, counts, numbers, seen)
                    ids, counts, numbers, seen, size = [], [], [], _Chunks(pattern), 0
        if ids:
            yield closed(ids, counts, numbers, seen)

    return run


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) place of every run of equal values."""
    if not len(values):
        return np.empty(0, dtype=int), np.empty(0, dtype=int)
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return starts, np.append(starts[1:], len(values))


def _encode_words(shared, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(block, bucket, words), sorted by bucket → (block, bucket, ids). Every distinct word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece_ids = encoding(shared.value, pattern)._encode_single_piece
        known: dict[bytes, list[int]] = {}
        bucket = None
        for batch in batches:
            out = []
            for number, words in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist()):
                if number != bucket:
                    bucket, known = number, {}
                *sizes, text = _parts(words)
                ends = np.cumsum(_from_planes(sizes), dtype=np.int64).tolist()
                found = []
                for start, end in zip([0, *ends[:-1]], ends):
                    word = text[start:end]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = piece_ids(word)
                    found.append(ids)
                flat = np.array([i for ids in found for i in ids], dtype="<u4")
                sizes = _planes(np.array([len(ids) for ids in found], dtype="<u4"))
                out.append(_squeezed(bytes([len(sizes)]), *sizes, *_planes(flat)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("bucket"), pa.array(out, pa.binary())], names=["block", "bucket", "word_ids"]
            )

    return run


def _reassemble(id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, counts, squeezed, order, lists = (batch.column(c)[row] for c in ("ids", "counts", "sequence", "order", "lists"))
                sequence = _from_planes(_parts(order.as_py()))[_from_planes(_parts(squeezed.as_py()))]
                lengths, flat = [], []
                for entry in sorted(lists.as_py() or (), key=lambda e: e["bucket"]):
                    count, *parts = _parts(entry["word_ids"])
                    lengths.append(_from_planes(parts[: count[0]]))
                    flat.append(_from_planes(parts[count[0] :]))
                length = np.concatenate(lengths or [np.empty(0, dtype="<u4")]).astype(np.int64)
                word_ids = np.concatenate(flat or [np.empty(0, dtype="<u4")])
                begin = np.cumsum(length) - length
                ends = np.cumsum(np.array(counts.as_py(), dtype=np.int64))
                names = pa.array(doc_ids.as_py(), id_type)
                for first in range(0, len(ends), 256):
                    out, last = [], min(first + 256, len(ends))
                    for at in range(first, last):
                        words = sequence[ends[at - 1] if at else 0 : ends[at]]
                        n = length[words]
                        shift = np.repeat(begin[words] - (np.cumsum(n) - n), n)
                        out.append(word_ids[shift + np.arange(len(shift))].astype(np.int32))
                    yield pa.RecordBatch.from_arrays([names[first:last], pa.array(out, pa.list_(pa.int32()))], names=["id", "ids"])

    return run


def encode(
    docs: DataFrame, ranks: Ranks, id_col: str = "doc_id", text_col: str = "text", pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """(id, ids): the ids of every whole text, without special tokens. A null or empty text has none.

    Texts are read whole, however long. Rows that repeat an id come back once each; other columns are
    not read, so none can clash. An empty table comes back empty.
    """
    spark = docs.sparkSession
    tasks = shuffle_tasks(spark)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = plain.schema["id"].dataType
    lists = T.ArrayType(T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("words", T.BinaryType())]))
    block_type = T.StructType(
        [
            T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("counts", T.ArrayType(T.LongType())),
            T.StructField("sequence", T.BinaryType()),
            T.StructField("order", T.BinaryType()),
            T.StructField("lists", lists),
        ]
    )
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in block_type.fields])
    blocks = plain.mapInArrow(_blocks(pattern, 2 * tasks, arrow), block_type).withColumn("block", F.monotonically_increasing_id())
    blocks = stored_by(blocks, "block", tasks, "bpe-blocks")  # their positions are not shuffled
    words = blocks.select("block", F.explode("lists").alias("list")).select("block", "list.bucket", "list.words")
    encoded = (
        words.repartition(tasks, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_encode_words(spark.sparkContext.broadcast(ranks), pattern), "block long, bucket int, word_ids binary")
        .groupBy("block")
        .agg(F.collect_list(F.struct("bucket", "word_ids")).alias("lists"))  # at most one entry a bucket
    )
    whole = blocks.select("block", "ids", "counts", "sequence", "order").join(encoded, "block", "left")
    out_type = T.StructType([T.StructField("id", id_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return whole.mapInArrow(_reassemble(to_arrow_type(id_type)), out_type)


def decode(spark: SparkSession, ids: Column, ranks: Ranks) -> Column:
    """Bytes of an array of ids; null stays null, an id outside the vocabulary is an error."""
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    shared = spark.sparkContext.broadcast(table)

    @F.arrow_udf(T.BinaryType())
    def looked_up(column: pa.Array) -> pa.Array:
        tokens = pa.array(shared.value, pa.large_binary())
        out = []
        for first in range(0, len(column), 128):
            some = column.slice(first, 128)
            found = tokens.take(some.flatten())
            ends = np.frombuffer(found.buffers()[1], dtype=np.int64, count=len(found) + 1, offset=8 * found.offset)
            data = found.buffers()[2]
            data = memoryview(data) if data is not None else b""
            sizes = np.array([n or 0 for n in some.value_lengths().to_pylist()], dtype=np.int64)
            stops = ends[np.cumsum(sizes)].tolist()
            starts = [int(ends[0]), *stops[:-1]]
            out += [bytes(data[a:b]) if v else None for a, b, v in zip(starts, stops, some.is_valid().to_pylist())]
        return pa.array(out, pa.binary())

    return looked_up(ids)


@F.arrow_udf(T.StringType())
def ids_sha256(column: pa.Array) -> pa.Array:
    """SHA-256 of the ids as little-endian unsigned 32-bit integers."""
    out = []
    for value in column:
        ids = value.values.to_numpy(zero_copy_only=False).astype("<u4") if value.is_valid else None
        out.append(None if ids is None else hashlib.sha256(ids.tobytes()).hexdigest())
    return pa.array(out, pa.string())
