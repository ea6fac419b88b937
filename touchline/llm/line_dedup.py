"""Line dedup over all documents.

Every line's key is hashed to 128 bits. The hashes are range-partitioned and sorted by (hash,
document, position); one streaming pass per partition marks every occurrence outside the first
document. The range covers the document and position too, so a line that a third of all
documents hold is spread over as many partitions as it needs. A run that a partition boundary
cuts is settled afterwards from one row per partition. What comes back is one compressed keep
bitmap per document that loses lines; text never takes part in the shuffle of the hashes.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from touchline.llm.common import OWN, bytes_of, shuffle_tasks, stored, value_slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# What counts as white space around a line (fixed by the contract).
BLANKS = b" \t\n\x0b\x0c\r"
MIN_CHARS = 10
# Every code point takes at most four bytes: a key this long need not be counted.
_SURELY_LONG = 4

DECIDED, CLAIM, PENDING = 0, 1, 2


def line_key(line: bytes) -> bytes:
    """Stripped of white space, A-Z lower-cased (bytes.lower changes ASCII letters only)."""
    return line.strip(BLANKS).lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    if len(key) < min_chars:
        return False
    return len(key) >= _SURELY_LONG * min_chars or len(key.decode("utf-8", "replace")) >= min_chars


def _occurrences(min_chars: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in value_slices(batch):
                digests, rows, parts, positions = [], [], [], []
                for row, text in enumerate(bytes_of(piece.column(1))):
                    if not text:
                        continue
                    part = zlib.crc32(text)
                    for pos, line in enumerate(text.split(b"\n")):
                        key = line_key(line)
                        if _long_enough(key, min_chars):
                            digests.append(xxhash.xxh3_128_digest(key))
                            rows.append(row)
                            parts.append(part)
                            positions.append(pos)
                halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.ascontiguousarray(halves[:, 0])),
                        pa.array(np.ascontiguousarray(halves[:, 1])),
                        piece.column(0).take(pa.array(rows, pa.int64())),
                        pa.array(parts, pa.int64()),
                        pa.array(positions, pa.int32()),
                    ],
                    schema=schema,
                )

    return run


def _changes(column: pa.Array, before: pa.Array | None) -> np.ndarray:
    """Per row whether its value differs from the row before it; nulls equal one another."""
    joined = pa.concat_arrays([before, column]) if before is not None else column
    if len(joined) < 2:
        return np.zeros(len(joined) if before is None else len(joined) - 1, dtype=bool)
    here, prior = joined[1:], joined[:-1]
    differs = pc.fill_null(pc.not_equal(here, prior), False)
    differs = pc.or_(differs, pc.xor(here.is_null(), prior.is_null()))
    flags = differs.to_numpy(zero_copy_only=False)
    return flags if before is not None else np.concatenate([[False], flags])


def _first_document_stays(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of one partition, sorted by (hash, document, part, position) → occurrences to drop.

    The partition's first run may go on from the partition before: occurrences in its first
    document are PENDING. The first and last run leave a CLAIM with the first document seen.
    """

    def rows(batch: pa.RecordBatch, mask: np.ndarray, kind: int, with_hash: bool) -> pa.RecordBatch:
        taken = batch.filter(pa.array(mask))
        n = taken.num_rows
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, kind, dtype=np.int8)),
                taken.column(0) if with_hash else none,
                taken.column(1) if with_hash else none,
                taken.column(2),
                taken.column(3),
                taken.column(4),
            ],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[pa.Array] | None = None  # hash halves and document of the row before
        moved_on = False  # the open run has left its first document
        first_run = True
        opening: pa.RecordBatch | None = None  # first row of the open run
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            h1, h2, doc = (_changes(batch.column(i), last[i] if last else None) for i in range(3))
            starts = h1 | h2
            at_start = last is None
            if at_start:
                starts[0] = True
            new_doc = np.cumsum(doc & ~starts)
            run_of = np.cumsum(starts)  # 0: the run left open by the batch before
            base = np.concatenate([[0], new_doc[starts]])
            later = new_doc > base[run_of]
            if moved_on:
                later |= run_of == 0
            in_first = run_of == (1 if at_start else 0) if first_run else np.zeros(n, dtype=bool)
            yield rows(batch, later, DECIDED, False)
            if in_first.any():
                yield rows(batch, in_first & ~later, PENDING, True)
            if at_start:
                claim = np.zeros(n, dtype=bool)
                claim[0] = True
                yield rows(batch, claim, CLAIM, True)
            first_run = first_run and bool(in_first[-1])
            if starts.any():
                opening = batch.slice(int(np.flatnonzero(starts)[-1]), 1)
            moved_on = bool(later[-1])
            last = [batch.column(i)[n - 1 : n] for i in range(3)]
        if opening is not None:
            yield rows(opening, np.ones(1, dtype=bool), CLAIM, True)

    return run


def pack_bits(positions: list[int] | np.ndarray) -> bytes:
    """Keep bitmap up to the last dropped line (1 keeps), compressed; later lines all stay."""
    keep = np.ones((int(max(positions)) // 8 + 1) * 8, dtype=np.uint8)
    keep[np.asarray(positions)] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def dropped_lines(bitmap: bytes | None) -> list[int]:
    if bitmap is None:
        return []
    return np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8)) == 0).tolist()


@F.arrow_udf(T.BinaryType())
def _bitmap(positions: pa.Array) -> pa.Array:
    return pa.array([pack_bits(p) for p in positions.to_pylist()], pa.binary())


_KEPT = T.StructType(
    [
        T.StructField("n_lines", T.LongType()),
        T.StructField("n_dropped", T.LongType()),
        T.StructField("kept_text", T.StringType()),
    ]
)


@F.arrow_udf(_KEPT)
def _kept(text: pa.Array, bitmap: pa.Array) -> pa.Array:
    out = []
    for value, bits in zip(text.to_pylist(), bitmap.to_pylist()):
        lines = (value or "").split("\n")
        drop = set(dropped_lines(bits))
        kept = "\n".join(line for pos, line in enumerate(lines) if pos not in drop) if drop else value or ""
        out.append({"n_lines": len(lines), "n_dropped": len(drop), "kept_text": kept})
    return pa.array(out, pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_text", pa.string())]))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, part, bitmap) of every document that loses lines; ``part`` is the CRC-32 of its text.

    Rows with one id are one document: none of them loses a line to another. A null id is a
    document too, and the smallest. Null or empty texts have no line that could be dropped.
    """
    spark = docs.sparkSession
    tasks = shuffle_tasks(spark)
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = named.schema["id"].dataType
    found = T.StructType(
        [T.StructField(n, T.LongType()) for n in ("h1", "h2")]
        + [T.StructField("id", id_type), T.StructField("part", T.LongType()), T.StructField("pos", T.IntegerType())]
    )
    arrow_id = to_arrow_type(id_type)
    fields = [("h1", pa.int64()), ("h2", pa.int64()), ("id", arrow_id), ("part", pa.int64()), ("pos", pa.int32())]
    occurrences = named.mapInArrow(_occurrences(min_chars, pa.schema(fields)), found)
    order = ["h1", "h2", "id", "part", "pos"]
    marked_type = T.StructType([T.StructField("kind", T.ByteType()), *found.fields])
    marked = stored(
        occurrences.repartitionByRange(tasks, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(_first_document_stays(pa.schema([("kind", pa.int8()), *fields])), marked_type),
        "line-dedup",
    )
    owner = F.struct(F.col("id").isNotNull().alias("given"), F.col("id"))
    first = marked.where(F.col("kind") == CLAIM).groupBy("h1", "h2").agg(F.min(owner).alias("first"))
    settled = (
        marked.where(F.col("kind") == PENDING)
        .join(first, ["h1", "h2"])
        .where(owner > F.col("first"))
        .select("id", "part", "pos")
    )
    dropped = marked.where(F.col("kind") == DECIDED).select("id", "part", "pos").unionByName(settled)
    return dropped.groupBy("id", "part").agg(_bitmap(F.collect_set("pos")).alias("bitmap"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text; columns of these names are replaced.

    Lines are split at \\n; a null or empty text is one empty line. A key found in two documents
    or more loses its lines everywhere but in the smallest id that holds it. Rows that repeat an
    id come back once each, and only lines of smaller ids are taken out of them.
    """
    bitmaps = keep_bitmaps(docs, id_col, text_col, min_chars).select(
        F.col("id").alias(f"{OWN}id"), F.col("part").alias(f"{OWN}part"), F.col("bitmap").alias(f"{OWN}bitmap")
    )
    part = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    joined = docs.join(
        bitmaps, F.col(id_col).eqNullSafe(F.col(f"{OWN}id")) & (part == F.col(f"{OWN}part")), "left"
    ).withColumn(f"{OWN}kept", _kept(F.col(text_col), F.col(f"{OWN}bitmap")))
    return joined.withColumns({f.name: F.col(f"{OWN}kept.{f.name}") for f in _KEPT}).drop(
        f"{OWN}id", f"{OWN}part", f"{OWN}bitmap", f"{OWN}kept"
    )
