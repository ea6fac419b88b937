"""Approximate nearest neighbours by shifted space-filling curves.

Vectors get one extra component that turns the largest inner product into the smallest distance,
are rotated at random, and their first projected components are shifted and numbered along a
Hilbert curve. Spark sorts all vectors along every curve (range partitions). Neighbouring runs of
fixed length (windows) hold what may be near; queries compare with their own window and the two
beside it. The windows of all curves merge, and what they found is ranked by the exact measure.

The number of curves is not guessed: a sample of queries is searched exhaustively, and curves are
added (and, if many do not help, windows doubled) until the recall on the sample is reached.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from touchline.llm.common import shuffle_tasks, stored
from touchline.llm.vectors import matrix, one_per_id

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CURVES = 8  # of one round
DIMS, BITS = 6, 8
# A further curve costs a shuffle of all vectors, a wider window arithmetic only: windows are wide.
WINDOW = 2048
SAMPLE = 128
RECALL = 0.95


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of points given by ``bits``-bit cell numbers (rows are points).

    The corner of every cell is turned level by level (Gray code), then the bits are interleaved.
    """
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i, axis in enumerate(axes):
            set_ = (axis >> level) & 1 == 1
            swap = np.where(set_, 0, (axes[0] ^ axis) & low)
            axes[0] = np.where(set_, axes[0] ^ low, axes[0] ^ swap)
            if i:
                axes[i] = axis ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(len(cells), dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    key = np.zeros(len(cells), dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ turn) >> level) & 1)
    return key


class Curve:
    """A random rotation of ``dim + 1`` components cut to DIMS, and a random shift of the grid."""

    def __init__(self, number: int, dim: int, reach: float):
        random = np.random.default_rng([20260, number])
        self.axes = np.linalg.qr(random.normal(size=(dim + 1, dim + 1)))[0][:, : min(DIMS, dim + 1)]
        self.shift = random.uniform(0.0, 1.0, size=self.axes.shape[1])
        # Projections of a rotated vector spread about reach / sqrt(dim): the grid covers four of these to either side.
        self.scale = max(reach, 1e-300) * 4.0 / np.sqrt(dim + 1)

    def keys(self, rows: np.ndarray) -> np.ndarray:
        side = 1 << BITS
        spot = (rows @ self.axes / self.scale + 1.0) / 2.0 * (side / 2) + self.shift * (side / 2)
        return hilbert_keys(np.clip(np.floor(spot), 0, side - 1).astype(np.int64), BITS)


def _keyed(curves: range, reach: float, is_query: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column("vec"))
            if not len(rows):
                continue
            rest = np.zeros(len(rows)) if is_query else np.sqrt(np.maximum(reach * reach - np.sum(rows * rows, axis=1), 0.0))
            wide = np.column_stack([rows, rest])
            for number in curves:
                key = Curve(number, rows.shape[1], reach).keys(wide)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(key), number, dtype=np.int32)),
                        pa.array(key),
                        pa.array(np.full(len(key), is_query)),
                        batch.column("id"),
                        batch.column("vec"),
                    ],
                    names=["curve", "key", "query", "id", "vec"],
                )

    return run


def _numbered(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a sorted partition with the number of candidates before each on its curve and in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            curve, query = batch.column("curve").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
            before = np.zeros(len(curve), dtype=np.int64)
            for number in np.unique(curve):
                here = curve == number
                counted = np.cumsum(~query[here])
                before[here] = counted - ~query[here] + seen.get(number, 0)
                seen[number] = seen.get(number, 0) + (int(counted[-1]) if len(counted) else 0)
            columns = [*batch.columns, pa.array(np.full(len(curve), task, dtype=np.int32)), pa.array(before)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def best_of(scores: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``keep`` highest scores of each row; equal scores at the edge all stay."""
    if scores.shape[1] > keep:
        edge = np.partition(scores, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep]
        return np.nonzero(scores >= edge[:, None])
    return np.nonzero(np.ones(scores.shape, dtype=bool))


def _products(left: np.ndarray, right: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Inner products of chosen pairs, added up in one fixed order."""
    return np.sum(left[row] * right[column], axis=1)


def _window_search(keep: int) -> Callable[[pa.Table], pa.Table]:
    def run(window: pa.Table) -> pa.Table:
        window = window.combine_chunks()
        is_query = window.column("query").to_numpy()
        asked, offered = (window.filter(pa.array(flag)) for flag in (is_query, ~is_query))
        query_id, ids = asked.column("id").to_numpy(), offered.column("id").to_numpy()
        out: list[list[np.ndarray]] = [[query_id[:0]], [ids[:0]], [np.empty(0)]]
        if len(query_id) and len(ids):
            left, right = (matrix(t.column("vec").combine_chunks()) for t in (asked, offered))
            for at in range(0, len(left), 512):
                row, column = best_of(left[at : at + 512] @ right.T, keep)
                out[0].append(query_id[at : at + 512][row])
                out[1].append(ids[column])
                out[2].append(_products(left[at : at + 512], right, row, column))
        return pa.table(dict(zip(("query_id", "uid", "score"), map(np.concatenate, out))))

    return run


def _search_round(points: DataFrame, queries: DataFrame, curves: range, reach: float, window: int, keep: int) -> DataFrame:
    spark = points.sparkSession
    vec = points.schema["vec"].dataType
    kind = T.StructType(
        [
            T.StructField("curve", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("query", T.BooleanType()),
            T.StructField("id", T.LongType()), T.StructField("vec", vec),
        ]
    )
    both = (
        points.select("id", "vec").mapInArrow(_keyed(curves, reach, False), kind)
        .unionByName(queries.select("id", "vec").mapInArrow(_keyed(curves, reach, True), kind))
    )
    wide = T.StructType([*kind.fields, T.StructField("task", T.IntegerType()), T.StructField("before", T.LongType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in wide.fields])
    order = ["curve", "key", "query", "id"]
    ranged = both.repartitionByRange(shuffle_tasks(spark), *order).sortWithinPartitions(*order)
    sorted_ = stored(ranged.mapInArrow(_numbered(arrow), wide), "search-curves")
    earlier = Window.partitionBy("curve").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sorted_.groupBy("curve", "task").agg(F.sum((~F.col("query")).cast("long")).alias("held"))
    starts = starts.select("curve", "task", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("start"))
    placed = sorted_.join(F.broadcast(starts), ["curve", "task"])  # a row for each task and curve
    block = F.floor((F.col("before") + F.col("start")) / window)
    seen_by = F.when(F.col("query"), F.array(block - 1, block, block + 1)).otherwise(F.array(block))
    windows = placed.select("curve", F.explode(seen_by).alias("block"), "query", "id", "vec")
    return windows.groupBy("curve", "block").applyInArrow(_window_search(keep), "query_id long, uid long, score double")


def _exhaustive(shared, keep: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_id, left = shared.value
        for batch in batches:
            right = matrix(batch.column("vec"))
            if len(right):
                row, column = best_of(left @ right.T, keep)
                columns = [query_id[row], batch.column("id").to_numpy()[column], _products(left, right, row, column)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "uid", "score"])

    return run


def _top(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "uid")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep).drop("place")


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    window: int = WINDOW,
    recall: float = RECALL,
    sample: int = SAMPLE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` largest inner products among the other ids found.

    Equal vectors are one point that carries its ``k + 1`` smallest ids, more can never be
    wanted; so copies of one vector take one place in a window, however many they are. Vectors
    that are null, zero, not finite or of another length than most take no part, nor do null ids;
    of rows that repeat an id the smallest vector counts. The sample is ``sample`` queries at most,
    drawn by a hash of the id.
    """
    spark = vectors.sparkSession
    rows = one_per_id(vectors, id_col, vector_col)
    asked = stored(one_per_id(queries, id_col, vector_col), "search-queries")
    by_id = Window.partitionBy("vec").orderBy("id")
    members = stored(
        rows.withColumn("place", F.row_number().over(by_id)).withColumn("uid", F.min("id").over(by_id)).where(F.col("place") <= k + 1),
        "search-members",
    )
    points = members.where("place = 1").select("id", "vec")
    squared = F.aggregate("vec", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    reach = float(np.sqrt(points.agg(F.max(squared)).first()[0] or 0.0))
    keep = k + 1

    drawn = asked.orderBy(F.xxhash64("id"), "id").limit(sample).collect()  # bounded by ``sample``
    truth = None
    if drawn:
        shared = spark.sparkContext.broadcast((np.array([r["id"] for r in drawn]), np.array([r["vec"] for r in drawn], dtype=np.float64)))
        whole = points.mapInArrow(_exhaustive(shared, keep), "query_id long, uid long, score double")
        truth = stored(_top(whole, keep), "search-truth")
        wanted = truth.count()
    found, first = None, 0
    while True:
        some = _search_round(points, asked, range(first, first + CURVES), reach, window, keep)
        some = some if found is None else some.unionByName(found)
        found = stored(_top(some.distinct(), keep), "search-found")
        if truth is None or truth.join(found, ["query_id", "uid"], "left_semi").count() >= recall * wanted:
            break
        first += CURVES
        if first % (4 * CURVES) == 0:
            window *= 2
    own = members.select("uid", F.col("id").alias("vec_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.join(own, "uid")
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
