"""Embedding near-dedup by NN-descent.

Every vector starts with neighbours from a few sign-hash orderings. In each round a vector sends
itself to its neighbours; at a neighbour all vectors that meet there are compared, and better
neighbours found that way replace worse ones. A center that many hold in their list is met in
tiles of bounded size, cut anew in each round. Beside better neighbours a meeting gives a spanning
forest of its pairs at or above the threshold, so what it links stays linked whatever a list's
length is. A list that holds near copies only is saturated: it is enlarged to all vectors
of its component, compared in tiles of bounded size.

Rounds go on until one joins no two groups (an edge inside a group changes nothing). Then recall is
audited: vectors are drawn in blocks and compared with all rows until LINKED of them have few
links, or every vector was drawn. The share of drawn vectors whose links are all found must reach
the recall, for vectors of few and of many links separately; otherwise further orderings follow.

Equal vectors are one node with a count.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import shuffle_tasks, stored, value_slices
from touchline.llm.graph import components
from touchline.llm.vectors import matrix, one_per_id, unit

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COSINE = 0.95
NEIGHBOURS = 8
ORDERINGS, SIGNS, RUN = 4, 40, 64
ROUNDS = 3  # at least, before an audit
# Rows of the first and of the largest block of the audit, and vectors of few links that it waits for.
SAMPLE, LARGEST_SAMPLE, LINKED = 256, 4096, 64
RECALL = 0.97
# Links of the audit are above the threshold by more than rounding, so that each must be found.
ROUNDING = 1e-9
TILE_ROWS = 1024
MEET = 512  # rows that meet at a center, on average; more are cut into tiles


def _signed(first: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column("vec"))
            if not len(rows):
                continue
            for number in range(first, first + ORDERINGS):
                planes = np.random.default_rng([710, number]).normal(size=(rows.shape[1], SIGNS))
                code = ((rows @ planes > 0) @ (np.int64(1) << np.arange(SIGNS, dtype=np.int64))).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(code), number, dtype=np.int32)), pa.array(code), batch.column("id"), batch.column("vec")],
                    names=["ordering", "code", "id", "vec"],
                )

    return run


def _forest(linked: np.ndarray) -> np.ndarray:
    """A spanning forest of a symmetric relation, each edge in one direction."""
    kept = np.zeros_like(linked)
    unseen = linked.any(axis=1)
    for start in np.flatnonzero(unseen):
        if not unseen[start]:
            continue
        unseen[start] = False
        waiting = [start]
        while waiting:
            at = waiting.pop()
            new = np.flatnonzero(linked[at] & unseen)
            unseen[new] = False
            kept[at, new] = True
            waiting.extend(new)
    return kept


def _nearest(ids: np.ndarray, rows: np.ndarray, keep: int, threshold: float, bar: np.ndarray | None = None):
    """(a, b, cosine) for each row's ``keep`` nearest others, and a spanning forest of the pairs at or above the threshold.

    With ``bar``, only those of the nearest above the row's bar (the worst neighbour it has) come back.
    """
    cosine = np.clip(rows @ rows.T, -1.0, 1.0)
    np.fill_diagonal(cosine, -2.0)
    good = cosine > -2.0
    if cosine.shape[1] > keep + 1:
        best = np.argpartition(cosine, cosine.shape[1] - keep, axis=1)[:, -keep:]
        good = np.zeros_like(good)
        np.put_along_axis(good, best, True, axis=1)
    if bar is not None:
        good &= cosine > bar[:, None]
    linked = cosine >= threshold
    good |= _forest(linked | linked.T)
    a, b = np.nonzero(good)
    return ids[a], ids[b], cosine[a, b]


_EDGES = "a long, b long, cosine double"


def _table(a: list, b: list, cosine: list) -> dict[str, np.ndarray]:
    return {
        "a": np.concatenate(a) if a else np.empty(0, dtype=np.int64),
        "b": np.concatenate(b) if b else np.empty(0, dtype=np.int64),
        "cosine": np.concatenate(cosine) if cosine else np.empty(0),
    }


def _first_lists(keep: int, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Neighbours among each run of RUN rows of a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("id").to_numpy(), unit(matrix(batch.column("vec")))
            found = ([], [], [])
            for at in range(0, len(ids), RUN // 2):
                for column, values in zip(found, _nearest(ids[at : at + RUN], rows[at : at + RUN], keep, threshold)):
                    column.append(values)
            yield pa.RecordBatch.from_pydict(_table(*found))

    return run


def _orderings(points: DataFrame, first: int, keep: int, threshold: float) -> DataFrame:
    kind = T.StructType(
        [T.StructField("ordering", T.IntegerType()), T.StructField("code", T.LongType()), *points.select("id", "vec").schema.fields]
    )
    order = ["ordering", "code", "id"]
    signed = points.select("id", "vec").mapInArrow(_signed(first), kind)
    ranged = signed.repartitionByRange(shuffle_tasks(points.sparkSession), *order).sortWithinPartitions(*order)
    return ranged.mapInArrow(_first_lists(keep, threshold), _EDGES).where("a <> b")


def _local_join(keep: int, threshold: float) -> Callable[[pa.Table], pa.Table]:
    def run(met: pa.Table) -> pa.Table:
        met = met.combine_chunks()
        ids, bar = met.column("id").to_numpy(), met.column("bar").to_numpy()
        rows = unit(matrix(met.column("vec").combine_chunks()))
        return pa.table(_table(*([c] for c in _nearest(ids, rows, keep, threshold, bar))))

    return run


def _lists(edges: DataFrame, keep: int) -> DataFrame:
    """(a, near, bar): each vector's ``keep`` best neighbours and the cosine of the worst of them."""
    # Ranked row by row: a vector with any number of edges is no array of them.
    pairs = edges.repartition("a").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    order = Window.partitionBy("a").orderBy(F.desc("cosine"), F.desc("b"))
    best = pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
    ranked = best.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("cosine", "b")), asc=False).alias("near"))
    full = F.size("near") == keep
    return ranked.select("a", "near", F.when(full, F.element_at("near", -1)["cosine"]).otherwise(F.lit(-2.0)).alias("bar"))


def _meetings(lists: DataFrame, keep: int, number: int) -> DataFrame:
    """(a, center, tile): where each vector goes in round ``number``.

    A vector goes to its list, to itself, and to those that hold it in their list, but to no more
    than ``keep`` of the latter (its best). A center that more than MEET vectors go to is cut into
    tiles of about MEET by a hash that differs in each round; the center itself is in all of them.
    """
    forward = lists.select("a", F.explode("near").alias("to")).select("a", F.col("to.b").alias("center"), "to.cosine")
    order = Window.partitionBy("center").orderBy(F.desc("cosine"), F.desc("a"))
    backward = forward.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
    centers = (
        forward.select("a", "center")
        .unionByName(backward.select(F.col("center").alias("a"), F.col("a").alias("center")))
        .unionByName(lists.select("a", F.col("a").alias("center")))
        .distinct()
    )
    hubs = centers.groupBy("center").agg(F.count("*").alias("rows")).where(F.col("rows") > MEET)
    hubs = hubs.select("center", F.ceil(F.col("rows") / MEET).cast("int").alias("cuts"))
    cuts = F.coalesce("cuts", F.lit(1))
    mine = F.pmod(F.xxhash64("a", F.lit(number)), cuts).cast("int")
    tiles = F.when(F.col("a") == F.col("center"), F.sequence(F.lit(0), cuts - 1)).otherwise(F.array(mine))
    return centers.join(hubs, "center", "left").select("a", "center", F.explode(tiles).alias("tile"))


def _descend(points: DataFrame, lists: DataFrame, keep: int, threshold: float, number: int) -> DataFrame:
    """New edges from one round: neighbours of neighbours meet where both are near."""
    met = _meetings(lists, keep, number)
    sent = met.join(lists.select("a", "bar"), "a").join(points.select(F.col("id").alias("a"), "vec"), "a")
    return sent.withColumnRenamed("a", "id").groupBy("center", "tile").applyInArrow(_local_join(keep, threshold), _EDGES)


def _capped(new: DataFrame, old: DataFrame, keep: int) -> DataFrame:
    """Both lists' edges merged: the best of each vector."""
    flat = old.select("a", F.explode("near").alias("n")).select("a", "n.b", "n.cosine")
    return _lists(new.unionByName(flat), keep)


def _tile_links(threshold: float) -> Callable[[pa.Table], pa.Table]:
    def run(tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks()
        side = tile.column("side").to_numpy()
        ids, copies = tile.column("id").to_numpy(), tile.column("copies").to_numpy()
        rows = unit(matrix(tile.column("vec").combine_chunks()))
        diagonal = tile.column("row")[0].as_py() == tile.column("col")[0].as_py()
        left = np.flatnonzero(side == 1)
        right = left if diagonal else np.flatnonzero(side == 2)
        linked = rows[left] @ rows[right].T >= threshold
        if diagonal:
            np.fill_diagonal(linked, False)
            return pa.table({"id": ids[left], "links": linked @ copies[right]})
        parts = [(ids[left], linked @ copies[right]), (ids[right], linked.T @ copies[left])]
        return pa.table({"id": np.concatenate([p[0] for p in parts]), "links": np.concatenate([p[1] for p in parts])})

    return run


def _links_within(points: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """(id, links): links of every vector inside its component, counted tile by tile."""
    members = groups.withColumnRenamed("node", "id")
    cuts = members.groupBy("root").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("cuts"))
    mine = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")
    tiles = members.join(cuts, "root").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    tiles = tiles.select(
        "root", F.least("mine", "other").alias("row"), F.greatest("mine", "other").alias("col"),
        F.when(F.col("mine") <= F.col("other"), 1).otherwise(2).alias("side"), "id",
    )
    full = tiles.join(points.select("id", "vec", "copies"), "id")
    counted = full.groupBy("root", "row", "col").applyInArrow(_tile_links(threshold), "id long, links long")
    return counted.groupBy("id").agg(F.sum("links").alias("links"))


def _count_all(shared, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sample = shared.value
        total, near = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            for piece in value_slices(batch):
                rows = unit(matrix(piece.column("vec")))
                linked = (sample @ rows.T >= threshold + ROUNDING) & (ids[:, None] != piece.column("id").to_numpy()[None, :])
                total += linked @ piece.column("copies").to_numpy()
                near += linked.sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total), pa.array(near)], names=["id", "links", "near"])

    return run


def _audit(nodes: DataFrame, few: int, threshold: float) -> DataFrame | None:
    """(id, truth, low): the linked ones of the drawn vectors with all their links; low if at most ``few`` vectors are near."""
    spark, turn = nodes.sparkSession, F.xxhash64("id", F.lit("audit"))  # one-to-one on ids
    audit, low, last, size = None, 0, None, SAMPLE
    while low < LINKED:
        rest = nodes.withColumn("turn", turn)
        drawn = (rest if last is None else rest.where(F.col("turn") > last)).orderBy("turn").limit(size).collect()  # bounded
        if not drawn:
            break
        last, size = drawn[-1]["turn"], min(4 * size, LARGEST_SAMPLE)
        ids = np.array([r["id"] for r in drawn], dtype=np.int64)
        shared = spark.sparkContext.broadcast((ids, unit(np.array([r["vec"] for r in drawn], dtype=np.float64))))
        counted = nodes.mapInArrow(_count_all(shared, threshold), "id long, links long, near long")
        counted = counted.groupBy("id").agg(F.sum("links").alias("truth"), (F.sum("near") <= few).alias("low"))
        block = stored(counted.where("truth > 0"), "near-audit")
        low += block.where("low").count()
        audit = block if audit is None else audit.unionByName(block)
    return audit


def _found_whole(audit: DataFrame | None, links: DataFrame, recall: float) -> bool:
    """Whether enough of the audited vectors have all their links, among those of few and among those of many."""
    if audit is None:
        return True
    whole = (F.coalesce("links", F.lit(0)) >= F.col("truth")).cast("double")
    return all(r["share"] >= recall for r in audit.join(links, "id", "left").groupBy("low").agg(F.avg(whole).alias("share")).collect())


def _joined(groups: DataFrame | None, edges: DataFrame, threshold: float) -> tuple[DataFrame, bool]:
    """Groups (node, root) after these edges, and whether any edge joined two of them."""
    near = edges.where(F.col("cosine") >= threshold).select("a", "b")
    if groups is not None:
        for end in ("a", "b"):
            root = groups.select(F.col("node").alias(end), "root")
            near = near.join(root, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    near = near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    if groups is None:
        return components(near), True
    near = stored(near, "near-bridges")
    if near.isEmpty():
        return groups, False
    known = groups.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(known.unionByName(near)), True


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = COSINE,
    neighbours: int = NEIGHBOURS,
    recall: float = RECALL,
) -> DataFrame:
    """(id, n_links, component_id, kept), one row per id that is not null.

    n_links counts the other vectors at or above the threshold, copies included. A vector that is
    null, zero, not finite or of another length than most links with nothing and stays. Of rows
    that repeat an id the smallest usable vector counts.
    """
    rows = one_per_id(vectors, id_col, vector_col)
    nodes = stored(rows.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "near-nodes")
    twins = stored(rows.join(nodes.select("vec", F.col("id").alias("node"), "copies"), "vec").select("id", "node", "copies"), "near-twins")

    audit = _audit(nodes, neighbours, threshold)
    first, number, groups, lists = 0, 0, None, None
    while True:
        found = stored(_orderings(nodes, first, neighbours, threshold), "near-edges")
        groups, _ = _joined(groups, found, threshold)
        lists = stored(_lists(found, neighbours) if lists is None else _capped(found, lists, neighbours), "near-lists")
        done, grew = 0, True
        while done < ROUNDS or grew:
            new = stored(_descend(nodes, lists, neighbours, threshold, number), "near-edges")
            groups, grew = _joined(groups, new, threshold)
            lists = stored(_capped(new, lists, neighbours), "near-lists")
            done, number = done + 1, number + 1
        links = stored(_links_within(nodes, groups, threshold), "near-links")
        if _found_whole(audit, links, recall):
            break
        first += ORDERINGS
    per_node = groups.withColumnRenamed("node", "id").join(links, "id", "left")
    known = twins.withColumnRenamed("id", "vec_id").join(per_node.withColumnRenamed("id", "node"), "node", "left").select(
        "vec_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("root", "node").alias("component_id"),
    )
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id")).where("vec_id is not null").distinct()
    out = every.join(known, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        F.col("vec_id").alias("id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        (component == F.col("vec_id")).alias("kept"),
    )
