"""N-gram Jaccard join by parity sketches.

Every distinct word shingle is hashed once. XOR-ing the hashes into a sketch gives a vector whose
difference between two documents counts only shingles that one of them lacks: the Hamming
distance of two sketches is at most the size of the symmetric difference of the sets. A wanted
Jaccard value bounds that difference by D within a band of set sizes, so a sketch of more than D
words must agree in at least one (pigeonhole). The join runs on (band, word number, word value).
Candidates are checked against the bit parity sketch, and what is left against the whole sets.

Groups of copies do not make pairs: equal sets are one node; a word value held by many documents
is a block led by its smallest document; inside a block each document offers its nearest earlier
partners, and only pairs between groups that are still apart are offered after that.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import OWN, bytes_of, shuffle_tasks, stored, value_slices
from touchline.llm.graph import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CLAIM, MEMBER, OPEN = 1, 0, 2
# Rows of a block that one task compares at a time; larger blocks are cut into such tiles.
TILE_ROWS = 2048
NEAREST = 3
CACHED_WORDS = 300_000
# Most rows of ids that are broadcast: at some 40 bytes a row, 20 MB. More are joined by shuffle.
BROADCAST_ROWS = 500_000

_STEP = 0x9E3779B97F4A7C15
_M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective 64-bit mixing."""
    z = values + np.uint64((salt + 1) * _STEP & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * _M2
    z = (z ^ (z >> np.uint64(27))) * _M3
    return z ^ (z >> np.uint64(31))


@dataclass(frozen=True)
class Rule:
    """Sets of word ``width``-shingles link when den * |A & B| >= num * |A | B|."""

    width: int = 4
    num: int = 85
    den: int = 100

    def bands(self, largest: int) -> list[int]:
        """First set size of every band. Two sizes that can link lie in one band or in neighbours."""
        starts = [1]
        while starts[-1] <= largest:
            starts.append(starts[-1] * self.den**2 // self.num**2 + 1)
        return starts

    def difference(self, a: int, b: int) -> int:
        """Largest symmetric difference of linked sets of these sizes."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def band_difference(self, starts: list[int], band: int) -> int:
        """The same, when the smaller set lies in ``band``."""
        return (starts[band + 1] - 1) * (self.den - self.num) // self.num

    def words(self, difference: int) -> int:
        """Sketch words of a band: more than the difference, and some slack for empty ones."""
        return difference + 2 + difference // 8

    def bits(self, difference: int) -> int:
        """Bits of the parity sketch: several times the difference, so that few of them cancel."""
        return max(256, 1 << (8 * difference - 1).bit_length())

    def linked(self, shared: int, a: int, b: int) -> bool:
        return self.den * shared >= self.num * (a + b - shared)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z lower-cased, split at ASCII white space.

    A text with fewer words than ``width`` has its whole word sequence as one shingle; a text
    without words has none.
    """
    words = text.lower().split() if text else []  # bytes: only ASCII letters and white space are meant
    if not words:
        return np.empty(0, dtype=np.uint64)
    codes = np.array([hashes[w] for w in words], dtype=np.uint64)
    size = min(width, len(codes))
    rolled = np.full(len(codes) - size + 1, size, dtype=np.uint64)
    for at in range(size):
        rolled = _mix(rolled ^ codes[at : len(codes) - size + 1 + at], at + 1)
    return np.unique(rolled)


def sketch_words(shingles: np.ndarray, words: int, difference: int, place: int) -> np.ndarray:
    """Join keys of one sketch: the non-empty words, each mixed with its number and place.

    Linked sets agree in at least ``words - difference`` words. A set with fewer empty words than
    that is found by a non-empty one; a set with more also gives its empty words as keys, as any
    partner found only by them does.
    """
    number = ((shingles >> np.uint64(32)) * np.uint64(words)) >> np.uint64(32)  # ascending, as the shingles are
    first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    value = np.bitwise_xor.reduceat(_mix(shingles, 77), first)
    number = number[first]
    if words - len(number) >= words - difference:
        empty = np.setdiff1d(np.arange(words, dtype=np.uint64), number)
        number, value = np.concatenate([number, empty]), np.concatenate([value, np.zeros(len(empty), dtype=np.uint64)])
    return _mix(value ^ _mix(number, place)).view(np.int64)


def parity_sketch(shingles: np.ndarray, bits: int) -> bytes:
    """Bit b is the parity of the number of shingles hashed to b."""
    spots = (_mix(shingles, 99) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(spots, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _sketches(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(text) → per text its set size, fingerprint, and one sketch per band it can meet a partner in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        starts = rule.bands(1)
        for batch in batches:
            for piece in value_slices(batch):
                out: dict[str, list] = {"n": [], "f1": [], "f2": [], "keys": [], "sketches": []}
                for text in bytes_of(piece.column(1)):
                    shingles = shingle_set(text, rule.width, hashes)
                    n = len(shingles)
                    if starts[-1] <= n:
                        starts = rule.bands(n)
                    for name, salt in (("f1", 5), ("f2", 6)):
                        out[name].append(int(np.bitwise_xor.reduce(_mix(shingles, salt)).view(np.int64)) if n else 0)
                    out["n"].append(n)
                    meetings = _meetings(rule, starts, shingles) if n else []
                    for name in ("keys", "sketches"):
                        out[name].append([{"place": m["place"], name: m[name]} for m in meetings])
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        *(pa.array(out[k], pa.int64()) for k in ("n", "f1", "f2")),
                        pa.array(out["keys"], _meets("keys", pa.list_(pa.int64()))),
                        pa.array(out["sketches"], _meets("sketches", pa.binary())),
                    ],
                    names=["id", "n", "f1", "f2", "keys", "sketches"],
                )

    return run


def _meets(name: str, kind: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct([("place", pa.int32()), (name, kind)]))


def _meetings(rule: Rule, starts: list[int], shingles: np.ndarray) -> list[dict]:
    n = len(shingles)
    band = int(np.searchsorted(starts, n, side="right")) - 1
    smallest = -(-n * rule.num // rule.den)
    out = []
    for place in (band, band - 1) if band and smallest < starts[band] else (band,):
        most = rule.band_difference(starts, place)
        if most:  # else only equal sets link there, and these are one node
            keys = sketch_words(shingles, rule.words(most), most, place)
            out.append({"place": place, "keys": keys, "sketches": parity_sketch(shingles, rule.bits(most))})
    return out


_RUN_FIELDS = [("kind", pa.int8()), ("key", pa.int64()), ("leader", pa.int64()), ("uid", pa.int64()), ("place", pa.int32())]
_RUN_SCHEMA = "kind byte, key long, leader long, uid long, place int"


def _lead_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition of (key, uid, place), sorted by (key, uid) → (leader, member) of shared keys.

    The first and the last run may go on in a neighbouring partition: all their rows come out OPEN
    with their key, and each leaves a CLAIM with its first document.
    """
    schema = pa.schema(_RUN_FIELDS)

    def rows(kind: int, key: np.ndarray, leader: np.ndarray, uid: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        columns = [np.full(len(key), kind, dtype=np.int8), key, leader, uid, place]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    def one(value, like: np.ndarray) -> np.ndarray:
        return np.array([value], dtype=like.dtype)

    open_key = leader = first_key = None
    held: tuple | None = None  # the last row so far, not yet known to share its key
    for batch in batches:
        key, uid, place = (batch.column(i).to_numpy() for i in range(3))
        if not len(key):
            continue
        if first_key is None:
            first_key = key[0]
            yield rows(CLAIM, key[:1], uid[:1], uid[:1], place[:1])
        if held is not None:
            key, uid, place = (np.concatenate([one(h, c), c]) for h, c in zip(held, (key, uid, place)))
        start = np.concatenate([[True], key[1:] != key[:-1]])
        run = np.cumsum(start) - 1
        lead = uid[start][run]
        if key[0] == open_key:
            lead[run == 0] = leader
        shares = uid != lead  # a leader needs no row of its own
        in_first = key == first_key
        # The last row waits for the next batch: its run may turn out to be the partition's last.
        in_last = key == key[-1]
        done = ~in_last
        done_open = shares & in_first & done
        if done_open.any():
            yield rows(OPEN, key[done_open], lead[done_open], uid[done_open], place[done_open])
        plain = shares & ~in_first & done
        if plain.any():
            yield rows(MEMBER, key[plain], lead[plain], uid[plain], place[plain])
        # Rows of the open last run but its last one: which kind they are is known only at the end,
        # and OPEN is right either way.
        waiting = shares & in_last
        waiting[-1] = False
        if waiting.any():
            yield rows(OPEN, key[waiting], lead[waiting], uid[waiting], place[waiting])
        open_key, leader = key[-1], lead[-1]
        held = (key[-1], uid[-1], place[-1])
    if held is not None:
        key, uid, place = (np.array([h]) for h in held)
        place = place.astype(np.int32)
        yield rows(CLAIM, key, np.array([leader]), np.array([leader]), place)
        if held[1] != leader:
            yield rows(OPEN, key, np.array([leader]), uid, place)


def _blocks(nodes: DataFrame, reps: DataFrame) -> DataFrame:
    """(leader, place, uid): documents that share a sketch word with their leader, leaders included."""
    tasks = shuffle_tasks(nodes.sparkSession)
    keyed = (
        nodes.select("uid", F.explode("keys").alias("meet"))
        .select(F.explode("meet.keys").alias("key"), "uid", F.col("meet.place").alias("place"))
        .repartitionByRange(tasks, "key", "uid")
        .sortWithinPartitions("key", "uid")
    )
    runs = stored(keyed.mapInArrow(_lead_runs, _RUN_SCHEMA), "jaccard-runs")
    # Two claims a partition at most: sent to the rows, as rows of a hot key fill whole partitions.
    first = F.broadcast(runs.where(F.col("kind") == CLAIM).groupBy("key").agg(F.min("leader").alias("first")))
    # A run that was open at the end of a batch only, not of the partition, has its own leader.
    settled = (
        runs.where(F.col("kind") != MEMBER)
        .join(first, "key", "left")
        .withColumn("first", F.coalesce("first", "leader"))
        .where("uid <> first")
    )
    pairs = (
        runs.where(F.col("kind") == MEMBER)
        .select("leader", "place", "uid")
        .unionByName(settled.select(F.col("first").alias("leader"), "place", "uid"))
        .distinct()
    )
    # Copies with equal sets stand for one node from here on.
    as_leader = reps.select(F.col("uid").alias("leader"), F.col("rep").alias("leader_rep"))
    pairs = (
        pairs.join(as_leader, "leader")
        .join(reps.select("uid", "rep"), "uid")
        .where("leader_rep <> rep")
        .select(F.col("leader_rep").alias("leader"), "place", F.col("rep").alias("uid"))
        .distinct()
    )
    pairs = stored(pairs, "jaccard-pairs")
    return pairs.unionByName(pairs.select("leader", "place", F.col("leader").alias("uid")).distinct())


def _popcount(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=-1, dtype=np.int32)


def _tile_candidates(rule: Rule, nearest: int | None) -> Callable[[pa.Table], pa.Table]:
    """Pairs of one tile whose groups differ and whose sketches allow a link.

    ``nearest`` keeps each document's nearest earlier partners by sketch distance; None keeps all.
    Rows of side 1 are compared with one another when the tile lies on the diagonal, else with side 2.
    """

    def run(tile: pa.Table) -> pa.Table:
        uid, group, n, side, row, col = (tile.column(c).to_numpy() for c in ("uid", "grp", "n", "side", "row", "col"))
        bits = np.frombuffer(b"".join(tile.column("sketch").to_pylist()), dtype=np.uint64).reshape(len(uid), -1)
        diagonal = row[0] == col[0]
        left = np.flatnonzero(side == 1)
        right = left if diagonal else np.flatnonzero(side == 2)
        found_a, found_b = [], []
        step = max(1, 4_000_000 // max(1, len(right) * bits.shape[1]))
        for at in range(0, len(left), step):
            some = left[at : at + step]
            total = n[some][:, None] + n[right][None, :]
            bound = (rule.den - rule.num) * total // (rule.den + rule.num)
            gap = np.abs(n[some][:, None] - n[right][None, :])
            apart = _popcount(bits[some][:, None, :] ^ bits[right][None, :, :])
            good = (gap <= bound) & (apart <= bound) & (group[some][:, None] != group[right][None, :])
            if diagonal:
                good &= uid[some][:, None] > uid[right][None, :]
            if nearest is not None and good.shape[1] > nearest:
                ranked = np.where(good, apart, np.int32(2**30))
                best = np.argpartition(ranked, nearest - 1, axis=1)[:, :nearest]
                few = np.zeros_like(good)
                np.put_along_axis(few, best, True, axis=1)
                good &= few
            i, j = np.nonzero(good)
            found_a.append(uid[some][i])
            found_b.append(uid[right][j])
        a, b = np.concatenate(found_a or [uid[:0]]), np.concatenate(found_b or [uid[:0]])
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _candidates(blocks: DataFrame, sketches: DataFrame, groups: DataFrame | None, rule: Rule, nearest: int | None) -> DataFrame:
    """Distinct candidate pairs (a, b). Blocks are cut into tiles of bounded size by a hash of the document."""
    grp = blocks.withColumn("grp", F.col("uid"))
    if groups is not None:
        grp = (
            blocks.join(groups.withColumnRenamed("node", "uid"), "uid", "left")
            .withColumn("grp", F.coalesce("root", "uid"))
            .drop("root")
        )
    sizes = grp.groupBy("leader", "place").agg(
        F.count("*").alias("rows"), F.min("grp").alias("low"), F.max("grp").alias("high")
    )
    # A block in one group has nothing left to offer.
    sizes = sizes.where("low <> high").select("leader", "place", F.ceil(F.col("rows") / TILE_ROWS).cast("int").alias("cuts"))
    mine = F.pmod(F.xxhash64("uid"), F.col("cuts")).cast("int")
    members = grp.join(sizes, ["leader", "place"]).withColumn("mine", mine)
    # Tile (row, col), row <= col: a document of cut c is side 1 of tiles (c, *) and side 2 of tiles (*, c).
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    tiles = members.withColumn("other", other).select(
        "leader",
        "place",
        F.least("mine", "other").alias("row"),
        F.greatest("mine", "other").alias("col"),
        F.when(F.col("mine") <= F.col("other"), 1).otherwise(2).alias("side"),
        "uid",
        "grp",
    )
    full = tiles.join(sketches, ["uid", "place"])
    return full.groupBy("leader", "place", "row", "col").applyInArrow(_tile_candidates(rule, nearest), "a long, b long").distinct()


def _verify(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keep = []
            for piece in value_slices(batch, 64):
                last: tuple = (None, None)
                for left, right in zip(bytes_of(piece.column("text_a")), bytes_of(piece.column("text_b"))):
                    if last[0] != left:
                        last = (left, shingle_set(left, rule.width, hashes))
                    other = shingle_set(right, rule.width, hashes)
                    shared = len(np.intersect1d(last[1], other, assume_unique=True))
                    keep.append(rule.linked(shared, len(last[1]), len(other)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    ends = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    texts = texts.join(_sent(ends), "uid", "left_semi")
    left = texts.select(F.col("uid").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("uid").alias("b"), F.col("text").alias("text_b"))
    whole = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return whole.mapInArrow(_verify(rule), "a long, b long")


def _sent(rows: DataFrame) -> DataFrame:
    """Short rows (ids, fingerprints) for a join: sent to every executor when a count shows that they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _id_order() -> Column:
    return F.struct(F.col("id").isNotNull().alias("given"), F.col("id"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule()) -> DataFrame:
    """(id, n_shingles, component_id), one row per row of ``docs``; component_id is the smallest id reachable by links.

    Null and empty texts have no shingles and stay alone. A null id sorts before all others. Rows
    that repeat an id are documents of their own; if they link, they share a component.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = plain.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), *(T.StructField(c, T.LongType()) for c in ("n", "f1", "f2"))])
    for name, kind in (("keys", T.ArrayType(T.LongType())), ("sketches", T.BinaryType())):
        schema = schema.add(name, T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), T.StructField(name, kind)])))
    nodes = stored(plain.mapInArrow(_sketches(rule), schema).withColumn("uid", F.monotonically_increasing_id()), "jaccard-sketches")
    with_words = nodes.where("n > 0")
    firsts = with_words.groupBy("n", "f1", "f2").agg(F.min("uid").alias("rep"))
    reps = stored(with_words.select("uid", "n", "f1", "f2", "id").join(firsts, ["n", "f1", "f2"]), "jaccard-nodes")

    blocks = stored(_blocks(with_words, reps), "jaccard-blocks")
    needed = stored(blocks.select("uid").distinct(), "jaccard-needed")
    known = stored(reps.where("uid = rep").select("uid", "id", "n", "f1", "f2").join(_sent(needed), "uid"), "jaccard-known")
    sketches = nodes.select("uid", "n", F.explode("sketches").alias("meet"))
    sketches = sketches.select("uid", "n", F.col("meet.place").alias("place"), F.col("meet.sketches").alias("sketch"))
    sketches = stored(sketches.join(_sent(needed), "uid", "left_semi"), "jaccard-bits")
    texts = stored(_texts_of(plain, known, rule), "jaccard-texts")

    tried = stored(_candidates(blocks, sketches, None, rule, NEAREST), "jaccard-pairs")
    links = stored(_links(tried, texts, rule), "jaccard-links")
    groups = components(links)
    rest = stored(_candidates(blocks, sketches, groups, rule, None).join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
    more = stored(_links(rest, texts, rule), "jaccard-links")
    if not more.isEmpty():
        groups = components(links.unionByName(more))

    owner = _id_order()
    placed = (
        reps.select("uid", "rep", "id")
        .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select("uid", "id", F.coalesce("root", "rep").alias("root"))
    )
    smallest = placed.groupBy("root").agg(F.min(owner)["id"].alias("component_id"))
    found = placed.join(smallest, "root").select("uid", "component_id")
    return nodes.select("uid", "id", "n").join(found, "uid", "left").select(
        "id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )


def _texts_of(plain: DataFrame, known: DataFrame, rule: Rule) -> DataFrame:
    """(uid, text) of the known nodes: one text for each fingerprint."""
    ids = _sent(known.select(F.col("id").alias(f"{OWN}id")).distinct())
    wanted = plain.join(ids, F.col("id").eqNullSafe(F.col(f"{OWN}id")), "left_semi")
    marked = wanted.mapInArrow(_fingerprints(rule), T.StructType([*plain.schema.fields, *(T.StructField(c, T.LongType()) for c in ("n", "f1", "f2"))]))
    uid_of = _sent(known.select("uid", F.col("id").alias(f"{OWN}id"), "n", "f1", "f2"))
    joined = marked.join(uid_of, ["n", "f1", "f2"]).where(F.col("id").eqNullSafe(F.col(f"{OWN}id")))
    return joined.groupBy("uid").agg(F.first("text").alias("text"))


def _fingerprints(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for piece in value_slices(batch):
                out: dict[str, list] = {"n": [], "f1": [], "f2": []}
                for text in bytes_of(piece.column(1)):
                    shingles = shingle_set(text, rule.width, hashes)
                    out["n"].append(len(shingles))
                    for name, salt in (("f1", 5), ("f2", 6)):
                        out[name].append(int(np.bitwise_xor.reduce(_mix(shingles, salt)).view(np.int64)) if len(shingles) else 0)
                columns = [piece.column(0), piece.column(1), *(pa.array(out[k], pa.int64()) for k in ("n", "f1", "f2"))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "n", "f1", "f2"])

    return run


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule()) -> DataFrame:
    """``docs`` without the rows whose group has a smaller id; rows without shingles all stay."""
    found = jaccard_components(docs, id_col, text_col, rule)
    gone = (
        found.where(~F.col("id").eqNullSafe(F.col("component_id")))
        .select(F.struct("id").alias(f"{OWN}gone"))
        .distinct()
    )
    return docs.join(gone, F.struct(F.col(id_col).alias("id")) == F.col(f"{OWN}gone"), "left_anti")
